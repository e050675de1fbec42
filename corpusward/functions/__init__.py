"""Column helpers: paths, texts and small tables."""
