"""An inverted index of identifiers: in which files a name stands, and in what kind of token.

Python files tell names in code from words in strings and comments; in other files every word is text.
The index has a row per file, kind and different name. It is written once and read by every question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions import paths

USE, TEXT = "name", "text"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def name_index(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, path, kind, name). Python files that cannot be read as tokens count as text."""
    read = facts.where("words IS NOT NULL").select("repo", "path", F.inline("words"))
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(IDENTIFIER), F.lit(0)))
    plain = files.where(~F.col("path").endswith(".py")).select("repo", "path", F.lit(TEXT).alias("kind"), F.explode(words).alias("name"))
    unread = facts.where("words IS NULL").select("repo", "path")
    rest = files.where(F.col("path").endswith(".py")).join(unread, ["repo", "path"], "left_semi").select("repo", "path", F.lit(TEXT).alias("kind"), F.explode(words).alias("name"))
    return read.select("repo", "path", "kind", "name").unionByName(plain).unionByName(rest)


def old_name_references(removed: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, name, path, reference) for removed public names: ``use`` in code, ``mention`` in strings, comments and texts alone."""
    held = index.join(removed.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    found = held.groupBy("repo", "name", "path").agg(F.max(F.col("kind") == USE).alias("used"))
    return found.select("repo", "name", "path", F.when(F.col("used"), "use").otherwise("mention").alias("reference"))


def unreferenced_scripts(files: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, path) of files in ``scripts/`` whose name stands in no other file of the repository."""
    scripts = files.where(F.col("path").startswith("scripts/")).select("repo", F.col("path").alias("script"), paths.stem(F.col("path")).alias("name"))
    near = index.join(scripts, ["repo", "name"]).where("path <> script").select("repo", "script").distinct()
    return scripts.select("repo", "script").join(near, ["repo", "script"], "left_anti").select("repo", F.col("script").alias("path"))
