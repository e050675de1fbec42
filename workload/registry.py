"""All registered queries."""

from __future__ import annotations

from workload import checklist, code, copies, relations, reports, reviews, scans

PARTS = (scans, reports, checklist, reviews, copies, relations, code)
QUERIES = {name: fn for part in PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: text for part in PARTS for name, text in part.ORACLES.items()}
