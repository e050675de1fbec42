"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 53


def sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of about ``per_label`` rows of each label, or of all if there are fewer.

    A row is taken if the hash of its key, as a number from 0 to 1, is below ``per_label``
    divided by the label's rows. So rows are only counted: none are sorted or brought
    together, however frequent a label is. Keys that are repeated under a label count once.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
    counts = known.groupBy(label).agg(F.count("*").alias("_rows"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(UNIT)) / UNIT
    taken = known.join(F.broadcast(counts), label).where(chance * F.col("_rows") < per_label)  # one row for each label
    return taken.select(key, label).distinct()
