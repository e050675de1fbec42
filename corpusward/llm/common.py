"""Small helpers of the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT = 2  # remainder of crc32(doc_id) mod 4 that no model learns from


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(name: str) -> None:
    """Send the functions of a module with its tasks, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def per_worker(key: str, make: Callable[[], object]) -> object:
    """An object of a Python worker process, kept between the tasks of a reused worker until a task makes another one."""
    held = sys.modules.setdefault("corpusward_worker", types.ModuleType("corpusward_worker")).__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def held_out(doc_id: Column) -> Column:
    """True for documents that models must not learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def row_key(doc_id: Column, text: Column) -> Column:
    """A random-looking key that only rows with equal id and text share."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit(""))))


def word_count(text: Column) -> Column:
    """Number of words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


ship(__name__)
