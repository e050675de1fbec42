"""Fixed dimensions of the library."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

def dimension(spark: SparkSession, rows: list[dict], schema: pa.Schema | None = None) -> DataFrame:
    """A fixed table of the library. Spark keeps it in the plan and knows its size."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
