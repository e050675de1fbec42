"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusward", cores: str | int = "*", shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench, with ``shared`` as its shared folder. On a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting a local session uses a folder in its warehouse, as its only process is the driver. On a cluster
    it is an error, as nothing says that the warehouse is shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_between"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path for one table, not used before, under the shared folder."""
    return f"{shared_dir(spark)}/corpusward/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffle files as they end, not when the driver happens to collect its garbage; the session's setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame | list[DataFrame], label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This computes a costly table once, however many readers it has, and the result
    survives the loss of executors. Several frames of one schema are one table; they are written in turn, so that only one
    of them has shuffle files at a time.
    """
    turns = df if isinstance(df, list) else [df]
    spark, first = turns[0].sparkSession, turns[0]
    path = fresh_path(spark, label)
    with shuffles_dropped(spark):
        for turn in turns:
            turn.write.mode("errorifexists" if turn is first else "append").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(first.schema).parquet(path).select(*first.columns)


def forget(table: DataFrame) -> None:
    """Delete the files of a ``written`` table without partitions that nothing reads any more."""
    spark = table.sparkSession
    for name in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
