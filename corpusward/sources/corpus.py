"""Reading and writing tables of files."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusward.functions import paths, text
from corpusward.session import written

# Functions of tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Spark lists the folders of each crowded folder in a job of its own, with a task for every folder up to 10,000; a task costs more than a listing.
LISTERS = 64
A_TASK = 32  # folders or files that are worth a task
ROWS, BYTES = 10_000, 4 << 20  # of a batch of names, of a batch of contents
IN_TASKS = ("file:", "hdfs:")  # stores that tasks list and read themselves


@contextmanager
def listed_by(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Tables loaded inside are listed by at most so many tasks a job; the session's setting is put back."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), tasks))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tree_store(root: str) -> tuple[stores.FileSystem, str]:
    """The store of a qualified root, and the root's path in it."""
    return (stores.LocalFileSystem(), re.sub(r"^file:/+", "/", root)) if root.startswith("file:") else stores.FileSystem.from_uri(root)


def tasks_reach(root: str) -> bool:
    try:
        return root.startswith(IN_TASKS) and bool(tree_store(root))
    except (OSError, ValueError, NotImplementedError):  # no Hadoop library for Arrow
        return False


def left_out(name: str, size: int | None) -> bool:
    """Files and folders that Spark's readers leave out: empty files and hidden names."""
    underscored = name.startswith("_") and "=" not in name and not (size is None and name.startswith(("_metadata", "_common_metadata")))
    return size == 0 or underscored or name.startswith(".") or name.endswith("._COPYING_")


def names_in(store: stores.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder, and the size of what is a file. A mounted disk gives them one by one."""
    if isinstance(store, stores.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                try:
                    yield entry.name, None if entry.is_dir() else entry.stat().st_size
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
    else:
        for found in store.get_file_info(stores.FileSelector(folder)):
            yield found.base_name, None if found.type == stores.FileType.Directory else found.size


def list_folders(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folders below the root to what they hold: inner (the path below the root) and size, null for a folder."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = tree_store(root)
        rows: list[tuple[str, int | None]] = []
        full = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["inner", "size"])
        for batch in batches:
            for folder in batch.column(0):
                inside = f"{folder.as_py()}/".lstrip("/")
                for name, size in names_in(store, f"{base}/{inside}"):
                    if not left_out(name, size):
                        rows.append((inside + name, size))
                    if len(rows) == ROWS:
                        yield full()
                        rows.clear()
        yield full()

    return of_batches


def contents(root: str, inner: Column) -> Column:
    """The bytes of the files below the root, null for null. A batch holds some megabytes or one file."""

    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store, base = tree_store(root)
        for batch in batches:
            held: list[bytes | None] = []
            size = 0
            for name in batch:
                content = None
                if name.is_valid:
                    with store.open_input_stream(f"{base}/{name.as_py()}") as source:
                        content = source.read()
                    size += len(content)
                held.append(content)
                if size >= BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            if held:
                yield pa.array(held, pa.binary())

    return F.arrow_udf(of_batches, "binary")(inner)


def listed_in_tasks(spark: SparkSession, root: str) -> DataFrame:
    """inner and size of every file below the root. A written table a level; the driver holds no names."""
    folders, levels, files, left = spark.createDataFrame([("",)], "inner string"), [], 0, 1
    while left:
        spread = folders.repartition(min(LISTERS, left // A_TASK + 1))
        level = written(spread.mapInArrow(list_folders(root), "inner string, size long"), "listed")
        levels.append(level.where("size IS NOT NULL"))
        folders = level.where("size IS NULL").select("inner")
        sizes, rows = level.agg(F.count("size"), F.count("*")).first()
        files, left = files + sizes, rows - sizes
    return reduce(DataFrame.unionByName, levels).repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), files // A_TASK + 1))


def glob_pattern(spark: SparkSession, glob: str) -> str:
    """The pattern of a Hadoop glob for a whole name."""
    return rf"(?s)\A(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})\z"


def read_tree(
    spark: SparkSession,
    root: str,
    repo_depth: int = 0,
    glob: str | None = None,
    size_limit: int | None = None,
) -> DataFrame:
    """Files below ``root`` as (repo, path, size, content).

    The first ``repo_depth`` folders below the root name the repository; with 0 the root
    is one repository, called by its last folder. ``glob`` keeps files by name and
    ``size_limit`` leaves larger files unread: both are settled while listing, before
    any content is loaded. Files over the limit keep their row, with null content.

    On mounted disks, and on HDFS where Arrow has its library, tasks list the folders level by level into written tables and read
    the files. Trees in other stores are listed by Spark, which holds every file of them on the driver.
    """
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if tasks_reach(place):
        raw = listed_in_tasks(spark, place)
        if glob:
            raw = raw.where(F.substring_index("inner", "/", -1).rlike(glob_pattern(spark, glob)))
        wanted = F.col("inner") if size_limit is None else F.when(F.col("size") <= size_limit, F.col("inner"))
        raw = raw.select("inner", "size", contents(place, wanted).alias("content"))
    else:
        raw = listed_by_spark(spark, root, base, glob, size_limit)
    files = raw.select(
        "inner",
        "size",
        text.decode(F.col("content")).alias("content"),
        F.coalesce(~F.is_valid_utf8(F.col("content").cast("string")), F.lit(False)).alias("bad_bytes"),
    )
    if repo_depth == 0:
        repo, path = F.lit(base.rsplit("/", 1)[-1]), F.col("inner")
    else:
        repo = F.substring_index("inner", "/", repo_depth)
        path = F.regexp_replace("inner", rf"^(?:[^/]*/){{{repo_depth}}}", "")
    return files.select(repo.alias("repo"), path.alias("path"), "size", "content", "bad_bytes")


def listed_by_spark(spark: SparkSession, root: str, base: str, glob: str | None, size_limit: int | None) -> DataFrame:
    """inner, size and content of the files below the root, by Spark's reader."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with listed_by(spark, LISTERS):
        raw = reader.load(root)
    inner = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), rf"^.*?\Q{base}\E/", "")
    raw = raw.select(inner.alias("inner"), F.col("length").alias("size"), "content")
    if size_limit is None:
        return raw
    large = raw.where(F.col("size") > size_limit).select("inner", "size", F.lit(None).cast("binary").alias("content"))
    return raw.where(F.col("size") <= size_limit).unionByName(large)


def put_files(rows: Iterable[Row], root: str) -> None:
    """Write each row's content under its name; a file gets the name when it is whole, so a task may run twice."""
    store, base = stores.FileSystem.from_uri(root)
    mark = f".{TaskContext.get().taskAttemptId()}"
    for row in rows:
        folder, name = os.path.split(f"{base}/{row.repo}/{row.path}")
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{mark}") as out:
            out.write(row.content)
        store.move(f"{folder}/{mark}", f"{folder}/{name}")


def write_tree(files: DataFrame, root: str) -> None:
    """Files (repo, path, binary content) as single files below ``root``, a shared folder; a path without scheme is on a mounted disk.

    Names must differ. Tasks write through Arrow's file systems: Spark's writers start a process for every file they
    open on a mounted disk, to set its mode.
    """
    files.select("repo", "path", "content").foreachPartition(lambda rows: put_files(rows, root))


def read_corpus(
    spark: SparkSession,
    source: str,
    repo: str = "repo",
    path: str = "path",
    content: str = "content",
    file_format: str = "parquet",
) -> DataFrame:
    """A stored table of files; its columns are renamed to (repo, path, size, content).

    ``source`` is a table name of the catalog or a path in ``file_format``. Binary
    contents are decoded. The size is the number of bytes stored.
    """
    table = spark.read.format(file_format).load(source) if "/" in source else spark.table(source)
    body = F.col(content)
    binary = dict(table.dtypes)[content] == "binary"
    shown = text.decode(body) if binary else body
    bad = [(~F.is_valid_utf8(body.cast("string"))).alias("bad_bytes")] if binary else []
    size = F.col("size").cast("long") if "size" in table.columns else F.octet_length(body).cast("long")
    group = [F.col("language_group")] if "language_group" in table.columns else []
    return table.select(F.col(repo).alias("repo"), F.col(path).alias("path"), size.alias("size"), shown.alias("content"), *bad, *group)


# Groups of a stored corpus; each is a partition of the table.
PYTHON, WEB, MARKERS, OTHER = "python", "web", "markers", "other"
MARKER_NAMES = (
    ".gitignore", "SKILL.md", "pyproject.toml", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
)


def language_group(path: Column) -> Column:
    name, ending = paths.file_name(path), paths.lower_suffix(path)
    return (
        F.when(name.endswith(".py"), PYTHON)
        .when(ending.isin(".js", ".jsx", ".ts", ".tsx", ".html"), WEB)
        .when(path.isin(*MARKER_NAMES) | name.rlike(r"^requirements.*\.txt\z"), MARKERS)
        .otherwise(OTHER)
    )


def write_corpus(files: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Store files partitioned by language group and sorted by path.

    The code pass then reads the Python partition alone, and the manifest and marker
    lookups read one small partition, instead of every text once more.
    """
    grouped = files.withColumn("language_group", language_group(F.col("path")))
    grouped.sortWithinPartitions("language_group", "path").write.mode(mode).partitionBy("language_group").parquet(target)


def store_corpus(files: DataFrame, table: str, path: str | None = None, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Store files as a table partitioned by language group and bucketed by repository.

    Scans read the groups they need, and aggregates and joins on the repository need no exchange. One
    repository is one bucket in each group; a repository that outgrows a bucket file should be stored without buckets (``write_corpus``).
    ``path`` places the table outside the warehouse.
    """
    grouped = files.withColumn("language_group", language_group(F.col("path"))).repartition(buckets, "repo")
    writer = grouped.write.mode(mode).partitionBy("language_group").bucketBy(buckets, "repo").sortBy("repo", "path")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def of_groups(files: DataFrame, *groups: str) -> DataFrame:
    """Only these language groups, where the table knows them; otherwise all files.

    It prunes partitions and never decides a result: callers still filter by name.
    """
    if "language_group" in files.columns:
        return files.where(F.col("language_group").isin(*groups))
    return files
