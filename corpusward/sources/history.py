"""Findings and history tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.schema import COMPACT, FINDING, compact

HISTORY_FINDING = f"repo string, {COMPACT}, run_id string"
RUN = (
    "repo string, is_valid boolean, verdict string, "
    "coverage struct<total_files:bigint,reviewed_files:bigint,skipped_files:bigint,finding_count:bigint,blocked_count:bigint>, "
    "verification struct<checks_run:array<string>,history_source:string>, run_id string"
)
RUN_ID_FORMAT = "yyyy-MM-dd-HHmm"  # fixed value: run ids sort like the time they name


def run_id_of(moment: str | None = None) -> Column:
    """Run id of a timestamp column, or of now."""
    stamp = F.current_timestamp() if moment is None else F.col(moment)
    return F.date_format(stamp, RUN_ID_FORMAT)


def write_findings(findings: DataFrame, target: str, file_format: str = "parquet", mode: str = "append") -> None:
    """Store findings, one partition per run; sorted by repository within each file."""
    findings.sortWithinPartitions("repo", "path").write.format(file_format).mode(mode).partitionBy("run_id").save(target)


def read_findings(spark: SparkSession, source: str, file_format: str = "parquet") -> DataFrame:
    """Findings written by ``write_findings``, or JSON findings made elsewhere."""
    return spark.read.schema(FINDING).format(file_format).load(source)


def write_history(findings: DataFrame, runs: DataFrame, target: str) -> None:
    """Append one run: compact findings and a record per repository."""
    compact(findings).sortWithinPartitions("repo").write.mode("append").partitionBy("run_id").parquet(f"{target}/findings")
    runs.write.mode("append").partitionBy("run_id").parquet(f"{target}/runs")


def read_history(spark: SparkSession, source: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The runs and their compact findings; the filter on one repository reaches the scan."""
    runs = spark.read.schema(RUN).parquet(f"{source}/runs")
    found = spark.read.schema(HISTORY_FINDING).parquet(f"{source}/findings")
    if repo is not None:
        runs, found = runs.where(F.col("repo") == repo), found.where(F.col("repo") == repo)
    return runs, found


SAVED_REPORT = (
    f"root string, decision struct<verdict:string,reasons:array<string>>, "
    f"findings array<struct<{', '.join(part.replace(' ', ':') for part in COMPACT.split(', '))}>>, "
    "coverage struct<total_files:bigint,reviewed_files:bigint,skipped_files:bigint,finding_count:bigint,blocked_count:bigint>, "
    "verification struct<checks_run:array<string>,history_source:string>, _corrupt string"
)


def read_saved_reports(spark: SparkSession, folder: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Reports saved as one JSON file per run, as history tables (runs, findings).

    The run id is the date at the start of the file name. A file that does not parse keeps
    its run with ``is_valid`` false, so that an older readable one is taken instead. The
    root named in the report is the repository; a broken file is filed under its folder.
    """
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    name, place = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    report = F.from_json("value", SAVED_REPORT, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.select(
        F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2}-\d{4,6})", 1).alias("run_id"),
        F.element_at(F.split(place, "/"), -2).alias("folder"),
        report.alias("r"),
    )
    valid = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    rows = rows.select("run_id", "r", valid.alias("is_valid"), F.coalesce(F.when(valid, F.col("r.root")), "folder").alias("repo"))
    runs = rows.select("repo", "is_valid", "r.decision.verdict", "r.coverage", "r.verification", "run_id")
    found = rows.where("is_valid").select("repo", "run_id", F.inline("r.findings"))
    return runs, found.withColumn("kind", F.coalesce("kind", F.lit("finding")))


def run_records(decision: DataFrame, covered: DataFrame, verified: DataFrame) -> DataFrame:
    """Records for ``write_history`` from the verdict, coverage and verification tables."""
    shape = F.struct("total_files", "reviewed_files", "skipped_files", "finding_count", "blocked_count")
    checks = F.struct("checks_run", "history_source")
    return (
        covered.select("repo", shape.alias("coverage"))
        .join(verified.select("repo", checks.alias("verification")), "repo", "left")
        .join(decision.select("repo", "run_id", "verdict"), "repo", "left")
        .select("repo", F.lit(True).alias("is_valid"), "verdict", "coverage", "verification", "run_id")
    )
