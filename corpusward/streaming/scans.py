"""Streaming scans, windowed counts and the open state of findings.

Sinks are Parquet folders under the shared folder, with the query checkpoint next to
them, so a query that is stopped or loses executors goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.operators.file_scan import NARROW_RULES, scan_files

FINDING_KEY = ["repo", "path", "line", "rule"]
SPAN_KEY = ["repo", "rule", "path"]


def scan_stream(files: DataFrame, rules=NARROW_RULES, **options) -> DataFrame:
    """The file scan on a stream of files. It keeps no state, so it is the batch operator."""
    return scan_files(files, rules, **options)


def unique_findings(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each finding once.

    Repeats of a finding within the watermark delay are dropped; state older than the
    watermark is forgotten, so it does not grow with the length of the stream.
    """
    return findings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(FINDING_KEY)


def windowed_counts(findings: DataFrame, width: str = "1 hour") -> DataFrame:
    """Findings per window and severity, of one batch of a stream or of a whole table."""
    return (
        findings.groupBy(F.window("ts", width), "severity")
        .agg(F.count("*").alias("findings"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "severity", "findings")
    )


def finding_spans(findings: DataFrame) -> DataFrame:
    """First and last run in which each (repo, rule, path) was seen, of one batch or of a table."""
    return findings.groupBy(*SPAN_KEY).agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.count("*").alias("hits"))


def append_to(stream: DataFrame, target: str, checkpoint: str, of_batch: Callable[[DataFrame], DataFrame] | None = None):
    """Run a stream over what is available now and append its rows to a Parquet folder.

    ``of_batch`` reduces every batch before it is stored. Each batch has its folder, and a
    batch that is repeated after a failure replaces its own.
    """
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append")
    if of_batch is None:
        return writer.format("parquet").option("path", target).start()

    def store(batch: DataFrame, number: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return writer.foreachBatch(store).start()


def window_totals(batches: DataFrame) -> DataFrame:
    """Counts of all windows from the stored counts of the batches, open windows included."""
    return batches.groupBy("window_start", "window_end", "severity").agg(F.sum("findings").alias("findings"))


def span_totals(batches: DataFrame) -> DataFrame:
    """Spans of all keys from the stored spans of the batches.

    The streaming query keeps no state. Writing the result to a new folder, as the first
    batch of what follows, keeps one row per key however many batches there were.
    """
    return batches.groupBy(*SPAN_KEY).agg(F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"), F.sum("hits").alias("hits"))


def open_findings(spans: DataFrame, latest_runs: DataFrame) -> DataFrame:
    """``open`` when a finding was seen in the latest run of its repository, else ``resolved``."""
    latest = latest_runs.select("repo", F.col("run_id").alias("latest_run"))
    state = F.when(F.col("last_run") == F.col("latest_run"), "open").otherwise("resolved")
    return spans.join(latest, "repo").select("repo", "rule", "path", "first_run", "last_run", state.alias("state"))
