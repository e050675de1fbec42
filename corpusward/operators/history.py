"""Runs over time: comparison, status of earlier findings, latest run, retention.

The history is two tables: ``runs`` with a row per repository and run, and the compact
findings of those runs. A run of any size is rows, never one long array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.schema import report_order, severity_rank

KEY = ["repo", "rule", "path"]
KEPT = ("kind", "severity", "category", "title", "line")


def last_per_key(findings: DataFrame) -> DataFrame:
    """The last finding of each (repo, rule, path) in report order; the line is not part of the key.

    ``max_by`` combines on the map side, so many hits of one rule in one file shrink to a
    row before the shuffle.
    """
    order = F.struct(*report_order())
    return findings.groupBy(*KEY).agg(F.max_by(F.struct(*KEPT), order).alias("f"))


def compare_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each key: ``new``, ``carried`` (shown as it is now) or ``resolved``.

    Both sides have unique keys, so the outer join cannot multiply rows.
    """
    before = last_per_key(previous).select(*KEY, F.col("f").alias("before"))
    now = last_per_key(current).select(*KEY, F.col("f").alias("now"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("carried")
    shown = F.coalesce("now", "before").alias("shown")
    return before.join(now, KEY, "full_outer").select(
        *KEY, status.alias("status"), F.col("before.severity").alias("previous_severity"), shown
    ).select(*KEY, "status", "previous_severity", "shown.*")


def progress(comparison: DataFrame) -> DataFrame:
    """New, carried and resolved keys per repository."""
    return comparison.groupBy("repo").agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("new", "carried", "resolved")]
    )


def prior_status(comparison: DataFrame) -> DataFrame:
    """Exactly one status for every finding of the previous run.

    ``fixed`` when it is gone, ``remaining`` when it is unchanged, ``downgraded`` or
    ``raised`` when its severity changed.
    """
    def rank(column: str) -> Column:
        return F.array_position(F.array(*[F.lit(s) for s in ("P0", "P1", "P2", "P3")]), F.col(column))

    before, now = rank("previous_severity"), rank("severity")
    status = (
        F.when(F.col("status") == "resolved", "fixed")
        .when(now > before, "downgraded")
        .when(now < before, "raised")
        .otherwise("remaining")
    )
    return comparison.where(F.col("status") != "new").select(*KEY, "previous_severity", "severity", status.alias("prior_status"))


def normalise_runs(runs: DataFrame, run_findings: DataFrame) -> DataFrame:
    """Fill what older records lack: coverage, blocked count, checks that ran."""
    counts = run_findings.groupBy("repo", "run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "blocked").alias("b")
    )
    number = lambda column, other: F.coalesce(F.col(column), F.col(other), F.lit(0)).cast("long")
    return runs.join(counts, ["repo", "run_id"], "left").select(
        "repo",
        "run_id",
        "is_valid",
        F.coalesce("coverage.total_files", F.lit(0)).cast("long").alias("total_files"),
        number("coverage.finding_count", "n").alias("finding_count"),
        number("coverage.blocked_count", "b").alias("blocked_count"),
        F.coalesce("verification.checks_run", F.array().cast("array<string>")).alias("checks_run"),
        F.col("verification.history_source").alias("history_source"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest readable run of each repository; run ids sort by time."""
    columns = [c for c in runs.columns if c != "repo"]
    return (
        runs.where("is_valid")
        .groupBy("repo")
        .agg(F.max_by(F.struct(*columns), "run_id").alias("r"))
        .select("repo", "r.*")
    )


def retention_plan(runs: DataFrame, run_findings: DataFrame) -> DataFrame:
    """``keep`` or ``drop`` for every run.

    The newest run stays. The one before stays only while a finding of it is still open
    in the newest. Records that cannot be read as a run are left alone.
    """
    readable = runs.where("is_valid").select("repo", "run_id")
    newest = readable.groupBy("repo").agg(F.max("run_id").alias("newest"))
    earlier = readable.join(newest, "repo").where(F.col("run_id") < F.col("newest"))
    ends = newest.join(earlier.groupBy("repo").agg(F.max("run_id").alias("prior")), "repo", "left")

    keys = run_findings.select("run_id", *KEY).distinct()
    marked = keys.join(ends, "repo").where(F.col("run_id").isin(F.col("newest"), F.col("prior")))
    both = marked.groupBy(*KEY).agg(F.count("*").alias("runs")).where("runs = 2")
    still_open = both.groupBy("repo").agg(F.lit(True).alias("still_open"))

    ends = ends.join(still_open, "repo", "left")
    kept = (F.col("run_id") == F.col("newest")) | ((F.col("run_id") == F.col("prior")) & F.coalesce("still_open", F.lit(False)))
    plan = F.when(~F.col("is_valid"), "keep").when(F.coalesce(kept, F.lit(False)), "keep").otherwise("drop")
    return runs.join(ends, "repo", "left").select("repo", "run_id", plan.alias("plan"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two snapshots.

    Only size and hash of a text take part in the join; texts stay where they are.
    """
    def digest(files: DataFrame, name: str) -> DataFrame:
        content = F.col("content")
        return files.select("repo", "path", F.struct(F.octet_length(content).alias("n"), F.xxhash64(content).alias("h")).alias(name))

    joined = digest(before, "b").join(digest(after, "a"), ["repo", "path"], "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return joined.select("repo", "path", change.alias("change")).where("change IS NOT NULL")


def changed_with_findings(changes: DataFrame, open_findings: DataFrame) -> DataFrame:
    """Changed files that still had findings when last audited."""
    return changes.join(open_findings.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
