"""Release verdicts: go or no-go per repository and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.catalog import REVIEW_THRESHOLD
from corpusward.schema import report_order

# --- Fixed values: what stops a release ----------------------------------------------
STOP_RULES = ("hardcoded-secret", "missing-gitignore", "private-key-material", "tracked-env-risk")
STOP_CATEGORIES = ("Bugs and Logic Errors", "Data Leaks", "Performance and Memory", "Security")
# The written policy also stops at ignore files that let environment files or logs through.
DOCUMENTED_STOP_RULES = STOP_RULES + ("gitignore-missing-dotenv", "gitignore-missing-logs")

CODE, DOCUMENTED = "code", "documented"


def stops_release(policy: str = CODE) -> Column:
    """True for a finding that alone makes the verdict NO-GO.

    ``code``: a blocked row, P0, a stop rule, or P1 in a stop category. ``documented``:
    a blocked row, P0 or a stop rule of the written policy; findings of low confidence
    do not count.
    """
    blocked, worst = F.col("kind") == "blocked", F.col("severity") == "P0"
    if policy == DOCUMENTED:
        sure = F.coalesce("confidence", F.lit(1.0)) >= REVIEW_THRESHOLD
        return sure & (blocked | worst | F.col("rule").isin(*DOCUMENTED_STOP_RULES))
    serious = (F.col("severity") == "P1") & F.col("category").isin(*STOP_CATEGORIES)
    return F.coalesce(blocked | worst | F.col("rule").isin(*STOP_RULES) | serious, F.lit(False))


def verdict(findings: DataFrame, policy: str = CODE, repos: DataFrame | None = None, run_id: str | None = None) -> DataFrame:
    """One row per repository and run: verdict and how often each rule stopped it.

    ``reasons`` holds (rule, count) and so never grows beyond the number of rules; the
    single occurrences, in report order, are ``verdict_reasons``. ``repos`` adds
    repositories without any finding, which are GO, under ``run_id``.
    """
    counts = findings.groupBy("repo", "run_id", "rule").agg(F.count_if(stops_release(policy)).alias("count"))
    listed = F.sort_array(F.collect_list(F.when(F.col("count") > 0, F.struct("rule", "count"))))
    out = counts.groupBy("repo", "run_id").agg(F.sum("count").alias("reason_count"), listed.alias("reasons"))
    if repos is not None:
        # both sides have one row per repository
        out = repos.select("repo").distinct().join(out, "repo", "left").fillna(0, ["reason_count"])
        out = out.withColumn("run_id", F.coalesce("run_id", F.lit(run_id).cast("string")))
        out = out.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<struct<rule:string,count:bigint>>")))
    return out.select("repo", "run_id", F.when(F.col("reason_count") > 0, "NO-GO").otherwise("GO").alias("verdict"), "reason_count", "reasons")


def verdict_reasons(findings: DataFrame, policy: str = CODE) -> DataFrame:
    """One row per stopping finding, duplicates kept, with the columns that order them."""
    return findings.where(stops_release(policy)).select("repo", "run_id", "rule", *report_order()[:1], "path", *report_order()[2:3])


def blocking_findings(findings: DataFrame, policy: str = CODE) -> DataFrame:
    """All findings of a rule that stopped the repository, every P0 and every blocked row.

    Wider than the verdict: a rule that stopped once brings in all its findings. The rules
    come from the aggregate, one row per repository and rule, so the join key is unique on
    that side and Spark splits a hot repository on the other.
    """
    stopping = (
        findings.groupBy("repo", "run_id", "rule").agg(F.bool_or(stops_release(policy)).alias("stopping")).where("stopping")
    )
    direct = (F.col("severity") == "P0") | (F.col("kind") == "blocked")
    keys = [findings[k].eqNullSafe(stopping[k]) for k in ("repo", "run_id", "rule")]
    by_rule = findings.where(~direct).join(stopping, keys, "left_semi")
    return findings.where(direct).unionByName(by_rule)


def release_checklist(findings: DataFrame, policy: str = CODE) -> DataFrame:
    """Every finding marked ``required`` (blocking) or ``optional`` before the release."""
    stopping = (
        findings.groupBy("repo", "run_id", "rule")
        .agg(F.bool_or(stops_release(policy)).alias("stopping"))
        .where("stopping")
        .select(F.col("repo").alias("r"), F.col("run_id").alias("i"), F.col("rule").alias("u"), "stopping")
    )
    keys = F.col("repo").eqNullSafe(F.col("r")) & F.col("run_id").eqNullSafe(F.col("i")) & (F.col("rule") == F.col("u"))
    needed = F.col("stopping").isNotNull() | (F.col("severity") == "P0") | (F.col("kind") == "blocked")
    return findings.join(stopping, keys, "left").select(
        *findings.columns, F.when(needed, "required").otherwise("optional").alias("due")
    )
