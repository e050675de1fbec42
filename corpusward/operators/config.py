"""Settings of the audited projects: suppressions and severity overrides.

Both are small tables, checked before they are broadcast; a row without ``repo`` holds
for every repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


OVERRIDES = "repo string, rule string, severity string"
SUPPRESSIONS = "repo string, path string, rule string"


def no_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OVERRIDES)


def no_suppressions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SUPPRESSIONS)


def suppression_rows(settings: DataFrame) -> DataFrame:
    """Settings with a list of rules per path, to one row per (path, rule)."""
    repo = F.col("repo") if "repo" in settings.columns else F.lit(None).cast("string")
    return settings.select(repo.alias("repo"), "path", F.explode("rules").alias("rule"))


def _with_repo(table: DataFrame) -> DataFrame:
    return table if "repo" in table.columns else table.withColumn("repo", F.lit(None).cast("string"))


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop findings whose exact path and rule are suppressed."""
    s = _with_repo(suppressions).distinct().alias("s")
    f = findings.alias("f")
    same = (F.col("f.path") == F.col("s.path")) & (F.col("f.rule") == F.col("s.rule"))
    own = F.col("s.repo").isNull() | (F.col("s.repo") == F.col("f.repo"))
    return f.join(s, same & own, "left_anti")


def override_severity(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace severities by rule. An override of the repository wins over a general one."""
    rows = _with_repo(overrides)
    general = rows.where("repo IS NULL").groupBy("rule").agg(F.max("severity").alias("general"))
    own = rows.where("repo IS NOT NULL").groupBy("repo", "rule").agg(F.max("severity").alias("own"))
    joined = findings.join(general, "rule", "left").join(own, ["repo", "rule"], "left")
    return joined.withColumn("severity", F.coalesce("own", "general", "severity")).select(*findings.columns)


def apply_config(findings: DataFrame, overrides: DataFrame | None = None, suppressions: DataFrame | None = None) -> DataFrame:
    """Suppress first, then override. No settings leave the findings as they are."""
    if suppressions is not None:
        findings = suppress(findings, suppressions)
    if overrides is not None:
        findings = override_severity(findings, overrides)
    return findings
