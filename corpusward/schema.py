"""Table shapes shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward import catalog
from corpusward.functions.tables import dimension

FILES = "repo string, path string, size long, content string"

FINDING = (
    "repo string, run_id string, kind string, rule string, severity string, category string, "
    "path string, line int, snippet string, title string, confidence double, error string, scanner string"
)
FINDING_COLUMNS = tuple(part.split()[0] for part in FINDING.split(", "))

# The part of a finding that is kept in the history of a repository.
COMPACT = "kind string, rule string, severity string, category string, path string, title string, line int, error string"
COMPACT_COLUMNS = tuple(part.split()[0] for part in COMPACT.split(", "))

# One rule match inside a scan; ``as_findings`` adds what the catalog knows of the rule.
HIT = "struct<rule:string,line:int,snippet:string,error:string>"


def as_findings(hits: DataFrame, extra: tuple[catalog.Rule, ...] = ()) -> DataFrame:
    """Rows of (repo, path, rule, line, snippet, error) to the finding schema.

    The joined catalog is a fixed dimension with one row per rule, so it is broadcast.
    """
    rules = dimension(
        hits.sparkSession,
        [r._asdict() for r in {**catalog.BY_ID, **{r.rule: r for r in extra}}.values()],
    )
    return hits.join(F.broadcast(rules.drop("advice")), "rule").select(
        "repo",
        F.lit(None).cast("string").alias("run_id"),
        F.when(F.col("error").isNull(), "finding").otherwise("blocked").alias("kind"),
        "rule",
        "severity",
        "category",
        "path",
        "line",
        F.nullif(F.col("snippet"), F.lit("")).alias("snippet"),
        "title",
        "confidence",
        "error",
        "scanner",
    )


def stamp_run(findings: DataFrame, run_id: str) -> DataFrame:
    return findings.withColumn("run_id", F.lit(run_id))


def compact(findings: DataFrame) -> DataFrame:
    """Projection kept in the history. Only a blocked row carries its error."""
    return findings.select(
        "repo",
        "run_id",
        F.coalesce("kind", F.lit("finding")).alias("kind"),
        "rule",
        "severity",
        "category",
        "path",
        "title",
        "line",
        F.when(F.col("kind") == "blocked", F.col("error")).alias("error"),
    )


def _rank(column: str, values: tuple[str, ...]) -> Column:
    rank = F.lit(len(values))
    for n, value in reversed(list(enumerate(values))):
        rank = F.when(F.col(column) == value, n).otherwise(rank)
    return rank


def scanner_rank() -> Column:
    return _rank("scanner", tuple(s for s, _ in catalog.SCANNERS))


def severity_rank() -> Column:
    return _rank("severity", tuple(s for s, _ in catalog.SEVERITIES))


def category_rank() -> Column:
    return _rank("category", catalog.CATEGORIES)


def report_order() -> list[Column]:
    """Columns that put the findings of a repository in one fixed order.

    They stand for the position in a list: scanner, then path, line and rule. No row
    number is needed, so ordering costs no shuffle by repository.
    """
    return [
        scanner_rank().alias("scanner_rank"),
        F.col("path"),
        F.coalesce("line", F.lit(0)).alias("line_rank"),
        F.col("rule"),
        F.coalesce("snippet", F.lit("")).alias("snippet_rank"),
    ]
