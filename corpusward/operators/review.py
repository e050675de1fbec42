"""Reviewer output: parsing, validation, confidence, merging, context and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusward.catalog import CONFIDENCE_LEVELS, REVIEW_THRESHOLD
from corpusward.functions import text
from corpusward.functions.sqltext import quoted
from corpusward.schema import severity_rank

FINDING_ITEM = (
    "category:string,severity:string,file:string,line:int,rule:string,confidence:string,"
    "title:string,why:string,evidence:string,fix:string"
)
ANSWER = (
    f"agent string, findings array<struct<{FINDING_ITEM}>>, blocked array<string>, "
    "files_reviewed array<string>, _corrupt string"
)
FENCED_JSON = r"(?s)```json\s*(.*?)```"
UNREADABLE = "reviewer returned no readable answer"
LINE_GAP = 3  # fixed value: findings this close on one rule are the same
MASKED_RULES = (
    "hardcoded-secret", "token-storage", "sensitive-log-field", "web3-hardcoded-mnemonic",
    "web3-hardcoded-private-key", "web3-address-no-checksum",
)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Answers (repo, reviewer, text) with the parsed block in ``answer``; null if unreadable."""
    block = F.nullif(F.regexp_extract("text", FENCED_JSON, 1), F.lit(""))
    parsed = F.from_json(block, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = responses.select("repo", "reviewer", parsed.alias("a"))
    whole = F.col("a").isNotNull() & F.col("a._corrupt").isNull() & F.col("a.findings").isNotNull()
    return rows.select("repo", "reviewer", F.when(whole, F.col("a")).alias("answer"))


def response_findings(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "reviewer", F.inline("answer.findings"))


def response_blocked(parsed: DataFrame) -> DataFrame:
    """Checks the reviewers could not do, and the answers that could not be read."""
    said = parsed.select("repo", "reviewer", F.explode("answer.blocked").alias("error"))
    unread = parsed.where("answer IS NULL").select("repo", "reviewer", F.lit(UNREADABLE).alias("error"))
    return said.unionByName(unread)


def files_reviewed(parsed: DataFrame) -> DataFrame:
    """Each reviewed file once, over all reviewers."""
    return parsed.select("repo", F.explode("answer.files_reviewed").alias("path")).distinct()


def needs_evidence() -> Column:
    return F.col("severity").isin("P0", "P1") & (text.strip(F.coalesce("evidence", F.lit(""))) == "")


def accepted(findings: DataFrame) -> DataFrame:
    return findings.where(~needs_evidence())


def rejected(findings: DataFrame) -> DataFrame:
    """P0 and P1 findings that show no evidence."""
    return findings.where(needs_evidence())


def confidence_value(level: str = "confidence") -> Column:
    """Number of a named level; unknown names count as medium."""
    out = F.lit(CONFIDENCE_LEVELS["medium"])
    for name, value in CONFIDENCE_LEVELS.items():
        out = F.when(F.lower(level) == name, value).otherwise(out)
    return out


def is_sure() -> Column:
    return confidence_value() >= REVIEW_THRESHOLD


def needs_review(findings: DataFrame) -> DataFrame:
    """Findings of low confidence; they stay out of verdicts and counts."""
    return findings.where(~is_sure())


def merge_reviews(findings: DataFrame) -> DataFrame:
    """One finding per cluster of near lines with the same file and rule.

    Lines at most three apart chain: 3, 6 and 9 are one cluster. Kept is the highest
    severity, then the highest confidence, then the first line and reviewer. Rows on one
    line are merged first, with partial aggregation; the window then sees each line of a
    file once, so its groups are bounded by the length of a file.
    """
    columns = findings.columns
    rank = F.struct(severity_rank().alias("s"), (-confidence_value()).alias("c"), F.coalesce("line", F.lit(0)).alias("l"), F.col("reviewer").alias("r"), F.coalesce("evidence", F.lit("")).alias("e"))
    place = ["repo", "file", "rule", "line"]
    best = findings.groupBy(*place).agg(F.min(rank).alias("rank"), F.min_by(F.struct(*columns), rank).alias("row"))
    by_line = Window.partitionBy("repo", "file", "rule", F.col("line").isNull()).orderBy("line")
    gap = F.col("line") - F.lag("line").over(by_line)
    starts = best.withColumn("start", F.when(gap.isNull() | (gap > LINE_GAP), 1).otherwise(0))
    clusters = starts.withColumn("cluster", F.sum("start").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    kept = clusters.groupBy("repo", "file", "rule", F.col("line").isNull().alias("whole_file"), "cluster").agg(F.min_by("row", "rank").alias("row"))
    return kept.select("row.*")


CASES = 500  # tests in one expression

# Surroundings in which a finding is usually no defect.
# priority, rule, path pattern, line pattern, kind of block around the line, action
DEFAULT_CONTEXT_RULES = (
    (10, "todo", "^(tests|docs)/", None, None, "drop"),
    (10, "placeholder", "^(tests|docs|examples)/", r"(?i)example[.]com|test@|sample|dummy", None, "drop"),
    (10, "wildcard-cors", r"(^|/)(dev|local)[^/]*$", None, None, "low"),
    (10, "python-print-call", r"(^|/)[^/]*backtest[^/]*$", None, None, "drop"),
    (10, "except-pass", r"(^|/)__init__[.]py$", None, None, "drop"),
    (10, "python-except-pass", r"(^|/)__init__[.]py$", None, None, "drop"),
    (10, "unsafe-exec", "^tests/", None, None, "drop"),
    (10, "python-float-money", r"(?i)(^|/)[^/]*(report|plot|display)[^/]*$", None, None, "low"),
    (10, "web3-inline-from-key", None, r"os[.](environ|getenv)", None, "drop"),
    (10, "hardcoded-date", r"(^|/)[^/]*backtest[^/]*$", None, None, "drop"),
    (10, "wildcard-cors", None, None, "debug-branch", "low"),
    (10, "except-pass", None, None, "abstract-class", "drop"),
    (10, "except-pass", None, None, "protocol-class", "drop"),
    (10, "except-pass", None, None, "finally", "low"),
    (10, "python-except-pass", None, None, "finally", "low"),
    (10, "python-empty-function", None, None, "abstract-class", "drop"),
    (10, "python-empty-function", None, None, "protocol-class", "drop"),
    (10, "python-missing-type-hints", None, None, "main-guard", "drop"),
    (10, "python-print-call", None, None, "main-guard", "low"),
    (10, "debug-call", None, None, "main-guard", "low"),
    (10, "placeholder", None, None, "docstring", "low"),
)
CONTEXT_SCHEMA = "priority int, rule string, path_regex string, line_regex string, within string, action string"


def default_context_rules(spark: SparkSession) -> DataFrame:
    """The library's rows for ``apply_context``; rows of a project go beside them with a higher priority."""
    return spark.createDataFrame(DEFAULT_CONTEXT_RULES, CONTEXT_SCHEMA)


def with_blocks(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings with ``within``: the kinds of blocks around their line, from the facts of the file, sorted.

    Blocks are intervals of lines. A file's are one array, so a finding meets one row and looks for its line in it. Findings without
    a line and files without facts have none.
    """
    spans = facts.where("size(spans) > 0").select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), "spans")
    joined = findings.join(spans, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("path") == F.col("_path")), "left")
    around = F.expr("array_sort(array_distinct(transform(filter(spans, s -> line BETWEEN s.first AND s.last), s -> s.kind)))")
    return joined.withColumn("within", F.coalesce(around, F.array().cast("array<string>"))).drop("_repo", "_path", "spans")


def with_lines(findings: DataFrame, files: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """Findings with ``line_text``, the whole line they stand in; only for ``rules``, if given, so that few texts are read.

    The lines asked for in a file are gathered first, no more than it has; so every text meets one row.
    """
    asked = findings if rules is None else findings.where(F.col("rule").isin(*rules))
    wanted = asked.where("line IS NOT NULL").groupBy("repo", "path").agg(F.collect_set("line").alias("asked"))
    split = files.select("repo", "path", "content").join(wanted, ["repo", "path"]).withColumn("ls", text.lines(F.col("content")))
    found = split.select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), F.inline(F.expr("transform(filter(asked, n -> n <= size(ls)), n -> named_struct('_line', n, 'line_text', ls[n - 1]))")))
    same = F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line"))
    shown = F.lit(True) if rules is None else F.col("rule").isin(*rules)
    return findings.join(found, same & shown, "left").drop("_repo", "_path", "_line")


def apply_context(findings: DataFrame, context_rules: DataFrame) -> DataFrame:
    """Drop or weaken findings by their surroundings.

    ``context_rules`` has priority, rule (null for any), path_regex, line_regex, within (a kind of block;
    null, or no such column, for any) and action: ``drop``, ``low`` or ``keep``. Of rows that fit, the highest priority
    counts, and the first of equal ones; so a project rule of higher priority overrides a general one. The table holds
    settings; its rows become literal patterns. Patterns for lines look at ``line_text`` where findings have it
    (``with_lines``), else at the evidence; blocks are known from ``with_blocks``.
    """
    has_blocks = "within" in findings.columns
    line = f"coalesce({'line_text, ' if 'line_text' in findings.columns else ''}snippet, '')"
    rows = sorted((r.asDict() for r in context_rules.collect()), key=lambda r: -r["priority"])
    cases = []
    for r in rows:
        if r.get("within") and not has_blocks:
            continue
        tests = [f"rule = {quoted(r['rule'])}"] if r["rule"] else []
        tests += [f"path RLIKE {quoted(r['path_regex'])}"] if r["path_regex"] else []
        tests += [f"{line} RLIKE {quoted(r['line_regex'])}"] if r["line_regex"] else []
        tests += [f"array_contains(within, {quoted(r['within'])})"] if r.get("within") else []
        cases.append(f"WHEN {' AND '.join(tests) or 'true'} THEN {quoted(r['action'])}")
    groups = [F.expr(f"CASE {' '.join(cases[at : at + CASES])} END") for at in range(0, len(cases), CASES)]
    action = F.coalesce(*groups, F.lit("keep"))
    low = F.lit(CONFIDENCE_LEVELS["low"])
    return (
        findings.withColumn("action", action)
        .where("action <> 'drop'")
        .withColumn("confidence", F.when(F.col("action") == "low", F.least("confidence", low)).otherwise(F.col("confidence")))
        .drop("action")
    )


def mask_evidence(findings: DataFrame) -> DataFrame:
    """Hide quoted values in the evidence of secret rules. Wallet rules mask while scanning."""
    shown = F.when(F.col("rule").isin(*MASKED_RULES[:3]), text.mask_secrets(F.col("snippet"))).otherwise(F.col("snippet"))
    return findings.withColumn("snippet", shown)


def hit_context(files: DataFrame, findings: DataFrame, reach: int = 10) -> DataFrame:
    """Lines around the hits of findings made elsewhere: (repo, path, line, first_line, context).

    For hits of the own scan use ``scan_with_context``, which needs no join. Here the hit
    lines of a file are gathered first (no more than the file has lines), so each text
    meets one row.
    """
    wanted = findings.where("line IS NOT NULL").groupBy("repo", "path").agg(F.collect_set("line").alias("hits"))
    split = files.select("repo", "path", "content").join(wanted, ["repo", "path"]).withColumn("ls", text.lines(F.col("content")))
    around = F.expr(
        f"transform(filter(hits, h -> h <= size(ls)), h -> named_struct('line', h, 'first_line', greatest(h - {reach}, 1), "
        f"'context', slice(ls, greatest(h - {reach}, 1), h + {reach} - greatest(h - {reach}, 1) + 1)))"
    )
    return split.select("repo", "path", F.inline(around))
