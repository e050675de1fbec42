"""Counts and report tables over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusward.catalog import (
    BLOCKED,
    CATEGORIES,
    CLEANUP_RULES,
    REVIEW_THRESHOLD,
    SCANNERS,
    TECH_DEBT_RULES,
    category_table,
    scanner_table,
)
from corpusward.operators.inventory import skip_reason
from corpusward.operators.repo_rules import GATE_FILE, any_file
from corpusward.operators.verdict import CODE, stops_release
from corpusward.schema import category_rank, report_order, severity_rank
from corpusward.session import written


def finding_summary(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Counts per repository by rule, by severity, by category and in total.

    The grouping sets are expanded on aggregated cells, not on findings. ``repos`` adds a
    total of 0 for repositories without findings.
    """
    cells = findings.groupBy("repo", "rule", "severity", "category").agg(F.count("*").alias("n"))
    named = cells.select(
        "repo",
        F.coalesce("rule", F.lit("unknown")).alias("rule"),
        F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.coalesce("category", F.lit("Uncategorized")).alias("category"),
        "n",
    )
    sets = named.groupingSets([["repo", "rule"], ["repo", "severity"], ["repo", "category"], ["repo"]], "repo", "rule", "severity", "category")
    out = sets.agg(F.sum("n").alias("count"), F.grouping_id().alias("g")).select(
        "repo",
        # bits of the grouping id: repo, rule, severity, category; a set bit is a column left out
        F.expr("CASE g WHEN 3 THEN 'rule' WHEN 5 THEN 'severity' WHEN 6 THEN 'category' ELSE 'total' END").alias("dimension"),
        F.coalesce("rule", "severity", "category", F.lit("total")).alias("name"),
        "count",
    )
    if repos is None:
        return out
    clean = repos.select("repo").distinct().join(findings.select("repo").distinct(), "repo", "left_anti")
    return out.unionByName(clean.select("repo", F.lit("total").alias("dimension"), F.lit("total").alias("name"), F.lit(0).cast("long").alias("count")))


def summary_maps(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """The same counts as one row per repository with maps; their keys are rules and enums."""
    rows = finding_summary(findings, repos)

    def counts(dimension: str) -> Column:
        entries = F.collect_list(F.when(F.col("dimension") == dimension, F.struct("name", "count")))
        return F.map_from_entries(entries).alias(f"by_{dimension}")

    total = F.sum(F.when(F.col("dimension") == "total", F.col("count"))).alias("total")
    return rows.groupBy("repo").agg(total, counts("rule"), counts("severity"), counts("category"))


def rule_in(names: tuple[str, ...]) -> Column:
    return F.col("rule").isin(*names)


def coverage(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files and findings per repository. Reads only the paths of the files."""
    reviewed = skip_reason(F.col("path")).isNull()
    of_files = files.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        F.count_if(reviewed).alias("reviewed_files"),
        F.count_if(~reviewed).alias("skipped_files"),
    )
    of_findings = findings.groupBy("repo").agg(
        F.count("*").alias("finding_count"),
        F.count_if(F.col("kind") == "blocked").alias("blocked_count"),
        F.count_if(rule_in(TECH_DEBT_RULES)).alias("tech_debt_count"),
        F.count_if(rule_in(CLEANUP_RULES)).alias("cleanup_count"),
    )
    return of_files.join(of_findings, "repo", "left").fillna(0)  # one row per repository on both sides


def section_counts(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Count of every report category per repository; an empty section gives 0.

    The categories are a fixed list, so they are laid out inside the aggregate. ``repos``
    adds repositories without findings, all of whose sections are empty.
    """
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    wide = findings.groupBy("repo").agg(*counts)
    if repos is not None:
        wide = repos.select("repo").distinct().join(wide, "repo", "left").fillna(0)
    cells = F.array(*[F.struct(F.lit(n).alias("category_rank"), F.lit(c).alias("category"), F.col(f"`{c}`").alias("count")) for n, c in enumerate(CATEGORIES)])
    return wide.select("repo", F.inline(cells)).withColumn(
        "note", F.when(F.col("count") == 0, "nothing found").otherwise("")
    )


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings of the report categories with the ranks that order the sections."""
    ranked = findings.join(F.broadcast(category_table(findings.sparkSession)), "category")  # eight rows
    return ranked.select(*findings.columns, "category_rank", severity_rank().alias("severity_rank"), *report_order()[:1])


def numbered(findings: DataFrame, group: list[Column], order: list[Column], name: str = "number") -> DataFrame:
    """Consecutive numbers within each group, also for a group too large for one task.

    Rows are put in order by range, so a big group covers many partitions. The partition
    number is written down with the rows; a small table of counts per group and partition
    (at most one row per group and partition) then gives every partition its start.
    """
    spark = findings.sparkSession
    keys = [g.alias(f"_g{n}") for n, g in enumerate(group)]
    sorts = [o.alias(f"_o{n}") for n, o in enumerate(order)]
    names = [f"_g{n}" for n in range(len(group))]
    sort_names = [f"_o{n}" for n in range(len(order))]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = findings.select("*", *keys, *sorts).repartitionByRange(partitions, *names, *sort_names)
    placed = written(placed.withColumn("_part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*names, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*names, "_part").orderBy(*sort_names)
    return (
        placed.withColumn("_row", F.row_number().over(within))
        .join(starts, [*names, "_part"])
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .select(*findings.columns, name)
    )


def with_display_ids(findings: DataFrame) -> DataFrame:
    """Running ids such as ``P1-3`` per repository and severity; ``?-1`` for low confidence."""
    sure = F.coalesce("confidence", F.lit(1.0)) >= REVIEW_THRESHOLD
    bucket = F.when(sure, F.col("severity")).otherwise("?")
    path, line, rule, evidence = F.col("path"), F.coalesce("line", F.lit(0)), F.col("rule"), F.coalesce("snippet", F.lit(""))
    out = numbered(findings, [F.col("repo"), bucket], [category_rank(), path, line, rule, evidence])
    return out.withColumn("display_id", F.concat(bucket, F.lit("-"), F.col("number").cast("string")))


def header_rows(files: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """Report header: date, verdict, files and counts by severity; low confidence left out."""
    sure = F.coalesce("confidence", F.lit(1.0)) >= REVIEW_THRESHOLD
    levels = [F.count_if(sure & (F.col("severity") == s)).alias(f"{s.lower()}_count") for s in ("P0", "P1", "P2", "P3")]
    of_findings = findings.groupBy("repo").agg(F.count_if(stops_release(CODE)).alias("stops"), *levels)
    of_files = coverage(files, findings).select("repo", "total_files", "reviewed_files", "skipped_files", "blocked_count")
    joined = of_files.join(of_findings, "repo", "left").fillna(0)
    return joined.select(
        "repo",
        F.lit(as_of).alias("report_date"),
        F.when(F.col("stops") > 0, "NO-GO").otherwise("GO").alias("verdict"),
        *of_files.columns[1:],
        *[f"p{n}_count" for n in range(4)],
    )


def coverage_gaps(files: DataFrame, reviewed: DataFrame, findings: DataFrame) -> DataFrame:
    """Files due for review that were neither reviewed nor reported as blocked."""
    due = files.select("repo", "path").where(skip_reason(F.col("path")).isNull())
    seen = reviewed.select("repo", "path").unionByName(
        findings.where((F.col("kind") == "blocked") | (F.col("category") == BLOCKED)).select("repo", "path")
    )
    return due.join(seen.distinct(), ["repo", "path"], "left_anti")


# The steps of a run, in order, besides the scanners.
RUN_STEPS = ("inventory",) + tuple(s for s, _ in SCANNERS if s not in ("structure_scan", "checklist_scan")) + ("comparison", "verdict")


def verification_record(files: DataFrame, history_source: DataFrame | None = None) -> DataFrame:
    """Checks that ran per repository (structure only behind its gate) and the history used."""
    gate = files.groupBy("repo").agg(any_file(F.col("path") == GATE_FILE).alias("gate"))
    steps = F.array(*[F.lit(s) for s in RUN_STEPS])
    out = gate.select("repo", F.when(F.col("gate"), F.array_append(steps, "structure_scan")).otherwise(steps).alias("checks_run"))
    if history_source is None:
        return out.withColumn("history_source", F.lit(None).cast("string"))
    return out.join(history_source.select("repo", F.col("run_id").alias("history_source")), "repo", "left")


def scanner_routing(findings: DataFrame) -> DataFrame:
    """Findings with the reviewer group that gets them."""
    return findings.join(F.broadcast(scanner_table(findings.sparkSession)), "scanner")  # one row per scanner
