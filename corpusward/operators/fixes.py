"""Fix planning and checks after fixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- Fixed values: groups by depth of change, and the tolerance of number checks ------
FIX_GROUPS = ("surgical", "migration", "refactor")
TOLERANCE = 0.01

# Default group of a rule; rules not named here are surgical.
DEFAULT_GROUPS = {
    "migration": ("python-print-call", "debug-call", "python-async-blocking-call", "banned-import"),
    "refactor": ("python-float-money", "python-long-function", "python-deep-nesting", "python-magic-number", "duplicate-block"),
}


def group_rank(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in FIX_GROUPS]), group)


def fix_groups(findings: DataFrame, fix_map: DataFrame | None = None) -> DataFrame:
    """Group of every finding; all findings of a file go with the deepest one.

    The deepest group of a file is a maximum with partial sums, joined back by file.
    """
    if fix_map is None:
        own = F.lit("surgical")
        for group, rules in DEFAULT_GROUPS.items():
            own = F.when(F.col("rule").isin(*rules), group).otherwise(own)
        grouped = findings.withColumn("own_group", own)
    else:
        table = fix_map.select("rule", F.col("fix_group").alias("own_group")).dropDuplicates(["rule"])
        grouped = findings.join(table, "rule", "left").withColumn("own_group", F.coalesce("own_group", F.lit("surgical")))
    files = grouped.groupBy(F.col("repo").alias("_repo"), F.col("path").alias("_path")).agg(F.max(group_rank(F.col("own_group"))).cast("int").alias("deepest"))
    same_file = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("path").eqNullSafe(F.col("_path"))
    named = F.element_at(F.array(*[F.lit(g) for g in FIX_GROUPS]), F.col("deepest"))
    return grouped.join(files, same_file).withColumn("fix_group", named).drop("_repo", "_path", "deepest")


def fix_accounting(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Status per finding: handled once, ``missing``, ``repeated``, or ``unknown`` to the plan."""
    plan = planned.groupBy("repo", "finding_id").agg(F.count("*").alias("planned"))
    done = results.groupBy("repo", "finding_id").agg(
        F.count("*").alias("results"),
        F.count_if(F.col("outcome") == "fixed").alias("fixed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )
    status = (
        F.when(F.col("planned").isNull(), "unknown")
        .when(F.col("results").isNull(), "missing")
        .when(F.col("results") > 1, "repeated")
        .when(F.col("fixed") == 1, "fixed")
        .otherwise("skipped")
    )
    return plan.join(done, ["repo", "finding_id"], "full_outer").select("repo", "finding_id", status.alias("status"))


def files_modified(results: DataFrame) -> DataFrame:
    return results.where("outcome = 'fixed'").select("repo", F.col("file").alias("path")).distinct()


def check_summary(checks: DataFrame) -> DataFrame:
    """Totals and verdict per repository: FAIL, PASS_WITH_WARNINGS (skips) or PASS."""
    status = lambda s: F.count_if(F.col("status") == s)
    out = checks.groupBy("repo").agg(
        F.count("*").alias("total_checks"), status("pass").alias("passed"), status("fail").alias("failed"), status("env_skip").alias("env_skipped")
    )
    verdict = F.when(F.col("failed") > 0, "FAIL").when(F.col("env_skipped") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return out.withColumn("verdict", verdict)


def regression_deltas(baseline: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Named values before and after. Numbers may differ by less than the tolerance, texts
    and booleans (given as ``text_value``) not at all; a value on one side only regresses."""
    b = baseline.select("repo", "name", F.col("value").alias("baseline"), F.col("text_value").alias("baseline_text"))
    a = actual.select("repo", "name", F.col("value").alias("actual"), F.col("text_value").alias("actual_text"))
    joined = b.join(a, ["repo", "name"], "full_outer")
    delta = F.abs(F.col("actual") - F.col("baseline"))
    numeric = F.col("baseline").isNotNull() & F.col("actual").isNotNull()
    same = F.when(numeric, delta < tolerance).otherwise(
        F.col("baseline").eqNullSafe(F.col("actual")) & F.col("baseline_text").eqNullSafe(F.col("actual_text"))
    )
    return joined.select("repo", "name", "baseline", "actual", F.when(same, "pass").otherwise("regression").alias("status"))


def public_api(facts: DataFrame) -> DataFrame:
    """Public functions and classes per file with the parameters that have no default.

    Several definitions of one name in a file count together.
    """
    required = "transform(filter(f.params, p -> p.default_kind IS NULL AND p.kind NOT IN ('vararg', 'kwarg') AND p.name NOT IN ('self', 'cls')), p -> p.name)"
    every = "transform(f.params, p -> p.name)"
    items = (
        f"concat(transform(functions, f -> named_struct('name', f.name, 'required', {required}, 'params', {every})), "
        "transform(classes, c -> named_struct('name', c.name, 'required', CAST(array() AS ARRAY<STRING>), 'params', CAST(array() AS ARRAY<STRING>))))"
    )
    rows = facts.where("functions IS NOT NULL").select("repo", "path", F.inline(F.expr(f"filter({items}, i -> NOT startswith(i.name, '_'))")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy("repo", "path", "name").agg(union("required").alias("required"), union("params").alias("params"))


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Public names that are gone, new, or ask for new parameters without a default."""
    key = ["repo", "path", "name"]
    b = public_api(before).select(*key, F.col("params").alias("old_params"))
    a = public_api(after).select(*key, F.col("required").alias("new_required"))
    asked = F.array_except("new_required", "old_params")
    status = (
        F.when(F.col("new_required").isNull(), "removed")
        .when(F.col("old_params").isNull(), "added")
        .when(F.size(asked) > 0, "new_required_parameter")
        .otherwise("compatible")
    )
    detail = F.when(status == "new_required_parameter", F.array_join(asked, ", ")).otherwise("")
    return b.join(a, key, "full_outer").select(*key, status.alias("status"), detail.alias("detail"))


def module_pairs(facts: DataFrame, modified: DataFrame) -> DataFrame:
    """Files that import a modified module: (repo, changed, dependent).

    Leading dots of an import are resolved against the folder of the importing file: one
    dot is that folder, each further dot the one above.
    """
    dotted = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".")
    changed = modified.where(F.col("path").endswith(".py")).select("repo", F.col("path").alias("changed"), dotted.alias("module")).distinct()
    named = "flatten(transform(imports, i -> concat(array(i.module), transform(i.names, n -> concat(i.module, '.', n)))))"
    used = facts.select("repo", F.col("path").alias("dependent"), F.explode(F.array_distinct(F.expr(named))).alias("written"))
    dots = F.length(F.regexp_extract("written", r"^\.*", 0))
    folders = F.slice(F.split("dependent", "/"), F.lit(1), F.greatest(F.size(F.split("dependent", "/")) - dots, F.lit(0)))
    rest = F.regexp_extract("written", r"^\.*(.*)$", 1)
    absolute = F.array_join(F.filter(F.concat(folders, F.array(rest)), lambda part: part != ""), ".")
    used = used.withColumn("module", F.when(dots > 0, absolute).otherwise(F.col("written")))
    return used.join(changed, ["repo", "module"]).where("changed <> dependent").select("repo", "changed", "dependent").distinct()
