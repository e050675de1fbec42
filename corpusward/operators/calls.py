"""Who calls what: calls resolved through imports to definitions, and modules reached through imports.

A file's facts hold its imports, definitions and calls, so names are resolved inside one row: an import or a
definition of the file binds the first part of a called name. What is found is the full name of the definition,
``package.module.function`` or ``package.module.Class.method``, which is joined with the definitions of the repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.sqltext import quoted
from corpusward.operators.graphs import reachable
from corpusward.schema import as_findings

REQUIRED = "transform(filter(f.params, p -> p.default_kind IS NULL AND p.kind NOT IN ('vararg', 'kwarg') AND p.name NOT IN ('self', 'cls')), p -> p.name)"


def module_of(path: Column) -> Column:
    """Dotted name of a Python file."""
    return F.regexp_replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/", ".")


def module_names(path: Column) -> Column:
    """The names under which a file can be imported: its dotted path, and that below a ``src`` folder."""
    whole = module_of(path)
    return F.array_distinct(F.array(whole, F.regexp_replace(whole, r"^src\.", "")))


def absolute(module: str) -> str:
    """SQL of a module name without leading dots: one dot is the folder of ``path``, each further one the folder above."""
    dots = f"length(regexp_extract({module}, '^\\\\.*', 0))"
    folders = f"slice(split(path, '/'), 1, greatest(size(split(path, '/')) - {dots}, 0))"
    below = f"array_join(filter(concat({folders}, array(regexp_extract({module}, '^\\\\.*(.*)$', 1))), x -> x <> ''), '.')"
    return f"IF(startswith({module}, '.'), {below}, {module})"


# What the names of a file stand for, later ones after earlier ones: (local, target).
BINDINGS = (
    "concat("
    "transform(functions, f -> named_struct('local', f.qualname, 'target', concat(module, '.', f.qualname))), "
    "transform(classes, c -> named_struct('local', c.name, 'target', concat(module, '.', c.name))), "
    "flatten(transform(imports, i -> IF(size(i.names) = 0, "
    "array(IF(i.aliases[0] = '', named_struct('local', substring_index(i.module, '.', 1), 'target', substring_index(i.module, '.', 1)), named_struct('local', i.aliases[0], 'target', i.module))), "
    f"transform(i.names, (n, k) -> named_struct('local', IF(i.aliases[k] = '', n, i.aliases[k]), 'target', concat({absolute('i.module')}, '.', n)))))))"
)


def definitions(facts: DataFrame) -> DataFrame:
    """Functions and classes: repo, path, target (full name), qualname, line, required, params, returns, returns_none.

    A file below ``src`` gives its definitions under both of its names. Of several definitions of one name the last one counts.
    """
    item = (
        f"concat(transform(functions, f -> named_struct('qualname', f.qualname, 'line', f.line, 'required', {REQUIRED}, 'params', transform(f.params, p -> p.name), "
        "'returns', f.returns, 'returns_none', f.returns_none)), "
        "transform(classes, c -> named_struct('qualname', c.name, 'line', c.line, 'required', CAST(array() AS ARRAY<STRING>), 'params', CAST(array() AS ARRAY<STRING>), "
        "'returns', CAST(NULL AS STRING), 'returns_none', false)))"
    )
    rows = facts.where("functions IS NOT NULL").select("repo", "path", F.explode(module_names(F.col("path"))).alias("module"), F.expr(item).alias("items"))
    rows = rows.select("repo", "path", "module", F.explode("items").alias("i"))
    last = rows.groupBy("repo", "path", F.concat("module", F.lit("."), "i.qualname").alias("target")).agg(F.max_by("i", "i.line").alias("i"))
    return last.select("repo", "path", "target", "i.*")


def resolved_calls(facts: DataFrame) -> DataFrame:
    """Calls of names that the file binds: repo, path, scope, line, target, result_use, result_name, reads, tested.

    ``self.method`` inside a class is its method. ``reads`` and ``tested`` are those of the calling function.
    """
    known = facts.where("calls IS NOT NULL").withColumn("module", module_of(F.col("path")))
    known = known.withColumn("bindings", F.expr(BINDINGS))
    rows = known.select("repo", "path", "module", "bindings", "functions", F.explode("calls").alias("c"))
    first = "substring_index(c.qualified, '.', 1)"
    rest = "substring(c.qualified, length(substring_index(c.qualified, '.', 1)) + 1)"
    bound = f"try_element_at(filter(bindings, b -> b.local = {first}), -1).target"
    owner = "array_join(slice(split(c.scope, '[.]'), 1, size(split(c.scope, '[.]')) - 1), '.')"
    own = f"IF({first} = 'self' AND contains(c.scope, '.'), concat(module, '.', {owner}, {rest}), concat({bound}, {rest}))"
    caller = "try_element_at(filter(functions, f -> f.qualname = c.scope), -1)"
    found = rows.select(
        "repo", "path", "c.scope", "c.line", F.expr(own).alias("target"), "c.result_use", "c.result_name",
        F.expr(f"{caller}.reads").alias("reads"), F.expr(f"{caller}.tested").alias("tested"),
    )
    return found.where("target IS NOT NULL")


def call_graph(facts: DataFrame) -> DataFrame:
    """Edges from callers to definitions of the same repository: (repo, path, scope, line, target, defined_in)."""
    known = definitions(facts).select("repo", "target", F.col("path").alias("defined_in"))
    return resolved_calls(facts).select("repo", "path", "scope", "line", "target").join(known, ["repo", "target"])


def changed_definitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, target, change): ``removed``, ``new_required_parameter`` or ``return_type`` of public definitions.

    A result type that is added where none was written is no change.
    """
    key = ["repo", "path", "target"]
    private = F.col("qualname").rlike(r"(^|\.)_")
    b = definitions(before).where(~private).select(*key, F.col("params").alias("old_params"), F.col("returns").alias("old_returns"), F.lit(True).alias("was"))
    a = definitions(after).select(*key, "required", "returns", F.lit(True).alias("is"))
    change = (
        F.when(F.col("is").isNull(), "removed")
        .when(F.size(F.array_except("required", "old_params")) > 0, "new_required_parameter")
        .when(F.col("old_returns").isNotNull() & ~F.col("old_returns").eqNullSafe(F.col("returns")), "return_type")
    )
    return b.join(a, key, "left").select(*key, change.alias("change")).where("change IS NOT NULL")


def callers_of_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Calls in ``after`` of what changed: repo, changed (path), target, change, path, scope, line."""
    changed = changed_definitions(before, after).withColumnRenamed("path", "changed")
    calls = resolved_calls(after).select("repo", "target", "path", "scope", "line")
    return calls.join(changed, ["repo", "target"]).select("repo", "changed", "target", "change", "path", "scope", "line")


def unchecked_none(facts: DataFrame) -> DataFrame:
    """Calls of functions that may return None whose result is used at once, or named and used in a function that never tests the name."""
    may = definitions(facts).where("returns_none").select("repo", "target").distinct()
    at_once = F.col("result_use").isin("attribute", "subscript")
    untested = (F.col("result_use") == "assigned") & F.array_contains("reads", F.col("result_name")) & ~F.array_contains("tested", F.col("result_name"))
    used = resolved_calls(facts).where(at_once | F.coalesce(untested, F.lit(False)))
    rows = used.join(may, ["repo", "target"], "left_semi")
    none = F.lit(None).cast("string")
    return as_findings(rows.select("repo", "path", F.lit("unchecked-none-result").alias("rule"), "line", F.col("target").alias("snippet"), none.alias("error")))


def import_edges(facts: DataFrame) -> DataFrame:
    """(repo, source, target): the path of a module and the path of a file that imports it or a name from it."""
    wanted = f"flatten(transform(imports, i -> concat(array({absolute('i.module')}), transform(i.names, n -> concat({absolute('i.module')}, {quoted('.')}, n)))))"
    used = facts.select("repo", F.col("path").alias("target"), F.explode(F.array_distinct(F.expr(wanted))).alias("module"))
    known = facts.select("repo", F.col("path").alias("source"), F.explode(module_names(F.col("path"))).alias("module"))
    return used.join(known, ["repo", "module"]).where("source <> target").select("repo", "source", "target").distinct()


def dependents(facts: DataFrame, modified: DataFrame) -> DataFrame:
    """Every file that a modified one reaches through imports: (repo, changed, dependent, distance); a ring may lead back to no row of its own."""
    starts = modified.where(F.col("path").endswith(".py")).select("repo", F.col("path").alias("start"))
    found = reachable(import_edges(facts), starts)
    return found.where("distance > 0").select("repo", F.col("start").alias("changed"), F.col("node").alias("dependent"), "distance")
