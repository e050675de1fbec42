"""Nested results before and after a change, compared leaf by leaf.

A result is JSON. It is parsed into a VARIANT once and taken apart level by level: objects and arrays give a row
for each member, everything else is a leaf with its path, such as ``$.totals[2].fee``. The
number of passes is the depth of the deepest result, whatever their number and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.operators.fixes import TOLERANCE
from corpusward.session import written

PLAIN_NAME = r"^[A-Za-z_][A-Za-z0-9_]*\z"
KEY = ["repo", "name", "path"]


def member(key: Column) -> Column:
    """Step into an object: ``.key``, or ``["key"]`` for a key that is not a plain name."""
    escaped = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(key.rlike(PLAIN_NAME), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('["'), escaped, F.lit('"]')))


def members(value: str = "v") -> Column:
    """Array of (step, v) of an object or array; null for a leaf, empty containers included."""
    fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(member(e["key"]).alias("step"), e["value"].alias("v")))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, n: F.struct(F.concat(F.lit("["), n.cast("string"), F.lit("]")).alias("step"), v.alias("v")))
    kind = F.schema_of_variant(value)
    found = F.when(kind.startswith("OBJECT<"), fields).when(kind.startswith("ARRAY<"), items)
    return F.when(F.size(found) > 0, found)


def leaf_kind(value: str = "v") -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT<"), "object")
        .when(kind.startswith("ARRAY<"), "array")
        .when(kind == "STRING", "text")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def leaves(results: DataFrame) -> DataFrame:
    """(repo, name, path, kind, number, text) of every leaf of ``results`` (repo, name, value as JSON).

    ``kind`` is number, text, boolean, null, or object or array for an empty one. A value that is no JSON is a
    leaf of kind ``unreadable``, a null value one of kind ``null``. Equal (repo, name) twice give their leaves twice.
    """
    parsed = F.try_parse_json(F.coalesce("value", F.lit("null")))
    level = results.select("repo", "name", F.lit("$").alias("path"), parsed.alias("v"), "value")
    unreadable = level.where("v IS NULL").select(*KEY, F.lit("unreadable").alias("kind"), F.lit(None).cast("double").alias("number"), F.col("value").alias("text"))
    level, found = level.where("v IS NOT NULL").select(*KEY, "v"), unreadable
    while True:
        level = written(level.withColumn("members", members()), "level")
        ends = level.where("members IS NULL").withColumn("kind", leaf_kind())
        number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
        shown = F.when(F.col("kind").isin("text", "boolean"), F.try_variant_get("v", "$", "string"))
        found = found.unionByName(ends.select(*KEY, "kind", number.alias("number"), shown.alias("text")))
        inner = level.where("members IS NOT NULL")
        if inner.isEmpty():
            return found
        level = inner.select("repo", "name", "path", F.inline("members")).select("repo", "name", F.concat("path", "step").alias("path"), "v")


def leaf_deltas(baseline: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every leaf on either side: ``pass``, ``regression``, ``missing`` (only before) or ``extra`` (only after).

    Numbers may differ by less than the tolerance at any depth, other leaves not at all; another kind of value is a
    regression. Where a leaf stood before and a container stands now, the leaf is missing and the new ones are extra.
    """
    sides = [leaves(side).select(*KEY, F.struct("kind", "number", "text").alias(name)) for side, name in ((baseline, "b"), (actual, "a"))]
    both = sides[0].join(sides[1], KEY, "full_outer")
    numbers = (F.col("b.kind") == "number") & (F.col("a.kind") == "number")
    close = F.abs(F.col("a.number") - F.col("b.number")) < tolerance
    same = F.when(numbers, F.coalesce(close, F.col("a.number").eqNullSafe(F.col("b.number")))).otherwise((F.col("a.kind") == F.col("b.kind")) & F.col("a.text").eqNullSafe(F.col("b.text")))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(same, "pass").otherwise("regression")
    return both.select(*KEY, F.col("b.number").alias("baseline"), F.col("a.number").alias("actual"), status.alias("status"))


def nested_verdicts(deltas: DataFrame) -> DataFrame:
    """One row per result: its leaves, those that differ, and ``pass`` or ``regression``."""
    rows = deltas.groupBy("repo", "name").agg(F.count("*").alias("leaves"), F.count_if(F.col("status") != "pass").alias("differing"))
    return rows.withColumn("status", F.when(F.col("differing") > 0, "regression").otherwise("pass"))
