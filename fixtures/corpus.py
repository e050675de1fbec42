"""The derived corpus as a DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.tables import dimension
from corpusward.functions.text import LINE_BREAK
from fixtures.templates import SECOND_PATHS, SECOND_TID, TEMPLATES, TEXT_PATHS, TEXT_TID, TIDY_FILES, TIDY_TID

SCHEMA = pa.schema(
    [("tid", pa.int64()), ("path_tpl", pa.string()), ("modulus", pa.int64()), ("residues", pa.list_(pa.int64())), ("kind", pa.string()), ("body", pa.string())]
)


def template_table(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    rows = [
        {"tid": tid, "path_tpl": path, "modulus": active[0], "residues": list(active[1]), "kind": kind, "body": body}
        for tid, path, active, kind, body in templates
    ]
    return dimension(spark, rows, SCHEMA)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def places(paths: dict[int, str]) -> Column:
    """The path for a document whose number has one of these remainders by five; null for others."""
    number = F.col("doc_id").cast("string")
    options = [F.when(F.col("doc_id") % 5 == n, F.replace(F.lit(path), F.lit("{id}"), number)) for n, path in paths.items()]
    return F.coalesce(*options)


def corpus(spark: SparkSession, sf_dir: str, templates: tuple = TEMPLATES) -> DataFrame:
    """Files (repo, repo_no, doc_id, tid, path, content) made of all documents.

    Every document gives a file with its whole text, some give a second copy where scans skip or read remarks alone, and
    each gives its template's file where the template is active in its repository. Some give a small tidy repository besides.

    A document is first laid out as numbers of files; path and content are computed from them, so that a query
    that looks at paths alone reads no text.
    """
    per_repo = len(templates)
    table = F.broadcast(template_table(spark, templates))  # one row per template
    number, repo_no = F.col("doc_id"), F.floor(F.col("doc_id") / per_repo)
    docs = documents(spark, sf_dir).select("doc_id", "text", repo_no.alias("repo_no"), (number % per_repo).alias("tid")).join(table, "tid")
    slots = [
        F.when(F.array_contains("residues", F.col("repo_no") % F.col("modulus")), F.lit(0)),
        F.lit(1),
        F.when((number % 5).isin(*SECOND_PATHS), F.lit(2)),
        *[F.when(number % every == 7, F.lit(3 + n)) for n, (_, _, every) in enumerate(TIDY_FILES)],
    ]
    laid = docs.select("*", F.explode(F.array_compact(F.array(*slots))).alias("slot"))
    slot, text = F.col("slot"), F.col("text")
    first, second = places(dict(enumerate(TEXT_PATHS))), places(SECOND_PATHS)
    commented = F.concat(F.lit("# "), F.regexp_replace(text, LINE_BREAK, "\n# "))
    tidy = lambda k, of: [(slot == 3 + n, of(row[k])) for n, row in enumerate(TIDY_FILES)]
    choose = lambda cases: F.coalesce(*[F.when(test, value) for test, value in cases])
    templated = F.when(F.col("kind") == "text", F.concat("body", F.lit("\n"), text)).otherwise(F.col("body"))
    path = [(slot == 0, F.replace("path_tpl", F.lit("{id}"), number.cast("string"))), (slot == 1, first), (slot == 2, second), *tidy(0, F.lit)]
    content = [(slot == 0, templated), (slot == 1, text), (slot == 2, F.when(second.endswith(".py"), commented).otherwise(text))]
    content += tidy(1, lambda body: text if body is None else F.lit(body))
    tid = [(slot == 0, F.col("tid")), (slot == 1, number % 5 + TEXT_TID), (slot == 2, number % 5 + SECOND_TID), (slot > 2, slot - 3 + TIDY_TID)]
    return laid.select(
        F.when(slot > 2, F.concat(F.lit("t"), number.cast("string"))).otherwise(F.concat(F.lit("r"), F.col("repo_no").cast("string"))).alias("repo"),
        "repo_no",
        "doc_id",
        choose([(test, value.cast("long")) for test, value in tid]).alias("tid"),
        choose(path).alias("path"),
        choose(content).alias("content"),
    )
