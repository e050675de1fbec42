"""Licence scan, on DataFrame functions alone.

Files are (repo, path, content). Their passages are all lines and all paragraphs and, of licence files
(LICENSE, COPYING and the like), the whole text as well. A passage is a sparse TF-IDF vector: counts of its terms
times their idf over all files. A file's own licence is that of the template with the greatest cosine to one of its passages, if that is ``least`` or more;
equal cosines go to the first licence by name. A licence file gives its licence to its directory, the best
of several does. A file without a licence of its own has that of the nearest directory above it which has one.

The files that hold each term are counted for all terms and joined to the terms of passages. A passage whose cosine reaches ``least`` must share one of a template's rarest terms,
as many as leave less than ``least`` to the others. So passages without such a term are dropped before any
of them is split into terms. Directories are joined once each, not per file.

Null repositories, paths and contents are empty strings. Rows equal in all three have the same
answer. Extra columns are kept, whatever their names; contents are not returned. An empty table gives no rows. A very long text is
split into terms passage by passage, and only in passages that may be a notice; its terms are rows, not one list.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.notices import TEMPLATES
from corpusward.session import written

LEAST = 0.7
LICENCE_FILE = r"(?i)^(licen[cs]es?|copying|unlicense)([._-].*)?$"
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def template_terms(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+", text.lower()))


def terms(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_A_TERM), "")


def frequencies(contents: DataFrame) -> DataFrame:
    """term and ``df``, the number of rows that hold it."""
    held = contents.select(F.explode(F.array_distinct(terms(F.lower("content")))).alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("df"))


def weights(found: DataFrame, total: int, templates: tuple[tuple[str, str], ...], least: float) -> tuple[DataFrame, str]:
    """term and its weight in every template; a pattern of the terms a passage needs one of."""
    spark = found.sparkSession
    counted = [template_terms(text) for _, text in templates]
    vocabulary = sorted(set().union(*counted))
    df = {row["term"]: row["df"] for row in found.where(F.col("term").isin(vocabulary)).collect()}  # template terms only
    idf = {term: math.log((1 + total) / (1 + df.get(term, 0))) + 1 for term in vocabulary}
    vectors, needed = [], set()
    for counts in counted:
        raw = {term: n * idf[term] for term, n in counts.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({term: w / length for term, w in raw.items()})
        rest = 1.0
        for term in sorted(raw, key=lambda t: (df.get(t, 0), -raw[t], t)):  # the rarest terms, so that few passages hold one
            if rest < least * least * (1 - 1e-9):
                break
            needed.add(term)
            rest -= vectors[-1][term] ** 2
    rows = [(term, [v.get(term, 0.0) for v in vectors]) for term in vocabulary]
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(needed)) + r")(?![\p{L}\p{N}])"
    return spark.createDataFrame(rows, "term string, shares array<double>"), pattern


def own_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """key, licence, score of the files (key, path, content) that have a licence of their own."""
    found, total = written(frequencies(files), "frequencies"), files.count()
    known, pattern = weights(found, total, templates, least)
    low = F.lower("content")
    likely = files.where(low.rlike(pattern)).select("key", low.alias("text"), is_licence_file(F.col("path")).alias("whole"))
    whole = F.when(F.col("whole"), F.array("text")).otherwise(F.array().cast("array<string>"))
    passages = F.filter(F.array_distinct(F.concat(F.split("text", r"\r\n|\r|\n"), F.split("text", r"\n[ \t\r]*\n"), whole)), lambda p: p.rlike(pattern))
    split = likely.select("key", F.posexplode(passages).alias("passage", "text")).select("key", "passage", F.explode(terms(F.col("text"))).alias("term"))
    counts = split.groupBy("key", "passage", "term").agg(F.count("*").alias("n")).join(found, "term")
    counts = counts.join(F.broadcast(known), "term", "left")  # as small as the templates
    weight = F.col("n") * (F.log(F.lit(1 + total) / (1 + F.col("df"))) + 1)
    dots = [F.sum(weight * F.coalesce(F.col("shares")[k], F.lit(0.0))) for k in range(len(templates))]
    scored = counts.groupBy("key", "passage").agg(F.sqrt(F.sum(weight * weight)).alias("length"), F.array(*dots).alias("dots"))
    names = F.array(*[F.lit(name) for name, _ in templates])
    ranked = F.arrays_zip(F.transform("dots", lambda d: F.round(d / F.col("length"), 6)).alias("score"), names.alias("licence"))
    best = scored.select("key", F.explode(ranked).alias("r")).where(F.col("r.score") >= least)
    order = F.struct(-F.col("r.score"), "r.licence")
    return best.groupBy("key").agg(F.min(order).alias("b")).select("key", F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("score"))


def is_licence_file(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(LICENCE_FILE)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^.*/", 0), "/$", "")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """repo, directory, licence, given_by of each of ``directories`` that has a licensed one at or above it."""
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = directories.select("repo", "directory", F.explode(F.array_distinct(above)).alias("given_by"))
    found = steps.join(licensed, ["repo", "given_by"])
    nearest = F.max_by(F.struct("licence", "given_by"), F.length("given_by")).alias("n")
    return found.groupBy("repo", "directory").agg(nearest).select("repo", "directory", "n.licence", "n.given_by")


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The rows of ``files`` without their content, as a struct ``row``, with own_licence, own_score, licence, given_by.

    ``given_by`` is the directory that an inherited licence comes from.
    """
    clean = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("repo", "path", "content")}
    key = F.md5(F.concat_ws("|", *(F.md5(c) for c in clean.values())))
    named = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "content"]).alias("row"), key.alias("key"), clean["repo"].alias("repo"), clean["path"].alias("path"), clean["content"].alias("content"))
    own = written(own_licences(named.select("key", "path", "content"), templates, least), "licences")
    narrow = named.select("row", "key", "repo", "path", directory(F.col("path")).alias("directory"))
    with_own = narrow.join(own, "key", "left")
    order = F.struct(-F.col("score"), "licence", "path")
    licensed = with_own.where(F.col("licence").isNotNull() & is_licence_file(F.col("path"))).groupBy("repo", "directory").agg(F.min(order).alias("b"))
    licensed = licensed.select("repo", F.col("directory").alias("given_by"), "b.licence")
    lacking = with_own.where(F.col("licence").isNull()).select("repo", "directory").distinct()
    from_above = inherited(lacking, licensed).withColumnsRenamed({"licence": "above"})
    joined = with_own.join(from_above, ["repo", "directory"], "left")
    lacks = F.col("licence").isNull()
    return joined.select("row", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "above").alias("licence"), F.when(lacks, F.col("given_by")).alias("given_by"))
