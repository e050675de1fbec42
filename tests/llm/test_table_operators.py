"""WARC archive, licence scan and top-k search against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from llm_rows import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusward.llm import knn, licences, warc
from corpusward.session import fresh_path

PAGE = "<p>" + "a" * 200
PAGES = [(3, "u3", PAGE), (1, "u1", PAGE), (2, None, PAGE), (1, "u1", PAGE), (4, "u\r\nWARC-Type: x", "é" * 50), (5, "", None), (6, "u6", ""), (7, "u7", "b" * 99), (8, "u8", "b" * 99), (9, "u", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" * 20), (None, "n", PAGE), (None, "n", "c" * 150), (None, None, None), (10, "u", "d" * 300_000), (11, "u", "d" * 300_000)]


def pages(spark, rows=PAGES):
    made = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return made.withColumns({c: F.lit(1) for c in ("digest", "payload", "revisit", "http", "first_page", "headers")})


def slow_archive(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and body in first and i != first[body]
        out.append((str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark):
    got = warc.round_trip(pages(spark)).collect()
    assert sorted(((str(r.page_id), *tuple(r)[1:]) for r in got), key=str) == slow_archive(PAGES)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_records_hold_their_payloads(spark):
    archive = warc.write_archive(pages(spark), fresh_path(spark, "warc"))
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == len({h or "" for _, _, h in PAGES})
    bodies = {r.digest: bytes(r.payload) for r in stored.collect()}
    assert warc.read_archive(spark, archive).count() == len(PAGES)
    for r in warc.read_archive(spark, archive).withColumn("cut", warc.payload_of(F.col("record"))).collect():
        header, http, rest = bytes(r.record).split(b"\r\n\r\n", 2)
        assert header.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        length = int(header.rpartition(b"Content-Length: ")[2])
        assert length == len(http) + 4 + len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        assert rest[:-4] == (bodies[r.digest] if r.record_type == "response" else b"")
        assert r.record_type == "revisit" or bytes(r.cut) == bodies[r.digest]
        assert hashlib.sha256(bodies[r.digest]).hexdigest() == r.digest


def test_damage_is_an_error(spark):
    archive = warc.write_archive(pages(spark), fresh_path(spark, "warc"))
    spark.read.parquet(archive.payloads).withColumn("payload", F.lit(b"other")).write.parquet(archive.payloads + "-2")
    archive.payloads, archive.table = archive.payloads + "-2", None  # as another session reads it
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, archive).collect()


# licences

MIT = "Released under the MIT License."
FILES = [
    ("r", "LICENSE", "Some words.\n" + MIT),
    ("r", "a/b/code.c", "int x;"),
    ("r", "a/b/own.c", "/* Licensed under CC BY-NC 4.0. */\nint x;"),
    ("r", "a/COPYING.txt", "Licensed under the Apache License,\nVersion 2.0.\n\nmore"),
    ("r", "a/b/LICENSE", "no notice at all"),
    ("r", "top.c", None),
    ("r", "top.c", None),
    ("s", "a/b.c", "nothing"),
    ("s", "x/license", MIT),
    ("s", "x/y/z/deep.c", "the license of the version " * 5000),
    ("s", "xy/other.c", ""),
    (None, None, None),
    (None, "f", MIT + " " + "word " * 200),
]


def files(spark, rows=FILES):
    made = spark.createDataFrame(rows, "repo string, path string, content string").repartition(3)
    return made.withColumns({c: F.lit(1) for c in ("key", "licence", "score", "directory", "term", "row")})


def test_licences_of_a_tree(spark):
    got = {(r.row.repo, r.row.path): (r.own_licence, r.licence, r.given_by) for r in licences.scan(files(spark)).collect()}
    assert got[("r", "LICENSE")] == ("MIT", "MIT", None)
    assert got[("r", "a/b/code.c")] == (None, "Apache-2.0", "a")
    assert got[("r", "a/b/own.c")] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)
    assert got[("r", "a/COPYING.txt")] == ("Apache-2.0", "Apache-2.0", None)
    assert got[("r", "top.c")] == (None, "MIT", "")
    assert got[("s", "x/y/z/deep.c")] == (None, "MIT", "x")
    assert got[("s", "a/b.c")] == got[("s", "xy/other.c")] == got[(None, None)] == got[(None, "f")] == (None, None, None)
    assert licences.scan(files(spark)).count() == len(FILES) and licences.scan(files(spark, [])).collect() == []


def test_only_functions_are_used(spark):
    plan = licences.scan(files(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# top k


def vectors(spark, rows, kind="float"):
    made = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return made.withColumns({c: F.lit(1) for c in ("uid", "cell", "asks", "score", "rank")})


def slow_top(rows, k, asks):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i is not None and asks(i):
            scored = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in fine if j is None or j != i))
            out += [(i, n + 1, None if missing else j, -s) for n, (s, missing, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


AWKWARD = [(0, [1.0, 0.5], 1), (50, [0.25, -0.5], 1), (50, [1.0, 1.0], 2), (7, [1.0, 0.5], 1), (8, [1.0, 0.5], 1), (9, [1.0, 0.5], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (100, [], 1), (None, [2.0, 2.0], 1), (11, [1.0], 1), (12, [0.1, 0.2, 0.3], None), (150, [float("-inf")], 1)]


def test_top_k_of_awkward_vectors(spark):
    got = knn.top_k(vectors(spark, AWKWARD), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == slow_top(AWKWARD, 5, lambda i: i % 50 == 0)
    assert knn.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert knn.top_k(vectors(spark, [(0, [1.0], 1)]), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_in_many_cells_and_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * 0.1], 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]  # ties
    got = knn.top_k(vectors(spark, rows, kind), F.col("vec_id") % 7 == 0, k=4)
    assert sorted(map(tuple, got.collect()), key=str) == slow_top(rows, 4, lambda i: i % 7 == 0)


def test_exact_beyond_doubles():
    big = np.array([[2.0**31, 1.0]])
    assert knn.products(big, np.array([[2.0**31, 1.0]]))[0, 0] == 2**62 + 1


# all queries with SQL


@pytest.mark.parametrize("name", ["op2_imatch_fingerprints", "op5_source_mixing", "op7_warc_archive", "op9_licence_scan", "op10_exact_top_k"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_best_fit_packing", "op4_simhash_near_dedup", "op6_language_id", "op8_quality_classifier"])
def test_queries_without_sql_answer_every_document(spark, name):
    rows = entry.queries()[name](spark, SMALL)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
