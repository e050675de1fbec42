"""Weights of the words around a licence notice."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from corpusward.llm import licences


def test_common_words_beside_a_notice_weigh_little(spark):
    header = "As it was then, all of this was released under the MIT License."
    texts = ["all of it was then as this is"] * 100 + [header]
    made = [("r", f"{n}.txt", text) for n, text in enumerate(texts)]
    got = {r.row.path: (r.own_licence, r.own_score) for r in licences.scan(spark.createDataFrame(made, "repo string, path string, content string")).collect()}

    split = [Counter(re.findall(r"[^\W_]+", text.lower())) for text in texts]
    idf = lambda term: math.log((1 + len(texts)) / (1 + sum(term in held for held in split))) + 1
    a, b = ({t: n * idf(t) for t, n in counts.items()} for counts in (split[-1], Counter("released under the mit license".split())))
    length = lambda v: math.sqrt(sum(w * w for w in v.values()))
    want = sum(w * b.get(t, 0) for t, w in a.items()) / length(a) / length(b)
    assert got["100.txt"] == ("MIT", pytest.approx(want, abs=2e-6)) and want > 0.9
    assert got["0.txt"] == (None, None)


@pytest.mark.parametrize("before, after", [("", ""), ("Copyright (c) 2020 The authors.\n\n", "\n\nEnd of file."), ("/*\n * ", "\n */\nint x;")])
def test_every_notice_is_its_own_licence(spark, before, after):
    """Statements, headers, paragraphs, whole texts and SPDX lines, each among all the others."""
    made = [(f"r{n}", "src/a.c", before + text + after) for n, (_, text) in enumerate(licences.TEMPLATES)]
    made += [(f"f{n}", "LICENSE", before + text + after) for n, (_, text) in enumerate(licences.TEMPLATES)]
    got = {r.row.repo: r.own_licence for r in licences.scan(spark.createDataFrame(made, "repo string, path string, content string")).collect()}
    assert got == {f"{kind}{n}": name for kind in "rf" for n, (name, _) in enumerate(licences.TEMPLATES)}


def test_sql_counts_the_words_beside_a_notice_too(spark, tmp_path):
    """A table in which words without a template are frequent, so that their true weight decides."""
    import duckdb

    from corpusward.llm import sql
    from corpusward.llm.queries import QUERIES

    header = "As it was then, all of this was released under the MIT License."
    rows = [(n, header if n % 9 == 4 else "all of it was then as this is so", "en", "a") for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, db.execute(sql.OP9).fetchall()))
    got = QUERIES["op9_licence_scan"](spark, str(tmp_path)).select("doc_id", "path", "own_licence", "own_score", "licence", "given_by").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert all(r.own_licence == "MIT" for r in got if r.doc_id % 9 == 4)
