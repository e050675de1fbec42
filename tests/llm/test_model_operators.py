"""Language ID, quality, mixing and the pipeline against brute force, on awkward rows and on given ones."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_rows import DOCS, SMALL, docs, documents, no_docs  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from corpusward.llm import langid, mixing, quality, sql
from corpusward.llm.samples import sample

MIDDLE = "/root/testdata/sf0.01"


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


# language ID


def slow_grams(text):
    words, word = [], ""
    for c in (text or "").lower():
        if c.isalpha():
            word += c
        elif word:
            words, word = [*words, word], ""
    words += [word] if word else []
    joined = " " + " ".join(words) + " " if words else ""
    grams = Counter(c for c in joined if c != " ")
    grams.update(joined[k : k + 2] for k in range(len(joined) - 1))
    grams.update(joined[k : k + 3] for k in range(len(joined) - 2) if joined[k + 1] != " ")
    return grams


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def ranked(grams, most):
    return sorted((code(g) for g in grams), key=lambda c: (-by_code(grams)[c], c))[:most]


def by_code(grams):
    return {code(g): n for g, n in grams.items()}


def slow_guess(text, profiles, length, most):
    counts = by_code(slow_grams(text))
    own = sorted(counts, key=lambda c: (-counts[c], c))[:most]
    if not own or not profiles:
        return "und", 0.0
    distance = {}
    for language in sorted(profiles):
        rank = {c: k for k, c in enumerate(profiles[language])}
        distance[language] = sum(min(abs(rank[c] - k), length) if c in rank else length for k, c in enumerate(own))
    best = min(distance, key=lambda x: (distance[x], x))
    return best, 1 - distance[best] / (len(own) * length)


@pytest.mark.parametrize("awkward", [True, False])
def test_language_id_equals_brute_force(spark, docs, awkward):
    rows = docs if awkward else spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    given = [(r.doc_id, r.text, r.lang) for r in rows.collect()]
    totals: dict[str, Counter] = {}
    for doc_id, text, lang in given:
        if lang is not None and text is not None and not is_held_out(doc_id):
            totals.setdefault(lang, Counter()).update(by_code(slow_grams(text)))
    want = {lang: sorted(c, key=lambda x: (-c[x], x))[:60] for lang, c in totals.items() if c}
    profiles = langid.learn(rows, length=60)
    assert profiles == want
    got = langid.predict(rows, profiles, length=60, text_grams=40).collect()
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(
        (str(i), is_held_out(i), lang, round(s, 9)) for i, t, _ in given for lang, s in [slow_guess(t, want, 60, 40)]
    )


def test_long_text_in_blocks(monkeypatch):
    letter = langid.letters()
    whole = langid.grams("Ab, cd é 漢 " * 50, letter)
    monkeypatch.setattr(langid, "BLOCK", 37)
    cut = langid.grams("Ab, cd é 漢 " * 50, letter)
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_language_id_of_unseen_documents(spark):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = langid.predict(rows, langid.learn(rows)).join(rows.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_id_without_labels(spark, docs, no_docs):
    assert langid.learn(no_docs) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(no_docs, langid.learn(docs)).collect() == []


def test_rejected_languages(spark, docs):
    profiles = langid.learn(docs)
    kept = langid.recognised(docs, profiles)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {2, 3, 4, 10}.isdisjoint(ids) and {1, 6, None} <= ids


def test_samples_are_bounded_and_stable(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("lang"), F.lit(0).alias("_rank"))
    first = sorted(map(tuple, sample(rows, "lang", 30).collect()))
    assert all(10 <= n <= 50 for n in Counter(x[1] for x in first).values()) and len({x[1] for x in first}) == 2
    assert len(sample(rows.unionByName(rows), "lang", 10_000).collect()) == 2000
    assert first == sorted(map(tuple, sample(rows.repartition(7), "lang", 30).collect()))


# quality


def test_quality_of_unseen_documents(spark):
    rows, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = quality.classify(rows, quality.learn(rows, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97


def test_score_is_the_dot_product_of_hashed_features(spark, docs):
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.3)

    def slow(text):
        counts = Counter()
        words = quality.WORD.findall((text or "").lower())
        hashed = [zlib.crc32(w.encode()) + 1 for w in words]
        for h in hashed:
            counts[h * int(quality.PAIR) % (1 << 64) >> 64 - quality.BITS] += 1
        for a, b in zip(hashed, hashed[1:]):
            pair = 0 if a == b else (a * int(quality.PAIR) + b) % (1 << 64)
            counts[pair * int(quality.PAIR) % (1 << 64) >> 64 - quality.BITS] += 1
        for a, b in zip(hashed, hashed[2:]):
            if a == b:
                counts[int(quality.BACK) * int(quality.PAIR) % (1 << 64) >> 64 - quality.BITS] += 1
        length = math.sqrt(sum(n * n for n in counts.values()))
        total = sum(np.float32(model.weights[p]) * n / length for p, n in counts.items()) + model.intercept
        return 1 / (1 + math.exp(-total))

    got = quality.classify(docs, model).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 5), r.predicted) for r in got) == sorted((str(i), is_held_out(i), round(slow(t), 5), int(slow(t) >= 0.7)) for i, t, *_ in DOCS)


def slow_values(text):
    """Places and values of a text's features, one by one."""
    hashed = [zlib.crc32(w.encode()) + 1 for w in quality.WORD.findall((text or "").lower())]
    keys = hashed + [0 if a == b else (a * int(quality.PAIR) + b) % 2**64 for a, b in zip(hashed, hashed[1:])]
    keys += [int(quality.BACK) for a, b in zip(hashed, hashed[2:]) if a == b]
    counts = Counter(k * int(quality.PAIR) % 2**64 >> 64 - quality.BITS for k in keys)
    length = math.sqrt(sum(n * n for n in counts.values()))
    return {p: n / length for p, n in counts.items()}


def slow_training(examples):
    """Follow-the-regularised-leader, a coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(p):
        if abs(z[p]) <= quality.L1:
            return 0.0
        return -(z[p] - math.copysign(quality.L1, z[p])) / ((quality.BETA + math.sqrt(n[p])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            label, values = examples[k]
            own = {p: weight(p) for p in values}
            error = 1 / (1 + math.exp(-sum(own[p] * v for p, v in values.items()))) - label
            for p, v in values.items():
                slope = error * v
                z[p] += slope - (math.sqrt(n[p] + slope * slope) - math.sqrt(n[p])) / quality.ALPHA * own[p]
                n[p] += slope * slope
    return {p: weight(p) for p in z}


def test_training_equals_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and not is_held_out(r.doc_id) and r.doc_id in rows)
    shards = {}
    for doc_id, label in known:
        shards.setdefault(zlib.crc32(b"%d" % doc_id) // 4 % quality.SHARDS, []).append((label, slow_values(rows[doc_id])))
    wanted = np.zeros(1 << quality.BITS)
    for examples in shards.values():
        for p, w in slow_training(examples).items():
            wanted[p] += w * len(examples) / len(known)
    repeated = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.learn(repeated.unionByName(repeated).withColumn("quality", F.lit(3)), labels)
    assert np.allclose(model.weights, wanted, atol=1e-9)
    good = sum(label for _, label in known)
    assert model.intercept == pytest.approx(math.log(good / (len(known) - good)))


def test_training_separates_and_stops_at_the_prior(spark, docs, no_docs):
    rows = documents(spark, [(i, "good plain words here" if i % 3 else "### $$$ ###", "en", "a") for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None, 1) for i in range(200)] + [(7, None, None, 1), (None, 1, None, 1)], "doc_id long, quality int, toxic int, score int")
    model = quality.learn(rows, labels)
    kept = quality.good(rows, model)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in range(200) if i % 3}
    one_sided = quality.learn(rows, labels.where("quality = 1"))
    assert quality.text_score("anything", one_sided.weights, one_sided.intercept) > 0.9
    nothing = quality.learn(no_docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.classify(docs, nothing).collect()} == {0.5}
    assert quality.classify(no_docs, model).collect() == []


# mixing


def test_mixing_equals_sql(spark, docs):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    db = duckdb.connect()
    db.register("given", table)
    db.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT doc_id, text, lang, source FROM given")
    want = sorted(db.execute(sql.OP5).fetchall(), key=str)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want


def test_targets_fill_small_sources_first(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5), ("e", 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    total, weight = 1115, {"a": 5, "b": 2, "c": 1, "e": 5, None: 2}
    assert got["e"] == (0, 0) and got["a"] == (10, 30) and got[None] == (5, 15)
    assert got["c"][1] == pytest.approx(300) and got["b"][1] == pytest.approx(total - 30 - 15 - 300)
    assert sum(t for _, t in got.values()) == pytest.approx(total)


def test_mixed_rows_are_what_is_taken(spark, docs, no_docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[str(r.doc_id)] = taken.get(str(r.doc_id), 0) + r.taken
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    got = {}
    for r in rows.collect():
        assert r.n_chars == len(r.text)
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + len(r.text.encode().split())
    assert got == {i: n for i, n in taken.items() if n}
    assert mixing.mix(no_docs).collect() == [] == mixing.mixed(no_docs).collect()


def test_mixing_does_not_depend_on_partitions(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(map(tuple, mixing.mix(rows).collect())) == sorted(map(tuple, mixing.mix(rows.repartition(5)).collect()))


# pipeline


def test_stages_on_awkward_rows(spark, docs, no_docs):
    for given in (docs, no_docs):
        rows = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, SMALL)
            assert out.columns == given.columns or k == 4
            alone = stage(spark, given, SMALL)
            assert alone.count() >= 0
            rows = out if k < 4 else rows
        assert len(out.columns) == 7


def test_pipeline_equals_brute_force(spark):
    """Every stage recomputed in plain Python from its own input, whose models are taken from the stage."""
    from test_text_operators import slow_components, slow_fingerprint, wanted_pieces

    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    given = [tuple(r) for r in rows.collect()]
    profiles = langid.learn(rows)
    kept = [r for r in given if (g := slow_guess(r[1], profiles, langid.LANGUAGE_GRAMS, langid.TEXT_GRAMS))[0] != "und" and g[1] >= langid.MIN_SCORE]
    docs = spark.createDataFrame(kept, rows.schema)
    model = quality.learn(docs, labels)
    kept = [r for r in kept if quality.text_score(r[1], model.weights.astype(np.float32), model.intercept) >= quality.GOOD]
    groups = slow_components([(r[0], slow_fingerprint(r[1])) for r in kept])
    kept = [r for r in kept if r[0] in set(groups.values())]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in kept])
    texts = {r[0]: r[1] for r in kept}
    mixed = []
    for doc_id, size, _, _, taken in db.execute(sql.OP5).fetchall():
        mixed += [(doc_id, texts[doc_id])] * (taken // size if size else 0)
        if size and taken % size:
            words = texts[doc_id].encode().split()[: taken % size]
            end, at = 0, 0
            for word in words:
                at = texts[doc_id].encode().index(word, end)
                end = at + len(word)
            mixed.append((doc_id, texts[doc_id].encode()[:end].decode()))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted_pieces(mixed, 4096)
