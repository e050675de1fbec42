"""Token counts, fingerprints, packing and SimHash against brute force, on awkward rows and on given ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from llm_rows import DOCS, SMALL, docs, documents, no_docs  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from corpusward.llm import imatch, packing, simhash, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)


# token counts


def unigram():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    whole = models.Unigram(vocabulary, unk_id=0, byte_fallback=True)
    return lambda text: len(whole.tokenize(model.normalize(text))) if text else 0


def test_token_counts_are_those_of_a_unigram_tokenizer(spark, docs, no_docs):
    count = unigram()
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(docs, PIECES).collect())
    assert got == sorted((str(i), count(t)) for i, t, *_ in DOCS)
    rows = given(spark)
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(rows, PIECES).collect()} == {r.doc_id: count(r.text) for r in rows.collect()}
    assert tokens.token_counts(no_docs, PIECES).collect() == []


def test_equal_scores_go_to_the_longer_last_piece():
    vocabulary = tokens.Vocabulary(PIECES)
    import ahocorasick

    vocabulary.automaton = ahocorasick.Automaton()
    for piece, score in {"a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0}.items():
        vocabulary.automaton.add_word(piece, (len(piece), score))
    vocabulary.automaton.make_automaton()
    assert vocabulary.best("abc") == (1, -3.0)
    assert vocabulary.best("abcab") == (2, -5.0)


# packing


def wanted_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((str(doc_id), k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out)


def check_packed(packed, capacity):
    rows = packed.collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows), len(by_sequence)


@pytest.mark.parametrize("shard_pieces", [4, 100_000])
def test_packing(spark, docs, no_docs, shard_pieces):
    got, sequences = check_packed(packing.pack(docs, WORDS, shard_pieces=shard_pieces), 4096)
    assert got == wanted_pieces([r[:2] for r in DOCS], 4096)
    rows = given(spark)
    got, sequences = check_packed(packing.pack(rows, WORDS, capacity=512, shard_pieces=shard_pieces), 512)
    assert got == wanted_pieces([(r.doc_id, r.text) for r in rows.collect()], 512)
    least = math.ceil(sum(g[3] for g in got) / 512)
    assert sequences <= least * (1.02 if shard_pieces > 1000 else 1.3) + 1
    assert packing.pack(no_docs, WORDS).collect() == []


def test_place_follows_the_sums_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(20):
        capacity = 12
        sizes = rng.integers(1, capacity + 1, 60).tolist()
        taken, fill = packing.place(sizes, capacity)
        gaps: list[int] = []

        def squares(gaps):
            return sum(n * n for gap, n in Counter(gaps).items() if 0 < gap < capacity)

        for size, sequence in zip(sizes, taken):
            options = {}
            for k, gap in [*enumerate(gaps), (len(gaps), capacity)]:
                if gap >= size:
                    after = [*gaps, capacity] if k == len(gaps) else list(gaps)
                    after[k] -= size
                    options[k] = squares(after)
            assert options[sequence] == min(options.values())
            if sequence == len(gaps):
                gaps.append(capacity)
            gaps[sequence] -= size
        assert [capacity - gap for gap in gaps] == fill.tolist()


# SimHash


def slow_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids_and_prints):
    nodes = sorted({p for _, p in ids_and_prints})
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(b)] = find(a)
    least = {}
    for i, p in ids_and_prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {(i, f"{p:016x}"): least.get(find(p)) for i, p in ids_and_prints}


@pytest.mark.parametrize("awkward", [True, False])
def test_simhash_equals_brute_force(spark, docs, awkward):
    rows = [r[:2] for r in DOCS] if awkward else [(r.doc_id, r.text) for r in given(spark).collect()]
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    got = simhash.near_duplicates(docs if awkward else given(spark)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint): r.component_id for r in got} == want


def test_links_of_chosen_fingerprints(spark):
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 40)} | {0, (1 << 64) - 1, 7, 15}
    for base in list(prints)[:12]:
        for flips in (1, 2, 3, 4):
            changed = base
            for bit in rng.choice(64, flips, replace=False):
                changed ^= 1 << int(bit)
            prints.add(changed)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    want = {tuple(sorted((signed[a], signed[b]))) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(p,) for p in signed.values()], "fingerprint long")).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == want


def test_exploded_cells_are_not_broadcast(spark):
    """Spark takes the cells for as few as the fingerprints, here some kilobytes."""
    prints = spark.range(1000).select(F.xxhash64("id").alias("fingerprint"))
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_document_of_each_group_stays(spark, docs, no_docs):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = slow_components([(i, slow_fingerprint(t)) for i, t, *_ in DOCS])
    rows = kept.select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted({str(v) for v in groups.values()})
    assert simhash.representatives(no_docs).collect() == [] == simhash.near_duplicates(no_docs).collect()


# I-Match


def slow_imatch(rows):
    split = lambda t: sorted({w for w in re.split(r"[\W_]+", (t or "").lower()) if w})
    df = Counter(w for _, t in rows for w in split(t))
    band = {w for w, n in df.items() if imatch.LEAST_IDF <= math.log(len(rows) / n) <= imatch.MOST_IDF}
    low = lambda k, w: hashlib.md5(f"{k}:{w}".encode()).hexdigest()[:3] < imatch.KEPT[k]

    def prints(text):
        words = split(text)
        words = [w for w in words if w in band] or words
        kept = [[w for w in words if low(k, w)] for k in range(len(imatch.KEPT))]
        return [hashlib.md5(" ".join(p).encode()).hexdigest()[:8] if p else "" for p in kept]

    def likeness(a, b):
        filled = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    ids = sorted({i if i is not None else -(1 << 63) for i, _ in rows}, reverse=True)
    of_id = {}
    for i, t in rows:
        of_id.setdefault(i if i is not None else -(1 << 63), []).append(t or "")
    out = []
    for i, t in rows:
        t, place = t or "", ids.index(i if i is not None else -(1 << 63))
        before = max(len(x) for x in of_id[ids[place]]) // 2
        start, near = min((x[:before], "-".join(prints(x))) for x in of_id[ids[(place + 1) % len(ids)]])
        half = len(t) // 2
        changed = t[: len(t) - half] + start[:half]
        own, edited = prints(t), prints(changed)
        out.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), "-".join(own), "-".join(edited), likeness(own, edited), likeness(own, near.split("-"))))
    return sorted(out)


def test_imatch_equals_brute_force(spark, docs, no_docs):
    plain = [r for r in DOCS if not (r[1] or "").startswith("Ünï")]  # \W and \P{L} differ on marks
    got = imatch.edited(documents(spark, plain)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == slow_imatch([r[:2] for r in plain])
    assert len(imatch.edited(docs).collect()) == len(DOCS)
    assert imatch.edited(no_docs).collect() == []


def test_one_document_is_followed_by_itself(spark):
    row = imatch.edited(documents(spark, [(4, "abcd efgh", "en", "a")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and row.near_next == 1.0


def test_imatch_uses_functions_only(docs):
    plan = imatch.edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
