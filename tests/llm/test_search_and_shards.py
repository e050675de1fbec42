"""Spelling variants, lexical search and shards against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_rows import DOCS, SMALL, documents, docs, empty, no_docs  # noqa: F401

from corpusward.llm import lexical, sharding, spelling
from corpusward.llm.queries import QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# spelling variants


def slow_words(rows, least_length=6, least_count=5):
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    return {w: n for w, n in counted.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(words):
    by_start, partners = defaultdict(list), defaultdict(list)
    for a in words:
        for b in words:
            if near(a, b):
                partners[a].append(b)
    form = {}
    for a, others in partners.items():
        b = min(others, key=lambda w: (-words[w], w))
        if words[b] >= 5 * words[a]:
            form[a] = b
    rows = []
    for a in words:
        root = a
        while root in form:
            root = form[root]
        rows.append((a, words[a], len(partners[a]), form.get(a), words.get(form.get(a)), root))
    return sorted(rows, key=lambda r: r[0])


def spelled(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants_of_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert spelled(QUERIES["op11_spelling_variants"](spark, SMALL)) == slow_variants(slow_words(rows))


def variant_rows():
    """Words with many near ones, chains of forms, letters beyond ASCII, and a first half that all words share."""
    dice = random.Random(5)
    words = ["réponse", "rÉponse", "reponse", "Straße", "strasse", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa"]
    words += ["shared" + "".join(dice.choices("abc", k=5 + k % 3)) for k in range(300)]
    counts = {w: dice.choice([1, 4, 5, 6, 30, 200]) for w in words}
    counts |= {"chainone": 1000, "chainonx": 150, "chainoyx": 20, "chaimoyx": 5}
    flat = [w for w, n in counts.items() for _ in range(n)]
    dice.shuffle(flat)
    rows = [(k, " ".join(flat[k::40])) for k in range(40)]
    return rows + [(None, "Response chainone! chainone"), (None, None), (7, ""), (8, "y" * 90_000), (9, "12 ??? 漢字 🙂")]


@pytest.mark.parametrize("hot", [1, 50, 1 << 30])
def test_hot_chunks_lose_nothing(spark, hot, monkeypatch):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' word", "1 n", "2 chunk", "3 near")
    monkeypatch.setattr(spelling.links, "__defaults__", (hot,))
    wanted = slow_variants(slow_words(rows))
    assert spelled(spelling.variants(docs)) == wanted
    assert any(r[3] and r[5] != r[3] for r in wanted)


def test_words_that_share_a_chunk_do_not_meet_in_pairs(spark):
    """Words of one first half, none of them near: the hot way makes rows in proportion to the words."""
    words = [("shared" + f"{k:06d}".translate(str.maketrans("0123456789", "abcdefghij")).replace("", "z")[1:-1], 9) for k in range(0, 200_000, 997)]
    counted = spark.createDataFrame(words, "word string, n long")
    assert spelling.links(counted, hot=1).count() == sum(near(a, b) for a, _ in words for b, _ in words) // 2


def test_variants_of_awkward_rows(spark, docs, no_docs):  # noqa: F811
    assert spelled(spelling.variants(docs)) == slow_variants(slow_words([r[:2] for r in DOCS]))
    assert spelled(spelling.variants(docs, 1, 1)) == slow_variants(slow_words([r[:2] for r in DOCS], 1, 1))
    assert spelled(spelling.variants(no_docs)) == []


# lexical search


def slow_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def slow_search(rows, items, top=10):
    counted = [(doc_id, Counter(slow_terms(text))) for doc_id, text in rows]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for item_id, text in items:
        asked[item_id] |= set(slow_terms(text))
    result = []
    for item_id, words in asked.items():
        scores = []
        for doc_id, c, n in counted:
            m = 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            scores += [(-score, doc_id is None, doc_id)] if score > 0 else []
        result += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(result, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_of_benchmark(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert answers(QUERIES["op12_lexical_search"](spark, SMALL)) == slow_search(rows, items)


ITEMS = [(1, "the quick fox"), (2, "Hund und KATZE"), (3, None), (4, "..."), (5, "漢字 🙂 é"), (None, "word"), (1, "jumps lazy"), (6, "nowhere"), (7, "x" * 120_000)]


def test_search_of_awkward_rows(spark, docs, no_docs):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 doc_id", "'t' term", "3 n", "4 places")
    wanted = slow_search([r[:2] for r in DOCS], ITEMS)
    assert answers(lexical.search(docs, items)) == wanted
    assert answers(lexical.search(docs, items, block_terms=3)) == wanted  # many blocks
    assert answers(lexical.search(docs, items, top=2)) == slow_search([r[:2] for r in DOCS], ITEMS, 2)
    assert answers(lexical.search(no_docs, items)) == []
    assert answers(lexical.search(docs, items.limit(0))) == []


def test_classes_keep_ten_of_many_copies(spark):
    """Copies and reordered texts are one class; ties between classes are told apart by doc_id."""
    texts = ["alpha beta gamma", "gamma alpha beta", "alpha beta", "beta! alpha?", "alpha alpha beta other", "delta"]
    rows = [(997 * k % 1000, texts[k % 6]) for k in range(1000)]
    items = [(1, "alpha"), (2, "beta gamma"), (3, "other delta"), (4, "alpha beta gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answers(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == slow_search(rows, items)
    bags = lexical.bags(docs, [b"alpha", b"beta", b"delta", b"gamma", b"other"])
    assert lexical.classes(bags, 1000, 2500).count() <= 5 * 10


# shards


def slow_capacity(sizes, shards):
    """The smallest capacity by plain search over one-by-one greedy filling."""

    def fits(capacity):
        used, room = 1, capacity
        for size in sizes:
            if size > room:
                used, room = used + 1, capacity
            room -= size
            if room < 0:
                return False
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def check_shards(rows, got, shards):
    import hashlib

    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    by_digest, shard_of, slots, filled = Counter(), {}, defaultdict(list), Counter()
    for _, text in rows:
        by_digest[hashlib.md5((text or "").encode()).hexdigest()] += len((text or "").encode()) + 8
    texts = {(str(d), zlib.crc32((t or "").encode())): hashlib.md5((t or "").encode()).hexdigest() for d, t in rows}
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        assert shard_of.setdefault(texts[str(r.doc_id), r.text_crc32], r.shard) == r.shard
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, left, rest = sum(by_digest.values()), shards, dict(by_digest)
    for digest in sorted(by_digest, key=lambda d: (-by_digest[d], d)):
        if by_digest[digest] * left <= total:
            break
        assert filled[shard_of[digest]] == rest.pop(digest)
        total, left = total - by_digest[digest], left - 1
    in_order = sorted(rest)
    assert [shard_of[d] for d in in_order] == sorted(shard_of[d] for d in in_order)
    if rest:
        assert max(filled[shard_of[d]] for d in rest) == slow_capacity([rest[d] for d in in_order], left)


def test_shards_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_sharding"](spark, SMALL).collect()
    check_shards(rows, got, 24)
    assert len({r.shard for r in got}) == 24


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_of_many_and_hot_groups(spark, shards):
    dice = random.Random(shards)
    rows = [(k, "x" * int(dice.paretovariate(0.9)) + str(k % 2000)) for k in range(3000)]
    rows += [(k, "copy " * 40) for k in range(3000, 4000)]  # more than a shard's share
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shard(docs, shards).collect()
    check_shards(rows, got, shards)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == shards


def test_shards_of_awkward_rows(spark, docs, no_docs):  # noqa: F811
    for shards in (1, 4, 24):
        check_shards([r[:2] for r in DOCS], sharding.shard(docs, shards).collect(), shards)
    assert sharding.shard(no_docs).collect() == []


def test_coarse_blocks_give_the_exact_capacity():
    """Blocks taken apart only where the search asks for it, against all groups at once."""
    dice = random.Random(11)
    for round_ in range(30):
        sizes = sorted((f"{dice.getrandbits(64):016x}", 1 + int(dice.paretovariate(1.2))) for _ in range(dice.choice([1, 5, 60, 2000])))
        shards, largest = dice.choice([1, 2, 7, 24]), max(s for _, s in sizes)

        def below(prefixes, digits):
            found = defaultdict(lambda: [0, 0])
            for digest, size in sizes:
                if any(digest.startswith(p) for p in prefixes):
                    found[digest[:digits]][0] += size
                    found[digest[:digits]][1] += 1
            return [(p, *x) for p, x in found.items()]

        blocks, needed = sharding.Blocks(below([""], 1)), {0}
        while needed:
            capacity, needed = blocks.search(shards, largest)
            if not needed:
                cuts, needed = blocks.even_cuts(shards, capacity)
            rows = [row for k, row in enumerate(blocks.rows) if k not in needed]
            for k in needed:
                rows += below([blocks.rows[k][0]], len(blocks.rows[k][0]) + 1)
            blocks = sharding.Blocks(rows)
        assert capacity == max(largest, slow_capacity([s for _, s in sizes], shards)), round_
        edges = [0, *cuts, len(blocks.rows)]
        assert len(edges) == shards + 1 and edges == sorted(edges)
        assert max(blocks.ends[b] - blocks.ends[a] for a, b in zip(edges[:-1], edges[1:])) <= capacity
