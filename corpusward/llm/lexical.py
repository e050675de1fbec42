"""Ranked lexical search over a bag-deduplicated corpus.

Items are the queries. Every document is restricted to the vocabulary of the items: what remains is its
vector of term frequencies and the number m, which stands for its length. Documents with equal vectors and m
form a class: they score alike for every item. Classes are brought together by a hash of vector and m, and rows of one
hash are compared by the vector itself. Each class is scored once, for all items that share a term
with it. Of a class only the ten members with the smallest doc_id can be in a result of ten; each task keeps no more
before rows move, so a class of any size is a few rows. Each task that scores keeps ten classes an item, by score and
then smallest doc_id; a document of the result is in one of them.

Items are asked in blocks whose vocabularies are bounded, so that vocabulary and postings go to the tasks
with a known size; every block is asked of all documents.

Terms are the maximal runs of ASCII letters and digits and of any characters beyond ASCII; only A-Z are
lower-cased. A term's weight and a document's score are those of ``weight`` and ``gain``, whole numbers.

Null, empty and blank texts have no terms: such documents take no part, such items have no result. Rows
that share an item_id, null included, are one item with all their terms. Rows that repeat a document, or its id, are documents of their own and
take ranks of their own. Documents without doc_id come last among equals. Texts are read whole, one at a time, whatever their length. Extra
columns are ignored. An empty table of documents or items gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.llm.common import ship
from corpusward.session import written

TOP = 10
BLOCK_TERMS = 1 << 18  # terms of the items of a block, together
PAIRS = 1 << 21  # scores and postings at a time
LAST = (1 << 63) - 1  # in place of a null doc_id
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c in KEPT else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLDED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct terms of every item that has any."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sorted(set(terms(text.as_py()))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(of_batches, "item_id long, terms array<binary>")
    one = asked.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    return one.select("item_id", F.sort_array("terms").alias("terms"))


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the document), and its vector: places of terms in the vocabulary, and their frequencies."""
    schema = "doc_id long, n long, places array<int>, counts array<int>"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: k for k, term in enumerate(vocabulary)}
        for batch in batches:
            ns, places, counts = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                known = np.fromiter(filter(None.__ne__, map(place.get, found)), dtype=np.int32)
                which, how_often = np.unique(known, return_counts=True)
                ns.append(len(found))
                places.append(which)
                counts.append(how_often.astype(np.int32))
            vector = pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(ns, type=pa.int64()), pa.array(places, type=vector), pa.array(counts, type=vector)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "places", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of_batches, schema)


def weight(documents: Column, frequency: Column) -> Column:
    return F.floor(1000 * F.log((2 * documents + 2) / (2 * frequency + 1))).cast("long")


def gain(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term of weight one adds to a score."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def classes(found: DataFrame, documents: int, length: int, top: int = TOP) -> DataFrame:
    """Members of classes: class hash, m, places, counts, doc_id and the member's place in the class, up to ``top``."""
    m = 100 - 90 + F.expr(f"(90 * n * {documents}) div {length}")
    keyed = found.where(F.size("places") > 0).select("doc_id", m.alias("m"), "places", "counts")
    keyed = keyed.withColumn("class", F.xxhash64("m", "places", "counts"))
    in_class = Window.partitionBy("class", "m", "places", "counts").orderBy(F.col("doc_id").asc_nulls_last())
    return keyed.withColumn("member", F.row_number().over(in_class)).where(F.col("member") <= top)


def best(item: np.ndarray, score: np.ndarray, first: np.ndarray, row: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` entries of each item, by falling score and rising first doc_id."""
    order = np.lexsort((first, -score, item))
    item, score, first, row = item[order], score[order], first[order], row[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
    return tuple(x[rank < top] for x in (item, score, first, row))


def scored(members: DataFrame, weights: np.ndarray, starts: np.ndarray, postings: np.ndarray, ids: list[int | None], top: int = TOP) -> DataFrame:
    """item (its number), item_id, score and the class of each task's best classes. ``postings`` lists the items of each place."""
    schema, n_items = "item int, item_id long, score long, class long, m long, places array<int>, counts array<int>", len(ids)

    def runs(batch: pa.RecordBatch) -> Iterator[slice]:
        """Rows that make at most PAIRS scores and about as many postings."""
        lengths = np.diff(starts)[batch.column("places").flatten().to_numpy()]
        sizes = np.diff(batch.column("places").offsets.to_numpy())
        work = np.add.reduceat(lengths, np.r_[0, np.cumsum(sizes)[:-1]]) + n_items  # every class has a term
        filled = np.cumsum(work) // PAIRS
        edges = np.r_[0, np.flatnonzero(np.diff(filled)) + 1, len(work)]
        return (slice(a, b) for a, b in zip(edges[:-1], edges[1:]))

    def scores(places: pa.ListArray, counts: pa.ListArray, m: np.ndarray) -> np.ndarray:
        """Rows times items; whole numbers."""
        terms_of, often = places.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(m)), np.diff(places.offsets.to_numpy()))
        value = weights[terms_of] * gain(often, m[row])
        length = starts[terms_of + 1] - starts[terms_of]
        entry = np.repeat(np.arange(len(terms_of)), length)
        inner = np.arange(len(entry)) - np.repeat(np.cumsum(length) - length, length)
        cell = row[entry] * n_items + postings[starts[terms_of[entry]] + inner]
        total = np.zeros(len(m) * n_items, dtype=np.int64)
        np.add.at(total, cell, value[entry])
        return total.reshape(len(m), n_items)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(n_items, dtype=np.int64)  # a score below it is in no result
        held = [np.zeros(0, dtype=np.int64) for _ in range(4)]
        kept = pa.table({n: pa.array([], type=t) for n, t in (("class", pa.int64()), ("m", pa.int64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())))})
        for batch in batches:
            for part in runs(batch) if batch.num_rows else ():
                rows = pa.Table.from_batches([batch.slice(part.start, part.stop - part.start)]).combine_chunks()
                places, counts = rows.column("places").chunk(0), rows.column("counts").chunk(0)
                found = scores(places, counts, rows.column("m").to_numpy())
                row, item = np.nonzero(found >= least)
                first = rows.column("first").to_numpy()[row]
                joined = [np.r_[a, b] for a, b in zip(held, (item, found[row, item], first, row + len(kept)))]
                held = list(best(*joined, top))
                pool = pa.concat_tables([kept, rows.select(kept.column_names)])
                used, held[3] = np.unique(held[3], return_inverse=True)
                kept = pool.take(used).combine_chunks()
                full, counted = np.unique(held[0], return_counts=True)
                ends = np.cumsum(counted) - 1
                least[full[counted == top]] = held[1][ends[counted == top]]
        if len(held[0]):
            out = kept.take(held[3])
            given = {"item": pa.array(held[0].astype(np.int32)), "item_id": pa.array(ids, type=pa.int64()).take(pa.array(held[0])), "score": pa.array(held[1])}
            columns = given | {n: out.column(n) for n in kept.column_names}
            yield from pa.table(columns).combine_chunks().to_batches(max_chunksize=4096)

    single = members.where("member = 1").select("class", "m", "places", "counts", F.coalesce("doc_id", F.lit(LAST)).alias("first"))
    return single.mapInArrow(of_batches, schema)


def answered(docs: DataFrame, asked: list[tuple[int | None, list[bytes]]], top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block."""
    vocabulary = sorted(set().union(*(words for _, words in asked)))
    place = {term: k for k, term in enumerate(vocabulary)}
    pairs = np.array(sorted((place[term], k) for k, (_, words) in enumerate(asked) for term in words), dtype=np.int64)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
    found = written(bags(docs, vocabulary), "bags")
    documents, length = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = found.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for row in frequencies.select("place", weight(F.lit(documents), F.col("df")).alias("weight")).collect():  # at most a block's terms
        weights[row.place] = row.weight
    members = written(classes(found, documents, max(length, 1), top), "members")
    vector = ["class", "m", "places", "counts"]
    ranked = scored(members, weights, starts, pairs[:, 1], [number for number, _ in asked], top)
    expanded = ranked.join(members.select(*vector, "doc_id"), vector)
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return expanded.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with scores above 0."""
    spark = docs.sparkSession
    words = written(item_terms(items).withColumn("n", F.size("terms")), "items")
    blocks = -(-(words.agg(F.sum("n")).first()[0] or 0) // block_terms)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        of_block = words.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id")
        asked = [(row.item_id, [bytes(t) for t in row.terms]) for row in of_block.select("item_id", "terms").toLocalIterator()]
        if asked:
            result = result.unionByName(written(answered(docs, asked, top), "answers"))
    return result


ship(__name__)
