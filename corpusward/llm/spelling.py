"""Spelling variants: words one inserted, deleted or replaced code point apart, by asymmetric q-chunks.

Of two near words the shorter one, or either if they are equally long, contributes two disjoint chunks: its first and
its last half, each floor(length / 2) code points. The other contributes its positional grams of that length. One edit leaves a chunk whole:
the first in its place, or the last in its place or, after an insertion, one place later. So of all
positional grams only those at these places are made, for words of the same length and one less. Words
meet where length, chunk and text are equal, and every pair is verified by its edit distance.

A chunk that many words share would pair them all. The words of such a chunk meet by what is left of them beside it instead:
with one code point taken out at the same place, if they are equally long, and else the shorter one's
rest with the longer one's rest less one code point. These agree for near words and for no others, so a chunk of any number of words
costs rows in proportion to its words and its links.

Every word looks for the near word with the largest count; if that has at least ``RATIO`` times its own count, it is its form.
Counts grow by that factor along forms, so a chain is short; roots are found by doubling the steps.

Runs are counted in every task before they move, so a frequent word is a row a task. A null text has no runs, a null doc_id is an
empty string in the hash. Rows that repeat a document count again. Texts are read whole; a very long run
is a word like any other. Extra columns are ignored. Of near words with equal counts the first in code point order is the
form. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.common import ship
from corpusward.session import written

DAMAGED = 199  # one run in so many loses a code point
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
HOT = 1 << 10  # pairs of one chunk from which its words are compared by their rests
HELD = 1 << 17  # different words counted in a task before they are passed on
# One byte a code point: letters below 256 stay, A-Z become a-z, all else parts runs.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Runs of letters in order, lower-cased, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(FOLDED).split()


def damaged(run: bytes, start: int) -> bytes:
    """The run, or the run less one code point; ``start`` is the crc32 of what stands before it in the hash."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words that are long and frequent enough."""

    def rows(counted: Counter) -> pa.RecordBatch:
        found = [run.decode("latin-1") for run in counted]
        return pa.RecordBatch.from_arrays([pa.array(found, type=pa.string()), pa.array(list(counted.values()), type=pa.int64())], names=["word", "n"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counter()
        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1)):
                number = number.as_py()
                start = zlib.crc32(f"{'' if number is None else number}:".encode())
                for run, times in Counter(r for r in runs(text.as_py()) if len(r) >= least_length).items():
                    word = damaged(run, start)
                    if len(word) >= least_length:
                        counted[word] += times
                if len(counted) >= HELD:
                    yield rows(counted)
                    counted = Counter()
        yield rows(counted)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of_batches, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def piece(text: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start``, counted from 0."""
    return F.substring(text, start + 1, length)


def chunks(counted: DataFrame) -> DataFrame:
    """size, chunk, gram, short and rest for the two chunks of every word."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    two = F.array(
        F.struct(F.lit(0).alias("chunk"), piece(F.col("word"), F.lit(0), half).alias("gram"), piece(F.col("word"), half, size).alias("rest")),
        F.struct(F.lit(1).alias("chunk"), piece(F.col("word"), size - half, half).alias("gram"), piece(F.col("word"), F.lit(0), size - half).alias("rest")),
    )
    return counted.select(size.alias("size"), F.col("word").alias("short"), F.inline(two))


def grams(counted: DataFrame) -> DataFrame:
    """size (of the words to be met), chunk, gram, long and rest for the positional grams that chunks can equal."""
    own = F.length("word")

    def of(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [
            F.struct(size.alias("size"), F.lit(0).alias("chunk"), piece(F.col("word"), F.lit(0), half).alias("gram"), piece(F.col("word"), half, own).alias("rest")),
            F.struct(size.alias("size"), F.lit(1).alias("chunk"), piece(F.col("word"), own - half, half).alias("gram"), piece(F.col("word"), F.lit(0), own - half).alias("rest")),
        ]

    return counted.select(F.col("word").alias("long"), F.inline(F.array(*of(own), *of(own - 1))))


def without_one(text: Column) -> Column:
    """The text less one code point, for every place."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.concat(F.substring(text, F.lit(1), k - 1), F.substring(text, k + 1, F.length(text))))


def links(counted: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs short, long of near words; each pair once or more, equally long words in one order."""
    key = ["size", "chunk", "gram"]
    left, right = written(chunks(counted), "chunks"), written(grams(counted), "grams")
    both = left.groupBy(*key).agg(F.count("*").alias("a")).join(right.groupBy(*key).agg(F.count("*").alias("b")), key)
    shared = written(both.select(*key, (F.col("a") * F.col("b") >= hot).alias("hot")), "shared")
    left, right = left.join(shared, key), right.join(shared, key)
    same = F.length("long") == F.col("size")
    few = left.where("not hot").join(right.where("not hot").drop("hot"), key).where(~same | (F.col("short") < F.col("long")))
    # a rest less one code point, with its place if the words are equally long, -1 if not
    equal = F.posexplode(without_one(F.col("rest"))).alias("place", "left")
    many_left = left.where("hot")
    from_short = many_left.select(*key, "short", equal).unionByName(many_left.select(*key, "short", F.lit(-1).alias("place"), F.col("rest").alias("left")))
    from_long = right.where("hot").withColumn("same", same).select(*key, "long", "same", equal)
    from_long = from_long.withColumn("place", F.when(F.col("same"), F.col("place")).otherwise(-1)).drop("same")
    many = from_short.join(from_long, [*key, "place", "left"]).where((F.col("place") < 0) | (F.col("short") < F.col("long")))
    pairs = few.select("short", "long").unionByName(many.select("short", "long"))
    return pairs.where(F.levenshtein("short", "long", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms lead to, for every row of (word, form)."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return reached
        reached = further.drop("moved")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    counted = written(words(docs, least_length, least_count), "words")
    pairs = written(links(counted).distinct(), "links")
    both = pairs.select(F.col("short").alias("word"), F.col("long").alias("near")).unionByName(pairs.select(F.col("long").alias("word"), F.col("short").alias("near")))
    known = both.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    fits = -F.col("best.least") >= ratio * F.col("n")
    table = counted.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.least")).alias("form_n"),
    )
    table = written(table, "forms")
    return table.join(roots(table.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


ship(__name__)
