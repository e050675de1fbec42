"""Shards of near equal size by minimax contiguous partition.

Rows with equal texts are one atomic group; its size is the UTF-8 bytes of its texts plus eight a row. Groups
stand in the order of the MD5 of their text. A group larger than an even share of what is
left gets a shard of its own, the largest first: no cut could make that shard smaller. The others are cut where they stand: a binary search
finds the smallest capacity at which greedy filling needs no more than the shards left. Of all
cuts within that capacity those nearest to an even share of the rest are taken, so that the last shards are
not left short.

Groups are never collected. The driver sees blocks of them, by the first digits of the MD5: their sizes and
numbers of groups. A block of several groups is either full or cut somewhere; taking it as
uncut or as freely divisible bounds the capacity from both sides. Only blocks between the
two are taken apart, by two more digits, until each holds one group. The
number of those blocks depends on the square of the number of shards, not on the table.

Slots number the rows of a shard in the order of MD5 and doc_id: rows are ranged over the
partitions, and each partition starts after the rows before it. A group that holds most of the rows is spread
over many tasks, as repeated rows are told apart by their place in the input.

A null text has no bytes and is in one group with empty texts. Rows without doc_id come first in their group,
repeated rows in any order, each with a slot of its own. A very long text is one row and
may fill a shard. Where groups are fewer than shards, some shards are empty. Equal groups for a shard
of their own are taken by MD5. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.session import written

SHARDS = 24
ROW_BYTES = 8
LAW = "bytes"
FIRST_DIGITS, MORE_DIGITS = 3, 2
AFTER_ALL = "g"  # sorts after every hexadecimal digit


def measured(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, digest of the text, size and crc32 of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + F.lit(row_bytes)
    return docs.select("doc_id", F.md5(text).alias("digest"), size.alias("size"), F.crc32(text).alias("text_crc32"))


class Blocks:
    """Runs of groups in their order: prefixes of the digest, running sizes, and which hold one group."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(size for _, size, _ in self.rows)]
        self.total = self.ends[-1]

    def until(self, reach: float, divisible: bool = False) -> tuple[float, int]:
        """The furthest cut not beyond ``reach``, and the number of whole blocks before it."""
        whole = bisect_right(self.ends, reach) - 1
        if divisible and whole < len(self.rows) and self.rows[whole][2] > 1:
            return reach, whole
        return self.ends[whole], whole

    def greedy(self, shards: int, capacity: int, divisible: bool) -> list[int] | None:
        """Whole blocks before each cut of greedy filling; None if the shards do not hold all."""
        at, cuts = 0, []
        for _ in range(shards):
            at, whole = self.until(at + capacity, divisible)
            cuts.append(whole)
        return cuts if at >= self.total else None

    def capacity(self, shards: int, largest: int, divisible: bool) -> int:
        """The smallest capacity at which greedy filling succeeds."""
        low, high = max(-(-self.total // shards), largest), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.greedy(shards, middle, divisible) else (middle + 1, high)
        return low

    def open_between(self, first: int, last: int) -> set[int]:
        """Blocks of several groups from ``first`` to ``last``."""
        return {k for k in range(max(first, 0), min(last + 1, len(self.rows))) if self.rows[k][2] > 1}

    def search(self, shards: int, largest: int) -> tuple[int, set[int]]:
        """The capacity, and the blocks that must be taken apart before it is certain."""
        low, high = self.capacity(shards, largest, True), self.capacity(shards, largest, False)
        tight, loose = low, high
        firsts, lasts, at, reach = [], [], 0, 0.0
        for _ in range(shards):
            at, first = self.until(at + tight, False)
            reach, last = self.until(reach + loose, True)
            firsts.append(first), lasts.append(last)
        return high, set().union(*map(self.open_between, firsts, lasts))

    def even_cuts(self, shards: int, capacity: int) -> tuple[list[int], set[int]]:
        """Blocks before each inner cut, as even as the capacity lets them be, and blocks that must be taken apart first."""
        needed, earliest = set(), [len(self.rows)]
        for _ in range(shards - 1):  # the first cut after which the shards that follow hold the rest
            reach = self.ends[earliest[-1]] - capacity
            earliest.append(bisect_left(self.ends, reach))
            needed |= self.inside(reach)
        at, cuts = 0, []
        for left, least in zip(range(shards, 1, -1), reversed(earliest[1:])):
            even = self.ends[at] + (self.total - self.ends[at]) / left
            reach = self.ends[at] + capacity
            needed |= self.inside(even) | self.inside(reach)
            after = bisect_left(self.ends, even)
            nearest = after - 1 if after and even - self.ends[after - 1] <= self.ends[after] - even else after
            at = min(max(nearest, least), self.until(reach)[1])
            cuts.append(at)
        return cuts, needed

    def inside(self, reach: float) -> set[int]:
        """The block that ``reach`` would cut, if it has several groups."""
        after = bisect_left(self.ends, reach)
        return self.open_between(after - 1, after - 1) if 0 < after < len(self.ends) and self.ends[after] != reach else set()


def blocks_of(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[tuple[str, int, int]]:
    """(prefix, size, groups) of all blocks, or of those below the prefixes ``within``, which are all of one length."""
    if within is not None:
        groups = groups.where(any_of([(F.col("digest") >= p) & (F.col("digest") < p + AFTER_ALL) for p in within]))
    found = groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("size"), F.count("*"))
    return [tuple(row) for row in found.collect()]  # bounded by the blocks asked for


def any_of(tests: list[Column]) -> Column:
    """One of the tests holds; a balanced tree, so that many tests do not make a deep one."""
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0]


def taken_apart(groups: DataFrame, blocks: Blocks, needed: set[int]) -> Blocks:
    """The blocks with the needed ones replaced by smaller ones."""
    rows = [row for k, row in enumerate(blocks.rows) if k not in needed]
    prefixes = sorted(blocks.rows[k][0] for k in needed)
    for digits in sorted({len(p) for p in prefixes}):
        rows += blocks_of(groups, digits + MORE_DIGITS, [p for p in prefixes if len(p) == digits])
    return Blocks(rows)


def cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[list[str], list[str]]:
    """Digests with a shard of their own, and the digests or prefixes after which the other shards end."""
    largest = [tuple(r) for r in groups.orderBy(F.desc("size"), "digest").limit(shards).select("digest", "size").collect()]
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone, left = [], shards
    for digest, size in largest:
        if size * left <= total:
            break
        alone.append(digest)
        total, left = total - size, left - 1
    rest = groups.where(~F.col("digest").isin(alone))
    most = next((size for digest, size in largest if digest not in alone), 0)
    blocks, needed = Blocks(blocks_of(rest, FIRST_DIGITS)), {0}
    while needed:
        capacity, needed = blocks.search(left, most)
        if not needed:
            inner, needed = blocks.even_cuts(left, capacity)
        if needed:
            blocks = taken_apart(rest, blocks, needed)
    return alone, [blocks.rows[k - 1][0] + AFTER_ALL if k else "" for k in inner]


def shard(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = written(measured(docs, row_bytes), "sizes")
    by_digest = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    alone, ends = cuts(written(by_digest.repartitionByRange("digest").sortWithinPartitions("digest"), "groups"), shards)
    number = F.lit(len(alone))
    for end in ends:
        number = number + (F.col("digest") > end).cast("int")
    for k, digest in reversed(list(enumerate(alone))):
        number = F.when(F.col("digest") == digest, k).otherwise(number)
    order = [F.col("shard"), F.col("digest"), F.col("doc_id"), F.col("place")]
    dealt = rows.withColumn("shard", number.cast("int")).withColumn("place", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("place", "digest")
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "placed")  # rows of a partition are numbered in order
    part = F.shiftright("at", 33)
    runs = placed.groupBy("shard", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("shard").alias("of"), "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("start"))
    joined = placed.join(starts, (F.col("shard") == F.col("of")) & (part == F.col("part")))
    slot = F.col("at") + F.col("start")
    return joined.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
