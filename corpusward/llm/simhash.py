"""SimHash near duplicates over segment counts.

Fingerprints have 64 bits. A fingerprint is embedded as the numbers of set bits in its 32
segments of two bits. Manhattan distance there is never more than the number of differing
bits, so fingerprints within three bits have distance three at most, and then one half of
the segments has distance one at most. Each half is a grid whose cells are its 16 counts:
every fingerprint enters its own cell and, on the other side of the join, its own cell and
those with one count higher by one. What meets is verified by the differing bits.

Copies have one fingerprint and are one node of the graph, so a group of copies of any
size costs one row. Only links between different fingerprints are made.

Null, empty and blank texts have fingerprint zero. Rows without ``doc_id`` take part; the id
of a component is the smallest ``doc_id`` in it, null if it has none. Repeated rows are returned
each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.common import row_key, ship
from corpusward.llm.components import components
from corpusward.session import written

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64 bits; a bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    parts = list(map(b" ".join, zip(*(words[k:] for k in range(shingle))))) or [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the fingerprint of the text as a long, and a key that rows with equal id and text share."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(text.as_py(), shingle) for text in batch.column(2)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(1)], names=["doc_id", "fingerprint", "key"])

    asked = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string"))
    return asked.mapInArrow(of_batches, "doc_id long, fingerprint long, key string")


def half_counts(print_: Column, half: int) -> Column:
    """The counts of 16 segments, two bits each, of one half, and the half's number above them."""
    bits = F.shiftrightunsigned(print_, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    odd = F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))
    return bits - odd + F.lit(half << 40)


def higher_cells(cell: Column) -> Column:
    """The cell itself and those with one count, at most two, higher by one."""
    steps = [
        F.when(F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3)) < 2, cell + F.lit(1 << 2 * k)) for k in range(16)
    ]
    return F.array_compact(F.array(cell, *steps))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a, b of distinct ``fingerprint`` values that differ in at most ``distance`` (up to 3) bits.

    Spark sizes a table after ``explode`` as if it had the rows before, so the sides, up to 17 cells a row,
    would be broadcast when far too large; the join is asked to shuffle both.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves find distances up to 3")
    cells = prints.select("fingerprint", F.explode(F.array(half_counts(F.col("fingerprint"), 0), half_counts(F.col("fingerprint"), 1))).alias("cell"))
    home = cells.select(F.col("fingerprint").alias("a"), "cell")
    probe = cells.select(F.col("fingerprint").alias("b"), F.col("cell").alias("own"), F.explode(higher_cells(F.col("cell"))).alias("cell"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & ((F.col("own") != home["cell"]) | (F.col("a") < F.col("b")))
    return home.hint("merge").join(probe, (home["cell"] == probe["cell"]) & near).select("a", "b")


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fingerprint, component_id and keeper, the key of the row that stands for the component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    nodes = written(prints.groupBy("fingerprint").agg(first), "nodes")
    roots = components(links(nodes, distance)).select(F.col("node").alias("fingerprint"), "root")
    placed = nodes.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    of_root = placed.groupBy("root").agg(F.min("first").alias("least"))
    return placed.join(of_root, "root").select("fingerprint", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("keeper"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lower case hex digits) and component_id of every row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(groups(prints, distance).drop("keeper"), "fingerprint").select("doc_id", shown, "component_id")


def representatives(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with the smallest doc_id; rows without an id only where no row has one.

    Rows with equal id and text fold into one in every task before texts move.
    """
    kept = groups(written(fingerprints(docs, shingle), "fingerprints"), distance).select(F.col("keeper").alias("key")).distinct()
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct("*").alias("row"))
    return rows.groupBy("key").agg(F.first("row").alias("row")).join(kept, "key", "left_semi").select("row.*")


ship(__name__)
