"""Best-fit packing: documents into token sequences by sums of squares.

Every document becomes the ids of a tokenizer and an end id. A document longer than a
sequence is cut into pieces of the sequence's length and a rest. Pieces are placed one
after the other; of all open gaps that take a piece, and a new sequence, the one is
chosen that leaves the sum over gaps of the squared number of open sequences smallest.
The rule leaves a number of unfilled sequences that hardly depends on how many pieces
there are. So pieces are dealt over shards of a fixed size at random, each shard is packed
by one task, and pieces of unfilled sequences go through another round with fewer shards,
until one shard is left or a round brings too little.

Null and empty texts are a piece of one id. Repeated rows are packed each for itself. An
empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.common import per_worker, ship
from corpusward.session import written

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 16_384
LARGEST_MEMO, LONGEST_MEMO = 400_000, 14  # words remembered, and from which length they are not
PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, uid long, sequence_id long, offset long, filled boolean"


class TokenIds:
    """Ids of a text as little-endian bytes, remembered per word.

    The tokenizer drops white space and never joins what it parts, so the ids of a text
    are those of its words. A word of Latin letters and closing punctuation is two runs
    for the tokenizer's model; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def run(self, run: str) -> bytes:
        """Ids of lower case letters or of punctuation alone."""
        known = self.runs.get(run)
        if known is None:
            if len(self.runs) > LARGEST_MEMO:
                self.runs.clear()
            shown = run if run.isascii() else self.as_bytes.pre_tokenize_str(run)[0][0]
            known = self.packed([token.id for token in self.model.tokenize(shown)])
            if len(run) < LONGEST_MEMO:
                self.runs[run] = known
        return known

    def word(self, word: str) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if core.isalpha() and max(core) <= "\xff":
            ids = self.run(core.lower())
            if len(core) < len(word):
                ids += self.run(word[len(core) :])
        else:
            ids = self.packed(self.whole.encode(word, add_special_tokens=False).ids)
        if len(word) < LONGEST_MEMO:
            if len(self.words) > LARGEST_MEMO:
                self.words.clear()
            self.words[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        known, made = self.words, self.word
        words = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        found = list(map(known.get, words))
        if None in found:
            found = [made(word) if ids is None else ids for word, ids in zip(words, found)]
        return b"".join(found)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents; ``tokenizer`` names a tokenizer file on every machine."""
    schema = pa.schema([(n, t) for n, t in zip("doc_id piece start length ids_crc32".split(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(f"ids {tokenizer}", lambda: TokenIds(tokenizer)).text
        end, width = TokenIds.packed([end_id]), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def place(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of each size in turn, and the fill of each sequence."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)  # of open sequences per gap
    taken = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    for k, size in enumerate(sizes):
        here = count[size:capacity]
        change = 2 * (count[: capacity - size] - here) + 2
        if len(change):
            change[0] -= 1 + 2 * count[0]  # a full sequence is no longer open
            change[here == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= 2 * count[capacity - size] + 1:
            gap = size + best
            sequence = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence = capacity, len(fill)
            fill.append(0)
        taken[k] = sequence
        fill[sequence] += size
        if gap > size:
            open_at[gap - size].append(sequence)
            count[gap - size] += 1
    return taken, np.array(fill, dtype=np.int64)


def packed_shard(rows: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    """One shard: pieces in dealt order and from large to small, whichever needs fewer sequences."""
    dealt = rows.sort_values("uid", kind="stable")
    falling = dealt.sort_values("length", ascending=False, kind="stable")
    tries = [(part, *place(part["length"].tolist(), capacity)) for part in (falling, dealt)]
    part, taken, fill = min(tries, key=lambda t: len(t[2]))
    offset = part["length"].groupby(taken).cumsum() - part["length"]
    return part.assign(sequence_id=base + taken, offset=offset, filled=fill[taken] == capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    left = written(cut, "pieces")
    columns = [c.split()[0] for c in PLACED.split(", ")]
    number, total, done = 0, left.count(), []
    while total:
        shards = -(-total // shard_pieces)

        def of_shard(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
            return packed_shard(rows, capacity, (number << 57) + (key[0] << 20))[columns]

        dealt = left.select("*", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).alias("shard"))
        placed = written(dealt.groupBy("shard").applyInPandas(of_shard, PLACED), "placed")  # runs now, with this number
        rest = placed.where(~F.col("filled")).count() if shards > 1 else 0
        if not rest or 2 * rest > total or number == 60:
            done.append(placed)
            break
        done.append(placed.where("filled"))
        left, total, number = placed.where(~F.col("filled")).select(*left.columns), rest, number + 1
    if not done:
        return left.select(*left.columns[:-1], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


ship(__name__)
