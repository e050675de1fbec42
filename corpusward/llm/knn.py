"""Exact top-k search by inner product, as a Voronoi join.

Components become integers, floor(scale * x). Pivots, about the square root of the number of queries and a bounded number of
them, divide queries and data into groups by the nearest pivot. The summary of a data group is its pivot p and the largest
distance r of its rows from p. Each pivot has some seeds, the rows with the largest products with it; the
k-th best product of a query with the seeds of its group is a score t that its k-th best cannot fall below. As
q.x <= q.p + r |q| for all rows x of a group, a query goes to the groups where that reaches t and to no others.

Data rows are dealt once, over chunks of their group of about a fixed size; queries are copied to
the chunks of the groups that they need. Where there are more queries than a block holds, they are dealt over
blocks, and each chunk meets every block. The best of all chunks remain.

Pivots, seeds and summaries are bounded by ``MOST_PIVOTS`` and travel with the tasks.

Vectors that are null, or that hold a null or a non-finite number, take no part. Shorter vectors
count as if filled with zeros. Rows without an id are never a query's own row and come last among
equal scores. Rows that repeat an id are all candidates, but none of them for a query with that
id; a query that is repeated is answered each time. Scores are exact while they fit a long.
Empty tables, and queries without candidates, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.llm.common import ship
from corpusward.session import written

SCALE = 256
MOST_PIVOTS = 128
BLOCK_QUERIES = 16_384
CHUNK_ROWS = 16_384
SEEDS = 32
FOUND = "query_uid long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """False for null vectors and for those with a null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def matrix(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """Integers floor(scale * x) as doubles, a row for each vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products as exact longs."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1]) < 2.0**52:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.T.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of ``scores``, places of the k best; equal scores by id. The lowest long is no score."""
    none = np.iinfo(np.int64).min
    width = scores.shape[1]
    least = np.partition(scores, width - k, axis=1)[:, width - k] if width > k else np.full(len(scores), none)
    out = []
    for row, bound in zip(scores, least):
        near = np.flatnonzero((row >= bound) & (row > none))
        out.append(near[np.lexsort((ids[near], -row[near]))[:k]])
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row of ``vectors`` (vec_id, embedding) with ``is_query``."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asking, width = kept.agg(F.count("*"), F.count_if("asks"), F.max(F.size("embedding"))).first()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = F.xxhash64(F.lit("pivot"), "vec_id", "embedding")
    chosen = kept.where("asks").orderBy(order, "vec_id").limit(min(MOST_PIVOTS, math.isqrt(asking - 1) + 1)).select("embedding")
    pivots = matrix(pa.array([r[0] for r in chosen.collect()], pa.list_(pa.float64())), width, scale)
    inner = str(kept.schema["embedding"].dataType.simpleString())

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(1), width, scale)
            apart = np.stack([((own - p) ** 2).sum(axis=1) for p in pivots], axis=1)
            group = apart.argmin(axis=1)
            distance = np.sqrt(apart[np.arange(len(group)), group]) if len(group) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32()), pa.array(distance)], names=["vec_id", "embedding", "asks", "cell", "apart"])

    rows = kept.mapInArrow(nearest, f"vec_id long, embedding {inner}, asks boolean, cell int, apart double")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    groups = [tuple(r) for r in rows.groupBy("cell").agg(F.count("*"), F.max("apart")).collect()]  # at most MOST_PIVOTS
    radius = np.zeros(len(pivots))
    chunks = {}
    for group, n, far in groups:
        radius[group], chunks[group] = far, -(-n // CHUNK_ROWS)

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = products(pivots, matrix(batch.column(1), width, scale))
            for cell, places in enumerate(best(scores, np.arange(batch.num_rows), SEEDS + k)):
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(places), pa.int32()), pa.array(scores[cell, places]), *(c.take(pa.array(places)) for c in batch.columns)], names=["cell", "product", "vec_id", "embedding"])

    seen = rows.select("vec_id", "embedding").mapInArrow(seed_rows, f"cell int, product long, vec_id long, embedding {inner}")
    by_cell = Window.partitionBy("cell").orderBy(F.desc("product"), "vec_id")
    seeds: dict[int, list] = {}
    for cell, vec_id, vector in seen.withColumn("place", F.row_number().over(by_cell)).where(F.col("place") <= SEEDS + k).select("cell", "vec_id", "embedding").collect():
        seeds.setdefault(cell, []).append((vec_id, vector))  # at most MOST_PIVOTS times SEEDS + k
    seed_vectors = {c: matrix(pa.array([v for _, v in s], pa.list_(pa.float64())), width, scale) for c, s in seeds.items()}
    seed_ids = {c: np.array([np.iinfo(np.int64).min if i is None else i for i, _ in s]) for c, s in seeds.items()}

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, cells, ids = matrix(batch.column(2), width, scale), batch.column(3).to_numpy(), batch.column(1).to_pylist()
            lows = np.full(len(own), -np.inf)
            for q, cell in enumerate(cells):
                scores = products(own[q : q + 1], seed_vectors[cell])[0][seed_ids[cell] != ids[q]]
                if len(scores) >= k:
                    lows[q] = np.sort(scores)[-k]
            length = np.sqrt((own**2).sum(axis=1))
            for group in chunks:
                reach = own @ pivots[group] + radius[group] * length
                near = pa.array(np.flatnonzero(reach >= lows - 1e-9 * (np.abs(np.where(np.isinf(lows), 0, lows)) + np.abs(reach))))
                yield pa.RecordBatch.from_arrays([*(c.take(near) for c in batch.columns[:3]), pa.array([group] * len(near), pa.int32())], names=["uid", "vec_id", "embedding", "cell"])

    blocks = -(-asking // BLOCK_QUERIES)
    chunk_count = F.element_at(F.create_map(*[F.lit(x).cast("int") for pair in chunks.items() for x in pair]), F.col("cell"))
    asked = rows.where("asks").select("uid", "vec_id", "embedding", "cell").mapInArrow(needed, f"uid long, vec_id long, embedding {inner}, cell int")
    block = F.pmod(F.xxhash64(F.lit("block"), "uid"), F.lit(blocks)).cast("int").alias("block")
    asked = asked.select("cell", block, F.explode(F.sequence(F.lit(0), chunk_count - 1)).alias("chunk"), "uid", "vec_id", "embedding")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "uid"), chunk_count).cast("int").alias("chunk")
    dealt = rows.select("cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk, "vec_id", "embedding")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            data, given = matrix(right["embedding"], width, scale), right["vec_id"].combine_chunks()
            missing = given.is_null().to_numpy(zero_copy_only=False)
            ids = given.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            asked_ids, uids = left["vec_id"].to_pylist(), left["uid"].to_pylist()
            for at in range(0, left.num_rows, 128):
                part = left.slice(at, 128)
                scores = products(matrix(part["embedding"], width, scale), data)
                for q in range(part.num_rows):
                    if asked_ids[at + q] is not None:
                        scores[q, (ids == asked_ids[at + q]) & ~missing] = np.iinfo(np.int64).min
                for q, places in enumerate(best(scores, ids, k)):
                    found += [(uids[at + q], asked_ids[at + q], None if missing[p] else int(ids[p]), int(scores[q, p])) for p in places]
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_uid", "query_id", "vec_id", "score"), columns)})

    keys = ("cell", "block", "chunk")
    local = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(solve, FOUND)
    place = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = local.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ship(__name__)
