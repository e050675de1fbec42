"""Quality classifier: logistic regression on hashed word n-grams.

Words are runs of word characters, and runs of marks count as words too; features are single
words and pairs of neighbours, hashed to ``2 ** BITS`` places, with counts scaled to length
one. All pairs of a word with itself are one feature, and so are all words that come back
after one other. The model is trained by follow-the-regularised-leader updates, one per document and
epoch, on a bounded sample (about ``per_label`` whole documents of each label). The sample is
dealt over shards, every shard is trained by one task, and their weights are averaged. The
intercept is the ratio of labels among all documents that may be learnt from. A score is a sparse dot product.

The model is at most ``2 ** BITS`` numbers, sent once to every executor. A very long text is read whole and costs memory in
proportion to its words. An empty table gives no rows, and an empty table of labels a model without weights. Null and empty texts,
and texts without a word, get the score of the intercept. If one label or both are
missing the model is its intercept. Different labels of a document are several examples; an id
that is repeated is one, with the first of its texts.
Extra columns are ignored, or kept by ``good``; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.common import held_out, per_worker, ship
from corpusward.llm.samples import sample

BITS = 18
PER_LABEL = 4_000
SHARDS = 4
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
GOOD = 0.7
LARGEST_MEMO = 150_000
WORD = re.compile(r"\w+|[^\w\s]+")
BACK = np.uint64(1 << 40)  # beyond the hashes of words
PAIR = np.uint64(0x9E3779B97F4A7C15)  # odd, spreads neighbours over the places


class WordHashes(dict):
    """32-bit hashes of words, remembered for short words."""

    def __missing__(self, word: str) -> int:
        hashed = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) < 40:
            if len(self) > LARGEST_MEMO:
                self.clear()
            self[word] = hashed
        return hashed


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's n-grams and their values; the values' squares sum up to one."""
    hash_of = per_worker("word hashes", WordHashes).__getitem__
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    one = np.fromiter(map(hash_of, words), dtype=np.uint64, count=len(words)) + np.uint64(1)
    two = np.where(one[:-1] == one[1:], np.uint64(0), one[:-1] * PAIR + one[1:])
    back = np.full(int((one[:-2] == one[2:]).sum()), BACK)
    spread = np.concatenate([one, two, back]) * PAIR
    places, counts = np.unique((spread >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return places, counts / math.sqrt(float(np.dot(counts, counts)))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of proximal updates over (label, places, values)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            label, at, value = examples[k]
            own = weights(z[at], n[at])
            error = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(own @ value))))) - label
            slope = error * value
            z[at] += slope - (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA * own
            n[at] += slope * slope
    return weights(z, n)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def text_score(text: str | None, weights: np.ndarray, intercept: float) -> float:
    places, values = features(text)
    total = float(weights[places] @ values) + intercept
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, shards: int = SHARDS) -> Model:
    """The model of ``labels.quality`` from documents that are not held out."""
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    ratio = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    chosen = sample(known, "quality", per_label, key="labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one text of a repeated id, always the same
    shown = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("quality", pa.int32()), ("places", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, quality, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                places, values = features(text)
                yield pa.RecordBatch.from_pylist([{"shard": zlib.crc32(b"%d" % doc_id) // 4 % shards, "doc_id": doc_id, "quality": quality, "places": places, "values": values}], schema=shown)

    def of_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "quality"], kind="stable")
        weights = train([(q, np.asarray(p, np.int64), np.asarray(v)) for q, p, v in zip(rows["quality"], rows["places"], rows["values"])])
        used = np.flatnonzero(weights)
        return pd.DataFrame({"place": np.append(used, -1), "weight": np.append(weights[used], 1.0) * len(rows)})  # -1: how many

    made = texts.mapInArrow(examples, "shard int, doc_id long, quality int, places array<long>, values array<double>")
    trained = made.groupBy("shard").applyInPandas(of_shard, "place long, weight double")
    rows = trained.groupBy("place").agg(F.sum("weight").alias("weight")).toPandas()  # at most 2 ** BITS + 1 rows
    weights, intercept = np.zeros(1 << BITS), 0.0
    if len(ratio) == 2:
        intercept = math.log(ratio[1] / ratio[0])
        own = rows[rows["place"] >= 0]
        weights[own["place"].to_numpy(np.int64)] = own["weight"].to_numpy() / rows.loc[rows["place"] == -1, "weight"].sum()
    elif ratio:
        intercept = 5.0 if 1 in ratio else -5.0
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, and their score."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.intercept))

    def of_batch(texts: pd.Series) -> pd.Series:
        return pd.Series([text_score(text, *sent.value) for text in texts], dtype="float64")

    scored = F.pandas_udf(of_batch, "double").asNondeterministic()  # else filters make Spark score twice
    return docs.select(F.struct("*").alias("row"), scored(F.col("text").cast("string")).alias("score"))


def predicted(score: Column, threshold: float = GOOD) -> Column:
    return (score >= threshold).cast("int")


def classify(docs: DataFrame, model: Model, threshold: float = GOOD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", predicted(F.col("score"), threshold).alias("predicted"))


def good(docs: DataFrame, model: Model, threshold: float = GOOD) -> DataFrame:
    """The rows that are predicted to be good, as they are."""
    return score(docs, model).where(F.col("score") >= threshold).select("row.*")


ship(__name__)
