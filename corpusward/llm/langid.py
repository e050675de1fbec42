"""Language identification by rank-order profiles.

A text's n-grams are its runs of 1 to 3 characters of lower-cased letters, where whatever
lies between letters counts as one space; an n-gram of two or three may begin or end with
such a space but not hold one inside. A profile is a list of the most frequent n-grams,
equal counts in code point order. A text is in the language with the least out-of-place
distance: the sum, over the text's own profile, of the difference of ranks, or of the length
of a language's profile for n-grams that the profile lacks. Equal distances go to
the first language in code point order. The score is one minus the distance as a part of the greatest possible.

Profiles are learnt from a bounded sample of labelled documents (about ``per_language``, whole
texts). They are as many small rows as languages times profile length and travel with the
tasks; texts never move.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
could be learnt. Repeated rows, extra columns, empty tables: one answer per row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.llm.common import held_out, per_worker, ship
from corpusward.llm.samples import sample

PER_LANGUAGE = 1_500
LANGUAGE_GRAMS = 400
TEXT_GRAMS = 300
MIN_SCORE = 0.25
BLOCK = 1 << 20
UNDECIDED = "und"


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, and their counts. A space is code 1."""
    found = []
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    is_letter = letter[code]
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.concatenate([[np.uint64(1)], np.where(is_letter, code, np.uint64(1)), [np.uint64(1)]])
    code = code[np.concatenate([[True], (code[1:] != 1) | (code[:-1] != 1)])]  # one space between words
    for at in range(0, len(code), BLOCK):  # long texts in blocks that overlap by what an n-gram needs
        own = code[at : at + BLOCK + 2]
        one, two, three = own[:BLOCK], own[: BLOCK + 1], own
        pairs = (two[:-1] << np.uint64(21)) | two[1:]
        inner = three[1:-1] != 1
        triples = ((three[:-2] << np.uint64(42)) | (three[1:-1] << np.uint64(21)) | three[2:])[inner]
        found.append(np.unique(np.concatenate([one[one != 1], pairs, triples]), return_counts=True))
    if len(found) == 1:
        return found[0]
    codes, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([f[1] for f in found])).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Codes from the most frequent down; equal counts by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:most]]


class Profiles:
    """Ranks of all languages' n-grams in one table."""

    def __init__(self, by_language: dict[str, list[int]], length: int):
        self.languages = sorted(by_language)
        self.length = length
        self.codes = np.unique(np.array([c for codes in by_language.values() for c in codes], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int64)
        for k, language in enumerate(self.languages):
            own = np.array(by_language[language], dtype=np.uint64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def guess(self, text: str | None, letter: np.ndarray, text_grams: int) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDECIDED, 0.0
        own = most_frequent(*grams(text, letter), text_grams)
        if not len(own):
            return UNDECIDED, 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.abs(ranks - np.arange(len(own))[:, None])
        apart = np.where(ranks < 0, self.length, np.minimum(apart, self.length)).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], 1 - float(apart[best]) / (len(own) * self.length)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, length: int = LANGUAGE_GRAMS) -> dict[str, list[int]]:
    """Profiles from the labelled documents that are not held out, about ``per_language`` of each language."""
    known = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    chosen = sample(known, "lang", per_language).select(F.col("doc_id").alias("chosen"), F.col("lang").alias("language"))
    texts = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("language"))).select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = per_worker("letters", letters)
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, counts = grams(text.as_py(), letter)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["language", "gram", "n"])

    totals = texts.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    best = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= length)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("language", "place").collect():  # languages times length rows
        profiles.setdefault(row["language"], []).append(row["gram"])
    return profiles


def guess(text: Column, profiles: dict[str, list[int]], length: int = LANGUAGE_GRAMS, text_grams: int = TEXT_GRAMS) -> Column:
    """Struct of lang_pred and score."""
    known = Profiles(profiles, length)

    def of_batch(texts: pd.Series) -> pd.DataFrame:
        letter = per_worker("letters", letters)
        return pd.DataFrame([known.guess(text, letter, text_grams) for text in texts], columns=["lang_pred", "score"])

    # nondeterministic, so that a filter on the answer does not make Spark ask twice
    return F.pandas_udf(of_batch, "lang_pred string, score double").asNondeterministic()(text.cast("string"))


def predict(docs: DataFrame, profiles: dict[str, list[int]], length: int = LANGUAGE_GRAMS, text_grams: int = TEXT_GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    asked = docs.select("doc_id", guess(F.col("text"), profiles, length, text_grams).alias("answer"))
    return asked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "answer.lang_pred", "answer.score")


def recognised(docs: DataFrame, profiles: dict[str, list[int]], min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text is in one of the learnt languages, as they are."""
    asked = docs.select(F.struct("*").alias("row"), guess(F.col("text"), profiles).alias("answer"))
    return asked.where((F.col("answer.lang_pred") != UNDECIDED) & (F.col("answer.score") >= min_score)).select("row.*")


ship(__name__)
