"""Token counts without tokens: Viterbi over a unigram vocabulary.

A text's segmentation is the one with the greatest sum of piece scores. An Aho-Corasick automaton
lists all pieces that end at each character; dynamic programming keeps the best score so far
and its number of pieces, nothing else. Of equal scores the one whose last piece is longest wins,
as in the tokenizers that use such vocabularies. A character that is no piece by itself costs the lowest
score less ten, and counts one for each of its UTF-8 bytes if the vocabulary has byte pieces.
Scores are added as doubles.

No piece of such a vocabulary goes from a word into the next one's space, so the text is cut
there and equal parts are looked up instead of computed. If a vocabulary has pieces that cross, nothing is cut.

Null and empty texts have no pieces and score 0. Every row gets its answer, repeated or
not; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.common import per_worker, ship

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LARGEST_MEMO = 400_000
LONGEST_MEMO = 64


class Vocabulary:
    """Pieces of a vocabulary file, with scores, ready to count."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.normalize = model.normalize
        self.bytes = any(model.is_byte(i) for i in ids)
        scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in scores) or not self.bytes
        marks = SPACE if any("\n" in piece for piece in scores) else SPACE + "\n"
        self.parts = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{marks}]+|{SPACE}+|\n+")
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a normalised text."""
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for last, piece in self.automaton.iter(text) if len(self.automaton) else ():
            ending[last + 1].append(piece)  # longest first
        score, count, after_unknown = [0.0], [0], [False]
        for end in range(1, len(text) + 1):
            top, pieces, unknown = float("-inf"), 0, False
            for length, own in ending[end]:
                if score[end - length] + own > top:
                    top, pieces = score[end - length] + own, count[end - length] + 1
            if (not ending[end] or ending[end][-1][0] > 1) and score[end - 1] + self.unknown > top:
                top, unknown = score[end - 1] + self.unknown, True
                more = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 0 if after_unknown[end - 1] else 1
                pieces = count[end - 1] + more
            score.append(top)
            count.append(pieces)
            after_unknown.append(unknown)
        return count[-1], score[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text."""
        parts = self.parts.findall(self.normalize(text)) if text else []
        if len(self.counts) > LARGEST_MEMO:
            self.counts.clear()
            self.scores.clear()
        counts = list(map(self.counts.get, parts))
        scores = list(map(self.scores.get, parts))
        if None in counts:
            for k, part in enumerate(parts):
                if counts[k] is None:
                    counts[k], scores[k] = found = self.known(part) or self.best(part)
                    if len(part) <= LONGEST_MEMO:
                        self.counts[part], self.scores[part] = found
        return sum(counts), float(sum(scores))

    def known(self, part: str) -> tuple[int, float] | None:
        return (self.counts[part], self.scores[part]) if part in self.counts else None


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, score of every row; ``vocabulary`` names a file on every machine."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(f"vocabulary {vocabulary}", lambda: Vocabulary(vocabulary))
        for batch in batches:
            found = [known.count(text.as_py()) for text in batch.column(1)]
            columns = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of_batches, "doc_id long, n_tokens long, score double")


ship(__name__)
