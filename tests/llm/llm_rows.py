"""Awkward rows for the operators."""

from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"

CLASHES = "row key size target taken rest epochs words fingerprint component_id held_out lang_pred answer score piece start length uid shard sequence_id offset filled id next chosen language labelled term".split()

SENTENCE = "The quick brown fox jumps over the lazy dog, and the cat sleeps near the warm stove."
GERMAN = "Der schnelle Fuchs springt über den faulen Hund, und die Katze schläft am warmen Ofen der Küche."

DOCS = [
    (1, SENTENCE, "en", "a"),
    (1, SENTENCE, "en", "a"),  # the same row again
    (2, None, "en", "a"),
    (3, "", "de", "b"),
    (4, " \n\t ", None, "b"),
    (None, GERMAN, "de", None),
    (None, GERMAN, "de", None),
    (None, None, None, None),
    (5, SENTENCE, "en", "b"),  # a copy under another id
    (6, GERMAN + " Ja!", "de", "c"),
    (8, "word " * 40_000, "en", "c"),  # very long
    (9, "x" * 120_000, None, "a"),  # very long without a space
    (10, "12345 --- !!! ###", "en", "c"),
    (12, "Ünïcode   text\x1cwith odd spaces 漢字 🙂 é", "fr", "d"),
    (13, "one", "en", "d"),
    (14, "two words", "en", ""),
    (5, GERMAN, "de", "b"),  # an id with another text
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS, clashes=True):
    from pyspark.sql import functions as F

    full = [(*row, None if row[1] is None else len(row[1])) for row in rows]
    docs = spark.createDataFrame(full, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(7) for c in CLASHES}) if clashes else docs


def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return empty(spark)
