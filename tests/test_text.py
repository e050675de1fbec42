"""Column helpers against what Python itself does."""

from __future__ import annotations

from pathlib import PurePosixPath

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusward.functions import paths, text

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", chr(0x2028), chr(0x2029)]
PIECES = st.lists(st.sampled_from(BREAKS + ["a", "b ", "\t", "", chr(0xA0), "\x1f", "é"]), max_size=12).map("".join)
RELAXED = settings(max_examples=8, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])


@RELAXED
@given(st.lists(PIECES, min_size=30, max_size=30))
def test_lines_equal_splitlines(spark, texts):
    rows = [(n, t) for n, t in enumerate(texts)] + [(99, ""), (100, "\n"), (101, "x\r\n\r\n")]
    df = spark.createDataFrame(rows, "n int, t string")
    got = {r.n: r.l or [] for r in df.select("n", text.lines(F.col("t")).alias("l")).collect()}
    assert got == {n: t.splitlines() for n, t in rows}


@RELAXED
@given(st.lists(PIECES, min_size=20, max_size=20))
def test_strip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r.n: r.s for r in df.select("n", text.strip(F.col("t")).alias("s")).collect()}
    assert got == {n: t.strip() for n, t in enumerate(texts)}


def test_suffix_and_stem_follow_pathlib(spark):
    names = ["a.py", ".env", "foo.", ".a.b", "a.tar.gz", "d/x.Y", "d.e/f", "a..b", "..a", "x/.gitignore", "a b.c d"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    rows = df.select("p", paths.suffix(F.col("p")).alias("s"), paths.stem(F.col("p")).alias("t")).collect()
    for r in rows:
        assert (r.s, r.t) == (PurePosixPath(r.p).suffix, PurePosixPath(r.p).stem), r.p


def test_decode_drops_bad_bytes(spark):
    blobs = [b"plain", b"a\xffb", b"a\xe2\x82", b"\xf0\x9f\x98\x80 ok \xc3", "kept \ufffd".encode(), b"\xed\xa0\x80x"]
    df = spark.createDataFrame([(n, bytearray(x)) for n, x in enumerate(blobs)], "n int, b binary")
    got = {r.n: r.t for r in df.select("n", text.decode(F.col("b")).alias("t")).collect()}
    assert got == {n: x.decode("utf-8", errors="ignore") for n, x in enumerate(blobs)}


def test_masking_hides_values_even_without_closing_quote(spark):
    rows = [("token = 'abcdefgh'", "token = 'ab***gh'"), ('k = "abcdefg', 'k = "ab***fg'), ("x = 'ab'", "x = 'ab'")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", text.mask_secrets(F.col("t")).alias("got")).collect():
        assert r.got == r.want
