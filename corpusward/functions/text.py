"""Texts as columns: decoding, lines, evidence snippets and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a line.
LINE_ENDS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Unicode white space; the separators x1c to x1f count as such too.
SPACE = r"[\s\x1c-\x1f]"
STRIP = rf"(?U)^{SPACE}+|{SPACE}+\z"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = rf"(?<!{WORD})"
NOT_WORD_AFTER = rf"(?!{WORD})"


def decode(content: Column) -> Column:
    """UTF-8 bytes to text, bad bytes dropped. Valid texts are left as they are.

    In a text that does contain bad bytes, a replacement character of its own is dropped too.
    """
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    )


def unix_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def lines(text: Column) -> Column:
    """Array of the lines of a text, without their ends. An empty text has no lines.

    One closing line end is cut off by length first, so that the split needs no look at
    its last element. Nearly all texts end their lines with a plain newline; splitting
    those by one character is several times faster than by the pattern.
    """
    ending = (
        F.when(text.endswith("\r\n"), F.lit(2))
        .when(F.right(text, F.lit(1)).isin(*LINE_ENDS), F.lit(1))
        .otherwise(F.lit(0))
    )
    body = F.when(ending == 0, text).otherwise(F.left(text, F.length(text) - ending))
    rare = contains_any(text, LINE_ENDS[1:])
    return F.when(text == "", None).when(rare, F.split(body, LINE_BREAK, -1)).otherwise(F.split(body, "\n", -1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    tests = [F.contains(text, F.lit(n)) for n in needles]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def mask_secrets(text: Column, keep: int = 2) -> Column:
    """Hide the inner part of every quoted value of six or more characters.

    ``keep`` characters stay at each end, so that the owner can tell which secret it is.
    A value whose closing quote was cut off is hidden up to the end.
    """
    inner = rf"""([^'"]{{{keep}}})[^'"]{{{max(1, 6 - 2 * keep)},}}([^'"]{{{keep}}})"""
    return F.regexp_replace(text, rf"""(['"]){inner}(\1|\z)""", "$1$2***$3$4")
