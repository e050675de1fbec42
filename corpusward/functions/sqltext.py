"""Small helpers for rules written as SQL expressions.

A long expression given as SQL text reaches Spark in one call; built from Column
objects it takes one call per node, which adds up for some fifty rules.
"""

from __future__ import annotations

from collections.abc import Iterable


LONG_S = chr(0x17F)


def quoted(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(expression: str, values: Iterable[str]) -> str:
    return f"coalesce({expression} IN ({', '.join(quoted(v) for v in values)}), false)"


def contains_any(expression: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expression}, {quoted(w)})" for w in words) + ")"


def contains_any_folded(expression: str, lowered: str, words: Iterable[str]) -> str:
    """Guard for case insensitive patterns; ``words`` are in lower case and have no ``i``.

    ``lowered`` is the expression in lower case. A long s also counts as an s in such
    patterns, but lower case keeps it: texts with one pass.
    """
    return f"({contains_any(lowered, words)} OR contains({expression}, {quoted(LONG_S)}))"


def hit(rule: str, line: str = "NULL", snippet: str = "NULL", error: str = "NULL") -> str:
    """SQL form of ``schema.hit``."""
    return (
        f"named_struct('rule', {quoted(rule)}, 'line', CAST({line} AS INT), "
        f"'snippet', CAST({snippet} AS STRING), 'error', CAST({error} AS STRING))"
    )
