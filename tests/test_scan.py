"""File scan: golden files, quirks, and brute force with Python patterns."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest import SMALL
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusward.operators import file_scan as fs
from corpusward.operators.checklist import checklist_lines

# The patterns in Python syntax, for the comparison by brute force.
PYTHON_PATTERNS = {
    "todo": r"\b(TODO|FIXME|HACK|XXX)\b",
    "placeholder": r"(?i)\b(lorem ipsum|changeme|password|123456)\b",
    "debug-call": r"\b(console\.log|debugger|alert|print\()",
    "hardcoded-secret": r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"][^'\"]{6,}",
    "private-key-material": r"-----BEGIN (RSA|EC|OPENSSH|PRIVATE) KEY-----",
    "unsafe-exec": r"\b(eval\(|exec\(|pickle\.loads\(|yaml\.load\()",
    "verify-false": r"\bverify\s*=\s*False\b",
    "http-without-tls": r"(?i)http://[^\s'\"]+",
    "bare-except": r"^\s*except\s*:\s*$",
    "except-pass": r"^\s*pass\s*(#.*)?$",
}
WORDS = [
    "TODO", "xTODO", "password", "PASSWORD", "paßword", "pa\u017f\u017fword", "to\u212aen", "token", " = ", ": ", "'abcdef'", '"abcdefgh', "é", "_", "1", " ", "\xa0",
    "console.log", "print(", "http://", "HTTP://x.y", "except", ":", "pass", "# c", "verify", "=", "False", "eval(", "api-key", "-----BEGIN EC KEY-----", "\u0301", "\t",
]


def found(df):
    return Counter((r.path, r.rule, r.line) for r in df.collect())


@settings(max_examples=6, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([w for w in WORDS if w != "\u0301"]), min_size=1, max_size=7).map("".join), min_size=60, max_size=60))
def test_line_rules_equal_python_search(make_files, lines):
    got = found(fs.scan_files(make_files(("src/a.txt", "\n".join(lines))), tuple(PYTHON_PATTERNS)))
    want = Counter(
        ("src/a.txt", rule, n)
        for n, line in enumerate("\n".join(lines).splitlines(), 1)
        for rule, pattern in PYTHON_PATTERNS.items()
        if re.search(pattern, line)
    )
    assert got == want


def test_combining_mark_is_a_word_edge(make_files):
    got = found(fs.scan_files(make_files(("a.txt", "TODO\u0301 x")), ("todo",)))
    assert got == Counter({("a.txt", "todo", 1): 1})


GOLDEN = {
    9: [("placeholder", 2)],
    10: [],
    15: [("dangerous-dom-write", 1)],
    17: [("dangerous-dom-write", 1), ("token-storage", 2)],
    20: [("wildcard-cors", 1), ("hardcoded-secret", 2), ("verify-false", 3), ("wildcard-cors", 4)],
    21: [("private-key-material", 1), ("private-key-material", 3)],
    22: [("web3-hardcoded-mnemonic", 1), ("web3-hardcoded-private-key", 2), ("web3-address-no-checksum", 3)],
    23: [("os-system", 2), ("unsafe-exec", 3)],
    25: [],
    27: [("placeholder", 1)],
    33: [("except-pass", 8)],
    38: [("web3-hardcoded-private-key", 2)],
}


def test_template_goldens(spark):
    from fixtures.corpus import corpus

    files = corpus(spark, SMALL)
    got = fs.scan_files(files, fs.TEXT_RULES).join(files.select("repo", "path", "tid", "doc_id"), ["repo", "path"]).collect()
    for tid, want in GOLDEN.items():
        per_doc = {}
        for r in got:
            if r.tid == tid:
                per_doc.setdefault(r.doc_id, []).append((r.rule, r.line))
        assert all(sorted(v) == sorted(want) for v in per_doc.values()), tid
        assert bool(per_doc) == bool(want), tid


def test_marker_references_and_size(make_files):
    files = make_files(
        ("a.js", "eval(x) # noqa: audit\neval(y)"),
        ("references/a.md", "`eval(` here\neval(z)"),
        ("tests/a.js", "eval(x)\ndocument.write(x)"),
        ("big.txt", "TODO " * 50),
        ("tests/big.txt", "TODO " * 50),
        ("data/big.txt", "TODO " * 50),
    )
    rules = ("unsafe-exec", "dangerous-dom-write", "todo", "scan-error")
    got = Counter((r.path, r.rule, r.line, r.kind) for r in fs.scan_files(files, rules, size_limit=100).collect())
    assert got == Counter(
        [
            ("a.js", "unsafe-exec", 2, "finding"),
            ("references/a.md", "unsafe-exec", 2, "finding"),
            ("tests/a.js", "dangerous-dom-write", 2, "finding"),
            ("big.txt", "scan-error", None, "blocked"),
            ("tests/big.txt", "scan-error", None, "blocked"),
        ]
    )


def test_wallet_values_are_masked_and_test_keys_left_out(make_files):
    key, ones = "ab12cd34" * 8, "1" * 64
    line = f"a = '0x{key}'; b = \"{key}\"; c = '{ones}'; d = '{'0' * 64}'; e = '0x{key}\""
    rows = fs.scan_files(make_files(("w.py", line)), fs.WALLET_RULES).collect()
    assert [r.snippet for r in rows] == ['"0xab12cd34...cd34"'] * 2
    phrase = " ".join(["able"] * 23 + ["zoo"])
    row = fs.scan_files(make_files(("w.ts", f"m = '{phrase}'")), fs.WALLET_RULES).collect()
    assert [r.snippet for r in row] == ['"able able ... zoo" (24 words)']


def test_path_rules_leave_contents_out_of_the_plan(spark, tmp_path):
    target = str(tmp_path / "files")
    spark.createDataFrame([("r", "docs/old.md", "text")], "repo string, path string, content string").write.parquet(target)
    df = fs.scan_files(spark.read.parquet(target), fs.PATH_RULES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "Exchange hash" not in plan
    assert [r.rule for r in df.collect()] == ["stale-doc-file"]


def test_scan_needs_no_shuffle(spark, make_files):
    plan = fs.scan_files(make_files(("a.py", "x"))).select("rule", "path")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan and "SortMergeJoin" not in plan


def test_context_equals_slices(make_files):
    lines = [f"l{n}" for n in range(40)]
    lines[0], lines[20] = "TODO a", "TODO b"
    rows = fs.scan_with_context(make_files(("a.txt", "\n".join(lines))), ("todo",), reach=3).collect()
    got = {r.line: (r.first_line, list(r.context)) for r in rows}
    assert got == {1: (1, lines[0:4]), 21: (18, lines[17:24])}


def test_rule_table(spark, make_files, monkeypatch):
    schema = "rule string, severity string, category string, pattern string, scope string"
    table = spark.createDataFrame([("mine", "P3", "Code Quality", "z+", "line"), ("other", "P2", "Code Quality", "^b", "line"), ("third", "P2", "Code Quality", "q", "line")], schema)
    want = [("mine", "P3", 1, "mine"), ("other", "P2", 2, "other")]
    for at_once in (300, 1):
        monkeypatch.setattr(fs, "RULES_AT_ONCE", at_once)
        rows = fs.scan_lines_with_table(make_files(("a.txt", "zz\nb")), table).collect()
        assert sorted((r.rule, r.severity, r.line, r.title) for r in rows) == want
    assert fs.scan_lines_with_table(make_files(("a.txt", "zz")), table.limit(0)).collect() == []


def test_large_files_leave_a_row_in_every_scope(make_files):
    big = "document.write(x);\n" * 20
    files = make_files(("build/a.js", big), ("src/a.js", big), ("data/k.ts", big), ("build/a.txt", big), ("src/small.js", "document.write(x)"))
    rows = fs.scan_files(files, ("dangerous-dom-write", "scan-error"), size_limit=100).collect()
    assert {(r.path, r.rule) for r in rows} == {("build/a.js", "scan-error"), ("src/a.js", "scan-error"), ("data/k.ts", "scan-error"), ("src/small.js", "dangerous-dom-write")}
    assert {r.rule for r in fs.scan_files(files, ("dangerous-dom-write", "scan-error"), size_limit=None).collect()} == {"dangerous-dom-write"}


def test_all_hosts_of_a_text(spark):
    row = spark.range(1).select(fs.http_hosts(F.lit("x" * 200 + " http://a.example/b HTTP://c:80 https://d")).alias("h")).first()
    assert row.h == ["a.example", "c"]


def test_checklist_lines(make_files):
    rows = checklist_lines(make_files(("src/a.py", "u = 'https://h/x?a=1&token=2'\nGAS_PRICE = 3"), ("notes.md", "https://h"))).collect()
    assert Counter((r.path, r.rule, r.line) for r in rows) == Counter(
        [("src/a.py", "url-with-key", 1), ("src/a.py", "hardcoded-url", 1), ("src/a.py", "hardcoded-gas-price", 2)]
    )
