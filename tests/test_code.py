"""Code facts and rules."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import pyarrow as pa
from conftest import SMALL
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusward.operators.code_facts import FACTS, code_facts, fact_batches, file_facts
from corpusward.operators.code_rules import scan_code


def rules_of(make_files, source, path="src/a.py", **more):
    rows = scan_code(code_facts(make_files((path, source))), **more).collect()
    return Counter((r.rule, r.line, r.snippet) for r in rows)


def test_template_goldens(spark):
    from fixtures import templates as tp
    from fixtures.corpus import corpus

    files = corpus(spark, SMALL)
    counts = {r.tid: r["count"] for r in files.groupBy("tid").count().collect()}
    rows = scan_code(code_facts(files)).join(files.select("repo", "path", "tid"), ["repo", "path"]).collect()
    got = Counter((r.tid, r.rule, r.line, None if r.rule == "python-parse-error" else r.snippet) for r in rows)
    want = Counter()
    for tid, rule, line, snippet in tp.CODE_FINDINGS:
        want[(tid, rule, line, snippet)] += counts[tid]
    for tid, rule in tp.CODE_BLOCKED:
        want[(tid, rule, None, None)] += counts[tid]
    assert got == want


def test_body_scope_enters_a_direct_inner_function_once(make_files):
    source = "def f() -> None:\n    '''d'''\n    def g() -> None:\n        '''d'''\n        a = 5\n        def h() -> None:\n            '''d'''\n            b = 7\n"
    got = rules_of(make_files, source, rules=("python-magic-number",))
    assert got == Counter(
        [
            ("python-magic-number", 1, "f numbers without a name: 5"),
            ("python-magic-number", 3, "g numbers without a name: 5, 7"),
            ("python-magic-number", 6, "h numbers without a name: 7"),
        ]
    )


def test_numbers_that_are_no_magic(make_files):
    source = "def f() -> None:\n    '''d'''\n    a = [0, 1, 2.0, True, -9]\n    LIMIT = 30\n    b = Decimal(4)\n    c: int = 8\n    return g(1.5)\n"
    got = rules_of(make_files, source, rules=("python-magic-number",))
    assert got == Counter([("python-magic-number", 1, "f numbers without a name: 1.5, 8")])


def test_calls_count_once_for_each_loop(make_files):
    source = "for a in json.loads(x):\n    while b:\n        open(p)\n    else:\n        json.load(f)\n    class C:\n        json.loads(y)\n    g = lambda: json.loads(z)\n"
    got = rules_of(make_files, source, rules=("expensive-call-in-loop",))
    assert got == Counter(
        {
            ("expensive-call-in-loop", 1, "json.loads"): 1,
            ("expensive-call-in-loop", 3, "open"): 2,
            ("expensive-call-in-loop", 5, "json.load"): 2,
        }
    )


def test_with_context_ends_at_definitions(make_files):
    source = "with open(a) as f:\n    open(b)\n    def g():\n        open(c)\n    h = lambda: open(d)\nx = [open(e)]\np.open()\n"
    got = rules_of(make_files, source, rules=("open-without-context-manager",))
    assert [k[1] for k in got] == [4, 6] or sorted(k[1] for k in got) == [4, 6]


def test_nesting_counts_elif_handlers_and_inner_definitions(make_files):
    source = "def f() -> None:\n    '''d'''\n    try:\n        pass\n    except E:\n        if a:\n            with b:\n                def g() -> None:\n                    '''d'''\n                    for c in d:\n                        pass\n"
    got = rules_of(make_files, source, rules=("python-deep-nesting",))
    assert got == Counter([("python-deep-nesting", 1, "f is nested to depth 4")])


def test_hints_docstrings_and_defaults(make_files):
    source = "class C:\n    def m(self, a, /, b: int, *, x=dict(), **kw):\n        '''  '''\n    def _p(self, x): return\n"
    got = rules_of(make_files, source, with_blocked=False)
    assert got == Counter(
        [
            ("python-missing-type-hints", 2, "m no type for: a, x, **kw, return"),
            ("python-public-function-no-docstring", 2, "m is undocumented"),
            ("python-weak-name", 2, "m vague names: x"),
            ("python-mutable-default", 2, "m shares a default value"),
            ("python-weak-name", 4, "_p vague names: x"),
        ]
    )


def test_from_key_literals(make_files):
    source = f"A.from_key({'ab12cd34' * 8!r})\nA.from_key('0x{'1' * 64}')\nA.from_key(5)\nA.from_key(f'{{k}}')\nA.from_key(k)\nA.from_key()\n"
    got = rules_of(make_files, source, rules=("web3-inline-from-key",))
    assert sorted(k[1] for k in got) == [1, 3, 4]


def test_scopes_and_unreadable_files(spark, make_files):
    files = make_files(
        ("tests/a.py", "try:\n    pass\nexcept Exception:\n    pass\n"),
        ("src/b.py", "x = (\n"),
        ("src/c.py", "a = '\0'\n"),
        ("src/d.txt", "print(1)"),
        ("src/e.py", "f(" * 3000 + ")" * 3000),
    )
    rows = scan_code(code_facts(files)).collect()
    by_path = {}
    for r in rows:
        by_path.setdefault(r.path, set()).add((r.rule, r.kind))
    assert by_path["tests/a.py"] == {("python-except-pass", "finding")}
    assert ("python-parse-error", "finding") in by_path["src/b.py"]
    assert ("scan-error", "blocked") in by_path["src/b.py"]
    assert "src/d.txt" not in by_path
    assert by_path["src/e.py"] & {("scan-error", "blocked"), ("python-parse-error", "finding")}


def test_newlines_are_unified_before_parsing(make_files):
    got = rules_of(make_files, "x = 1\r\rprint(x)\r\n# TODO\r\n", rules=("python-print-call", "python-src-todo"))
    assert got == Counter([("python-print-call", 3, "calls print"), ("python-src-todo", 4, "# TODO")])


def test_facts_leave_in_small_batches():
    """What is held as Python objects does not grow with the files of a batch read, and the facts are those of each file."""
    shape = to_arrow_schema(StructType.fromDDL(FACTS))

    def batch(number):
        rows = [{"repo": "r", "path": f"a{k}.py", "bad_bytes": k % 2 == 0, "source": f"def f{k}(a):\n    return a.b{k}\n# " + " ".join(f"w{k}x{n}" for n in range(200))} for k in range(number)]
        return pa.RecordBatch.from_pylist(rows)

    def peak(number):
        rows = batch(number)
        tracemalloc.start()
        sizes = [out.num_rows for out in fact_batches(iter([rows]), shape)]
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) == number
        return held

    assert peak(1600) < 1.3 * peak(400)
    rows = batch(300)
    got = [row for out in fact_batches(iter([rows, batch(0), rows]), shape) for row in out.to_pylist()]
    one_by_one = [pa.RecordBatch.from_pylist([{**file_facts(r["repo"], r["path"], r["source"]), "bad_bytes": r["bad_bytes"]}], schema=shape).to_pylist()[0] for r in rows.to_pylist()]
    assert got == 2 * one_by_one
