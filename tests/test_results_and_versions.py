"""Nested results, version intervals and ignore files against plain Python, other parsers and the version control itself."""

from __future__ import annotations

import json
import random
import subprocess
from collections import defaultdict

import pytest
from packaging.specifiers import SpecifierSet
from packaging.version import Version

from corpusward.operators import ignores, nested, versions


def slow_leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return {k: v for key, inner in value.items() for k, v in slow_leaves(inner, path + (f".{key}" if key.isidentifier() and key.isascii() else "[" + json.dumps(key, ensure_ascii=False) + "]")).items()}
    if isinstance(value, list) and value:
        return {k: v for n, inner in enumerate(value) for k, v in slow_leaves(inner, f"{path}[{n}]").items()}
    return {path: value}


def slow_deltas(before, after):
    b, a = slow_leaves(before), slow_leaves(after)

    def status(path):
        if path not in a:
            return "missing"
        if path not in b:
            return "extra"
        x, y = b[path], a[path]
        numbers = [isinstance(v, (int, float)) and not isinstance(v, bool) for v in (x, y)]
        if all(numbers):
            return "pass" if abs(x - y) < 0.01 else "regression"
        return "pass" if type(x) is type(y) and x == y else "regression"

    return {path: status(path) for path in a.keys() | b.keys()}


def some_value(dice, depth):
    kind = dice.randrange(9 if depth else 6)
    if kind >= 6:
        inner = [some_value(dice, depth - 1) for _ in range(dice.randrange(4))]
        return inner if kind == 6 else dict(zip(dice.sample(["a", "b", "c d", "e.f", 'g"h', "ü", "_x1"], len(inner)), inner))
    return (None, True, False, dice.choice(["", "s", "7"]), dice.randrange(5), round(dice.random(), 4))[kind]


def changed(dice, value):
    if isinstance(value, dict):
        return {k: changed(dice, v) for k, v in value.items() if dice.random() > 0.1}
    if isinstance(value, list):
        return [changed(dice, v) for v in value if dice.random() > 0.1]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value + dice.choice([0, 0.004, 0.5])
    return some_value(dice, 1) if dice.random() < 0.2 else value


def test_nested_results(spark):
    dice = random.Random(2)
    values = [some_value(dice, 4) for _ in range(120)]
    pairs = [(value, changed(dice, value)) for value in values]
    side = lambda n: spark.createDataFrame([("r", str(k), json.dumps(pair[n], ensure_ascii=False)) for k, pair in enumerate(pairs)], "repo string, name string, value string")
    got = defaultdict(dict)
    for r in nested.leaf_deltas(side(0), side(1)).collect():
        got[int(r.name)][r.path] = r.status
    assert dict(got) == {k: slow_deltas(*pair) for k, pair in enumerate(pairs)}


def test_odd_results(spark):
    rows = lambda *r: spark.createDataFrame([("r", *x) for x in r], "repo string, name string, value string")
    before = rows(("null", None), ("broken", "{x"), ("gone", "1"), ("same", "{x"), ("big", "12345678901234567890"), ("deep", "[" * 60 + "1" + "]" * 60))
    after = rows(("null", "null"), ("broken", "1"), ("same", "{x"), ("big", "12345678901234567891"), ("deep", "[" * 60 + "1.5" + "]" * 60))
    got = {(r.name, r.path): r.status for r in nested.leaf_deltas(before, after).collect()}
    assert got == {("null", "$"): "pass", ("broken", "$"): "regression", ("gone", "$"): "missing", ("same", "$"): "pass", ("big", "$"): "pass", ("deep", "$" + "[0]" * 60): "regression"}
    verdicts = {r.name: r.status for r in nested.nested_verdicts(nested.leaf_deltas(before, after)).collect()}
    assert verdicts["same"] == "pass" and verdicts["deep"] == "regression"
    assert nested.leaf_deltas(before.limit(0), after.limit(0)).count() == 0


VERSIONS = "0 0.1 0.9.9 1.0.dev1 1.0a1 1.0a2.dev3 1.0b1 1.0rc1 1.0 1.0.0 1.0.post1.dev2 1.0.post1 1.0.1 1.1 1.1.2 1.2rc1 1.10 2 2.0.0 2.0.0.1 10.2.3 2024.1.15 v1.5".split()


def test_versions_sort_like_versions(spark):
    rows = spark.createDataFrame([(v,) for v in VERSIONS], "v string").select("v", versions.version_key(versions.F.col("v")).alias("k")).collect()
    key = {r.v: r.k for r in rows}
    for a in VERSIONS:
        for b in VERSIONS:
            assert (key[a] < key[b], key[a] == key[b]) == (Version(a) < Version(b), Version(a) == Version(b)), (a, b)


def test_conflicts_are_empty_intersections(spark):
    """Random requirements against every version up to 3.3.3, by another implementation of the rules."""
    dice = random.Random(7)
    every = [f"{a}.{b}.{c}" for a in range(4) for b in range(4) for c in range(4)]
    some = lambda: ".".join(str(dice.randrange(3)) for _ in range(dice.choice([2, 3])))

    def clause():
        op = dice.choice(["==", ">=", "<=", "!=", "~=", ">", "<", "==*", "!=*"])
        return op[:2] + some() + ".*" if op.endswith("*") else op + some()

    rows, wanted = [], {}
    for k in range(150):
        lines = [",".join(clause() for _ in range(dice.choice([1, 1, 2]))) for _ in range(dice.choice([1, 2, 3]))]
        for n, line in enumerate(lines):
            rows.append((f"r{k}", f"requirements{n}.txt", f"# first\nPkg_A [x] {line}  # why\nother"))
        both = SpecifierSet(",".join(lines))
        wanted[f"r{k}"] = not any(both.contains(v) for v in every)
    got = {r.repo: r.conflict for r in versions.intersections(spark.createDataFrame(rows, "repo string, path string, content string")).where("name = 'pkg-a'").collect()}
    # a version between two of the list may still fit, such as 1.2.3.1; so only surely empty ones are called conflicts
    assert all(wanted[r] for r, conflict in got.items() if conflict)
    missed = [r for r, empty in wanted.items() if empty and not got[r]]
    finer = [f"{v}.{d}" for v in every for d in (0, 1, 5)]
    for r in missed:
        both = SpecifierSet(",".join(row[2].split("Pkg_A [x] ")[1].split("  #")[0] for row in rows if row[0] == r))
        assert any(both.contains(v) for v in finer), (r, str(both))


@pytest.mark.parametrize(
    "path, content, name, specs",
    [
        ("requirements-dev.txt", "a.b_c>=1 ; python_version < '3'\na-b-c<1\n-e ./x\nfoo @ git+https://x/y", "a-b-c", {"": "<1", "python_version<'3'": ">=1"}),
        ("pyproject.toml", '[project]\nname="x"\ndependencies=["one>=1", "two [e] ~=2.0"]\n[project.optional-dependencies]\ndev=[\n "one<1",\n]\nother = ["one>3"]\n[tool.x]\ndependencies=["one==9"]', "one", {"": ">=1 <1 >3"}),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.9"\none = "^1.2"\ntwo = {version = "~2", extras = ["x"]}', "two", {"": "~2"}),
        ("package.json", '{"dependencies": {"left": "^1.0.0", "git": "git+ssh://x"}, "devDependencies": {"left": ">= 2.0.0 < 3"}}', "left", {"": "^1.0.0 >=2.0.0,<3"}),
        ("package.json", "{broken", "left", {}),
    ],
)
def test_requirements_of_all_files(spark, path, content, name, specs):
    rows = versions.requirements(spark.createDataFrame([("r", path, content)], "repo string, path string, content string")).where(versions.F.col("name") == name).orderBy("line").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.marker].append(r.spec)
    assert {marker: " ".join(found) for marker, found in got.items()} == specs


def test_node_ranges_conflict(spark):
    def conflict(*ranges):
        sections = dict(zip(versions.NODE_SECTIONS, ({"p": r} for r in ranges)))
        files = spark.createDataFrame([("r", "package.json", json.dumps(sections))], "repo string, path string, content string")
        return [r.conflict for r in versions.intersections(files).collect()] == [True]

    assert conflict("^1.2.0", "^2.0.0") and conflict("~1.2", "1.3.0") and conflict("^0.2.3", "0.3.x") and conflict("1.x", ">=2")
    assert not conflict("^1.2.0", "1.9.1") and not conflict("~1.2.3", ">=1.2.9 <2") and not conflict("*", "7.1.0") and not conflict("1.2", "=1.2.7")
    assert not conflict("^1.0.0 || ^2.0.0", "^3.0.0")  # alternatives say nothing certain


IGNORED = {
    ".gitignore": "*.log\n/build/\n\n# remark\nsecret?.txt\n!keep.log\ndeep/**/x\n**/any/*.c\nlogs/**\n\\#odd\n\\!bang\n[ab]*.md\n[!ab]1.md\nspace\\ \ntrail  \nfoo/*\n!foo/bar.txt\ndata/\n!data/in.txt\n*.p[yz]c\n[z-a]q\na+b(c).txt\n*.{js}\nwild*\\*star",
    "sub/.gitignore": "!*.log\n*.txt\n/only.md\nnested/\n",
    "sub/nested/.gitignore": "!*\n",
    "sub/own/.gitignore": "*\n!.gitignore\n!*/\n!*.py\n",
}
LISTED = """a.log keep.log sub/a.log build/x.c sub/build/x.c secret1.txt secret12.txt sub/secret1.txt deep/x deep/1/x deep/1/2/x deep/1/y any/q.c p/any/q.c any/d/q.c logs/a logs/b/c p/logs/a
#odd !bang a1.md c1.md b/b.md foo/bar.txt foo/other.txt foo/d/bar.txt data/in.txt p/data/in.txt m.pyc m.pzc m.pxc q a+b(c).txt aab(c).txt x.{js} x.js trail wild1*star wild1star
sub/only.md sub/d/only.md sub/x.txt sub/nested/x.py sub/own/x.py sub/own/x.md sub/own/d/x.py sub/own/d/x.md""".split()


def test_coverage_equals_the_version_control(spark, tmp_path):
    """Every path is asked of the tool that the patterns are written for."""
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for path, content in IGNORED.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    for path in LISTED:
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("")
    asked = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "-v", "-n", "--no-index", "--stdin"], input="\n".join(LISTED), capture_output=True, text=True).stdout
    wanted = {}
    for line in asked.splitlines():
        rule, path = line.split("\t")
        source, number, pattern = rule.split(":", 2)
        wanted[path] = None if not source or pattern.startswith("!") else f"{source}:{number} {pattern}"
    rows = [("r", path, content) for path, content in IGNORED.items()] + [("r", path, "") for path in LISTED] + [("other", "a.log", "")]
    got = {(r.repo, r.path): r.ignored_by for r in ignores.ignore_coverage(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got.pop(("other", "a.log")) is None
    assert {path: got["r", path] for path in LISTED if (got["r", path] is None) != (wanted[path] is None)} == {}
    assert {p for p in LISTED if got["r", p]} == {p for p in LISTED if wanted[p]}


def test_risks_that_nothing_ignores(spark):
    rows = [("a", ".gitignore", "*.tmp\n.env"), ("a", ".env", "X"), ("a", "p/.env.local", "X"), ("a", ".env.example", "X"), ("a", "x.tmp", ""), ("a", "x.swp", ""), ("b", "id_rsa", ""), ("b", "k/site.PEM", ""), ("b", "__pycache__/m.py", "")]
    got = {(r.repo, r.path, r.rule) for r in ignores.tracked_risks(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    secret, temporary = "tracked-secret-file", "tracked-temporary-file"
    assert got == {("a", "p/.env.local", secret), ("a", "x.swp", temporary), ("b", "id_rsa", secret), ("b", "k/site.PEM", secret), ("b", "__pycache__/m.py", temporary)}
