"""Repository rules, settings and inventory."""

from __future__ import annotations

from collections import Counter

from conftest import SMALL

from corpusward.operators import config, inventory
from corpusward.operators import repo_rules as rr
from corpusward.plans.audit import collect_findings


def rules(df):
    return Counter((r.repo, r.rule) for r in df.collect())


def test_expected_repositories(spark):
    from fixtures.corpus import corpus

    files = corpus(spark, SMALL).where("repo LIKE 'r%'")  # the tidy repositories start with t
    got = rules(rr.scan_repos(rr.repo_profile(files), check_gate=False))
    repos = range(5)
    want = Counter()
    for n in repos:
        add = lambda rule, when: when and want.update([(f"r{n}", rule)])
        add("missing-gitignore", n % 3 == 0)
        add("gitignore-missing-dotenv", n % 3 == 1)
        add("gitignore-missing-logs", n % 3 == 2)
        add("gitignore-missing-pycache", n % 3 == 2)
        add("tracked-env-risk", n % 6 == 4)
        add("missing-dependency-manifest", n % 4 == 3 and n % 8 != 7)
        add("missing-skill-md", n % 2 == 0)
        add("missing-openai-yaml", n % 8 in (3, 5))
        add("missing-references-dir", n % 5 == 0 and n % 4 in (1, 3))
        add("missing-scripts-dir", n % 7 == 0 and n % 4 in (1, 3))
        add("invalid-skill-frontmatter", n % 4 == 3)
    assert got == want


def test_header_accepts_windows_newlines_and_needs_both_fields(make_files):
    files = make_files(
        ("a", "SKILL.md", "---\r\nname: x\r\ndescription: y\r\n---\r\n"),
        ("b", "SKILL.md", "---\nname: x\n---\n"),
        ("c", "sub/SKILL.md", "---\nname: x\n---\n"),
    )
    got = rules(rr.profile_findings(rr.repo_profile(files), rr.STRUCTURE_RULES))
    headers = {repo for repo, rule in got if rule == "invalid-skill-frontmatter"}
    assert headers == {"b"}
    assert got[("c", "missing-skill-md")] == 1 and sum(n for (repo, _), n in got.items() if repo == "c") == 1


def test_dependency_lines_wait_for_a_root_manifest(make_files):
    files = make_files(
        ("a", "sub/requirements-dev.txt", "x>=1"),
        ("b", "sub/requirements-dev.txt", " x >= 1  # keep\n# y>1\n\n-e .\nz @ https://h"),
        ("b", "package.json", "{}"),
        ("c", "yarn.lock", "'latest'"),
    )
    profile = rr.repo_profile(files)
    got = Counter((r.repo, r.rule, r.line, r.snippet) for r in rr.scan_dependencies(files, profile).collect())
    assert got == Counter(
        [
            ("b", "unpinned-python-dependency", 1, "x >= 1  # keep"),
            ("b", "direct-dependency-reference", 4, "-e ."),
            ("b", "direct-dependency-reference", 5, "z @ https://h"),
        ]
    )


def test_suppress_then_override_equals_override_then_suppress(spark, make_files):
    found = collect_findings(make_files(("a.py", "print(1)\npass\nverify=False"), ("b.py", "print(2)")))
    overrides = spark.createDataFrame([(None, "python-print-call", "P0"), ("r", "python-print-call", "P3"), (None, "verify-false", "P0")], config.OVERRIDES)
    suppressions = spark.createDataFrame([(None, "a.py", "python-print-call"), ("other", "b.py", "python-print-call")], config.SUPPRESSIONS)
    one = config.apply_config(found, overrides, suppressions)
    two = config.suppress(config.override_severity(found, overrides), suppressions)
    shown = lambda df: Counter((r.path, r.rule, r.severity, r.line) for r in df.collect())
    assert shown(one) == shown(two)
    assert shown(one)[("b.py", "python-print-call", "P3", 1)] == 1
    assert not [k for k in shown(one) if k[:2] == ("a.py", "python-print-call")]
    assert shown(config.apply_config(found, config.no_overrides(spark), config.no_suppressions(spark))) == shown(found)
    listed = spark.createDataFrame([("a.py", ["python-print-call", "todo"])], "path string, rules array<string>")
    assert {(r.path, r.rule) for r in config.suppression_rows(listed).collect()} == {("a.py", "python-print-call"), ("a.py", "todo")}


def test_inventory_order_of_cases(make_files):
    want = {
        ".env": ("other", "tooling-or-build-directory"),
        "tests/a.md": ("tests", None),
        "x.min.js": ("source", "minified-asset"),
        "lib.egg-info/a.txt": ("other", "tooling-or-build-directory"),
        "yarn.lock": ("other", "service-file"),
        "a.PNG": ("binary", "binary-file"),
        "a.py.BAK": ("other", "temp-or-backup-file"),
        ".github/x.yml": ("ci", "tooling-or-build-directory"),
        "Dockerfile": ("infra", None),
        "src/.env.local": ("other", "service-file"),
        "conf/a.env": ("config", None),
    }
    rows = inventory.inventory(make_files(*[(p, "") for p in want])).collect()
    assert {r.path: (r.category, r.skip_reason) for r in rows} == want
    assert all(r.should_review_deeply == (r.skip_reason is None) for r in rows)
