"""Verdicts, numbering, merging, comparison: properties and brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusward.catalog import CATEGORIES
from corpusward.operators import fixes, history, reports, review, verdict
from corpusward.schema import FINDING, FINDING_COLUMNS

RULES = ["hardcoded-secret", "todo", "stale-doc-file", "python-weak-name", "missing-gitignore", "python-print-call"]


@pytest.fixture(scope="module")
def findings(spark):
    rng = random.Random(5)
    rows = []
    for n in range(600):
        repo = "big" if n % 3 else f"r{n % 7}"
        kind = "blocked" if rng.random() < 0.02 else "finding"
        rows.append(
            (repo, "2024", kind, rng.choice(RULES), f"P{rng.randint(1, 3)}", rng.choice(CATEGORIES), f"f{rng.randint(0, 30)}", rng.choice([None, 1, 2, 9]), f"s{n}", "t", rng.choice([0.3, 0.6, 0.85]), None, "line_scan")
        )
    return spark.createDataFrame(rows, FINDING).cache()


def test_verdict_is_monotone(findings):
    rows = findings.collect()
    quiet = findings.where(~verdict.stops_release())
    assert {r.verdict for r in verdict.verdict(quiet).collect()} == {"GO"}
    for repo in ("big", "r0"):
        one = next(r for r in rows if r.repo == repo and r.rule == "hardcoded-secret")
        more = quiet.unionByName(findings.where((F.col("repo") == repo) & (F.col("snippet") == one.snippet)))
        assert {r.repo for r in verdict.verdict(more).collect() if r.verdict == "NO-GO"} == {repo}


def test_verdict_reasons_add_up_and_repos_without_findings_go(spark, findings):
    repos = spark.createDataFrame([("big",), ("empty",)], "repo string")
    rows = {r.repo: r for r in verdict.verdict(findings, repos=repos).collect()}
    assert rows["empty"].verdict == "GO" and rows["empty"].reasons == []
    assert sum(x["count"] for x in rows["big"].reasons) == rows["big"].reason_count
    assert verdict.verdict_reasons(findings).where("repo = 'big'").count() == rows["big"].reason_count


def test_documented_policy_leaves_low_confidence_out(findings):
    sure = findings.where("confidence >= 0.5")
    a = {r.repo: r.reason_count for r in verdict.verdict(findings, verdict.DOCUMENTED).collect() if r.reason_count}
    b = {r.repo: r.reason_count for r in verdict.verdict(sure, verdict.DOCUMENTED).collect() if r.reason_count}
    assert a == b


def test_checklist_agrees_with_blocking(findings):
    blocking = Counter((r.repo, r.snippet) for r in verdict.blocking_findings(findings).collect())
    required = Counter((r.repo, r.snippet) for r in verdict.release_checklist(findings).where("due = 'required'").collect())
    assert blocking == required and max(blocking.values()) == 1


def test_summary_maps(findings):
    rows = {r.repo: r for r in reports.summary_maps(findings).collect()}
    want = Counter(r.rule for r in findings.collect() if r.repo == "big")
    assert rows["big"].by_rule == dict(want) and rows["big"].total == sum(want.values())
    assert sum(rows["big"].by_severity.values()) == rows["big"].total


def test_numbers_cross_partitions_without_gaps(findings):
    order = [F.col("path"), F.col("snippet")]
    rows = reports.numbered(findings, [F.col("repo")], order).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.repo].append((r.path, r.snippet, r.number))
    for members in groups.values():
        members.sort()
        assert [m[2] for m in members] == list(range(1, len(members) + 1))


def test_comparison_is_a_partition(spark, findings):
    before, now = findings.where("snippet < 's4'"), findings.where("snippet > 's2'")
    key = lambda df: {(r.repo, r.rule, r.path) for r in df.collect()}
    rows = history.compare_runs(before, now)
    by = {s: key(rows.where(F.col("status") == s)) for s in ("new", "carried", "resolved")}
    assert by["new"] | by["carried"] == key(now) and not by["new"] & by["carried"]
    assert by["resolved"] | by["carried"] == key(before)
    prior = history.prior_status(rows)
    assert prior.count() == len(key(before))
    changed = prior.where("prior_status IN ('downgraded', 'raised')").collect()
    assert all(r.severity != r.previous_severity for r in changed)


def test_last_finding_of_a_key_stands_for_it(spark):
    base = ["r", "1", "finding", "todo", "P2", "Technical Debt", "a"]
    rows = [tuple([*base, line, "s", title, 0.8, None, "line_scan"]) for line, title in ((9, "last"), (3, "first"))]
    (row,) = history.last_per_key(spark.createDataFrame(rows, FINDING)).select("f.*").collect()
    assert row.title == "last"


def test_retention(spark):
    runs = [("a", "1", True), ("a", "2", True), ("a", "3", True), ("b", "1", True), ("b", "2", True), ("b", "3", False), ("c", "1", True)]
    found = [("a", "2", "x", "p"), ("a", "3", "x", "p"), ("b", "1", "x", "p"), ("b", "2", "y", "p"), ("a", "1", "x", "p")]
    plan = history.retention_plan(
        spark.createDataFrame(runs, "repo string, run_id string, is_valid boolean"),
        spark.createDataFrame(found, "repo string, run_id string, rule string, path string"),
    )
    got = {(r.repo, r.run_id): r.plan for r in plan.collect()}
    assert got == {("a", "1"): "drop", ("a", "2"): "keep", ("a", "3"): "keep", ("b", "1"): "drop", ("b", "2"): "keep", ("b", "3"): "keep", ("c", "1"): "keep"}


def test_merge_reviews_equals_brute_force(spark):
    rng = random.Random(9)
    value = {"high": 0.9, "medium": 0.6, "low": 0.3}
    fields = "repo string, reviewer string, category string, severity string, file string, line int, rule string, confidence string, evidence string"
    rows = [
        (rng.choice("ab"), rng.choice("xy"), "Security", f"P{rng.randint(0, 3)}", rng.choice("fg"), rng.choice([None, *range(1, 40)]), rng.choice("uv"), rng.choice(list(value)), f"e{n}")
        for n in range(160)
    ]
    got = Counter(tuple(r) for r in review.merge_reviews(spark.createDataFrame(rows, fields)).collect())
    groups = defaultdict(list)
    for r in rows:
        groups[(r[0], r[4], r[6], r[5] is None)].append(r)
    want = Counter()
    for members in groups.values():
        members.sort(key=lambda r: r[5] or 0)
        clusters = [[members[0]]]
        for r in members[1:]:
            near = (r[5] or 0) - (clusters[-1][-1][5] or 0) <= 3
            clusters[-1].append(r) if near else clusters.append([r])
        for c in clusters:
            want[min(c, key=lambda r: (r[3], -value[r[7]], r[5] or 0, r[1], r[8]))] += 1
    assert got == want


def test_responses(spark):
    good = 'x ```json\n{"agent": "a", "findings": [{"severity": "P0", "file": "f", "line": 3, "rule": "u", "evidence": ""}], "blocked": ["b"], "files_reviewed": ["f", "f"]}\n``` y'
    rows = [("r", "1", good), ("r", "2", "```json\n{\"findings\": [{\"sev\n```"), ("r", "3", "none"), ("r", "4", "```json\n[1]\n```")]
    parsed = review.parse_responses(spark.createDataFrame(rows, "repo string, reviewer string, text string"))
    assert [(r.reviewer, r.file, r.line) for r in review.response_findings(parsed).collect()] == [("1", "f", 3)]
    assert Counter(r.error for r in review.response_blocked(parsed).collect()) == Counter({"b": 1, review.UNREADABLE: 3})
    assert review.files_reviewed(parsed).count() == 1
    assert review.rejected(review.response_findings(parsed)).count() == 1
    assert review.accepted(review.response_findings(parsed)).count() == 0


def test_fix_groups_take_the_deepest_of_a_file(spark, findings):
    fix_map = spark.createDataFrame([("todo", "refactor"), ("python-print-call", "migration")], "rule string, fix_group string")
    rows = fixes.fix_groups(findings, fix_map).collect()
    rank = {"surgical": 0, "migration": 1, "refactor": 2}
    per_file = defaultdict(set)
    for r in rows:
        per_file[(r.repo, r.path)].add((r.fix_group, r.own_group))
    for members in per_file.values():
        assert len({g for g, _ in members}) == 1
        assert max(rank[o] for _, o in members) == rank[next(iter(members))[0]]
    assert len(rows) == findings.count()


def test_number_checks_have_an_open_bound(spark):
    shape = "repo string, name string, value double, text_value string"
    before = spark.createDataFrame([("r", "a", 1.0, None), ("r", "b", 1.0, None), ("r", "c", None, "x"), ("r", "d", 1.0, None)], shape)
    after = spark.createDataFrame([("r", "a", 1.0099, None), ("r", "b", 1.02, None), ("r", "c", None, "y")], shape)
    got = {r.name: r.status for r in fixes.regression_deltas(before, after).collect()}
    assert got == {"a": "pass", "b": "regression", "c": "regression", "d": "regression"}


def test_columns_stay_canonical(findings):
    assert tuple(findings.columns) == FINDING_COLUMNS
    assert review.mask_evidence(findings).columns == findings.columns


def test_clean_repositories_have_all_reports(spark, make_files, tmp_path):
    from corpusward.plans.audit import audit
    from corpusward.sources import history as stored

    tidy = ((".gitignore", ".env\n*.log\n__pycache__/"), ("pyproject.toml", "[project]"))
    files = make_files(*[("clean", *f) for f in tidy], ("dirty", "a.txt", "token = 'abcdef123'"))
    result = audit(files, "2024-01-01-0900")
    assert {(r.repo, r.verdict, r.run_id) for r in result.decision.collect()} == {("clean", "GO", "2024-01-01-0900"), ("dirty", "NO-GO", "2024-01-01-0900")}
    assert [(r.dimension, r["count"]) for r in result.summary.where("repo = 'clean'").collect()] == [("total", 0)]
    sections = reports.section_counts(result.findings, files).where("repo = 'clean'").collect()
    assert len(sections) > 5 and all(r["count"] == 0 and r.note for r in sections)
    records = stored.run_records(result.decision, result.coverage, reports.verification_record(files))
    stored.write_history(result.findings, records, str(tmp_path))
    runs, _ = stored.read_history(spark, str(tmp_path), "clean")
    assert [(r.run_id, r.verdict, r.coverage.finding_count) for r in runs.collect()] == [("2024-01-01-0900", "GO", 0)]
