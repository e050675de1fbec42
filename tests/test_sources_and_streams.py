"""Sources, sinks and streams."""

from __future__ import annotations

import os
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusward.operators import history, reports, verdict
from corpusward.operators.file_scan import scan_files
from corpusward.plans.audit import audit, collect_findings
from corpusward.schema import FINDING, stamp_run
from corpusward.session import shared_dir
from corpusward.sources import corpus as sources
from corpusward.sources import history as stored
from corpusward.streaming import scans as st

TREE = {
    "one/a.py": b"print(1)\n",
    "one/sub/b.txt": b"TODO\xff x\n",
    "two/requirements.txt": b"x>=1\n",
    "two/big.txt": b"TODO " * 100,
    "two/bad.py": b"x = 1 # \xff\nexcept_ = 2\n",
}


def session_with(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: settings.get(name.replace(".", "_"), default)))


def test_shared_folder_is_the_setting_or_local(spark):
    warehouse = {"spark_sql_warehouse_dir": "hdfs://x/warehouse/"}
    assert shared_dir(session_with(spark_checkpoint_dir="hdfs://x/shared/", spark_master="yarn", **warehouse)) == "hdfs://x/shared"
    assert shared_dir(session_with(spark_master="local[4]", **warehouse)) == "hdfs://x/warehouse/_between"
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(session_with(spark_master=master, **warehouse))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def plant(tmp_path):
    for name, data in TREE.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return str(tmp_path)


def test_tree_source(spark, tmp_path):
    files = sources.read_tree(spark, plant(tmp_path), repo_depth=1, size_limit=200)
    rows = {(r.repo, r.path): r for r in files.collect()}
    assert set(rows) == {tuple(n.split("/", 1)) for n in TREE}
    assert rows[("one", "sub/b.txt")].content == "TODO x\n" and rows[("one", "sub/b.txt")].bad_bytes
    assert rows[("two", "big.txt")].content is None and rows[("two", "big.txt")].size == 500
    found = Counter((r.repo, r.path, r.rule, r.kind) for r in collect_findings(files, size_limit=200).collect())
    assert found[("one", "sub/b.txt", "todo", "finding")] == 1
    assert found[("two", "big.txt", "scan-error", "blocked")] == 1
    assert found[("two", "bad.py", "scan-error", "blocked")] == 1  # not valid UTF-8
    assert found[("two", "requirements.txt", "unpinned-python-dependency", "finding")] == 1
    only = sources.read_tree(spark, str(tmp_path), repo_depth=1, glob="*.py")
    assert {r.path for r in only.collect()} == {"a.py", "bad.py"}


def test_tree_is_written_and_listed_by_few_tasks(spark, tmp_path):
    """A tree goes out and comes back byte by byte under a root with a scheme; its many folders are not a task each."""
    root, wanted = f"file://{tmp_path}/tree", {("repo=a b", f"doc={n}/x%{n}.txt"): bytes([n % 256, 10]) for n in range(300)}
    rows = spark.createDataFrame([(*k, v) for k, v in wanted.items()], "repo string, path string, content binary")
    sources.write_tree(rows, root)
    assert {(p.parent.parent.name, f"{p.parent.name}/{p.name}"): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == wanted
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, group = spark.conf.get(key), str(tmp_path)
    spark.sparkContext.setJobGroup(group, "listing")
    files = sources.read_tree(spark, root, repo_depth=1, glob="*.txt", size_limit=100)
    spark.sparkContext.setJobGroup("", "")
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for job in told.getJobIdsForGroup(group) for s in told.getJobInfo(job).stageIds]
    assert sum(s.numTasks for s in stages) <= 64 and spark.conf.get(key) == before
    got = {(r.repo, r.path): (r.size, r.bad_bytes) for r in files.collect()}
    assert got == {k: (len(v), not valid(v)) for k, v in wanted.items()}


def test_tasks_list_and_read_what_spark_would(spark, tmp_path, monkeypatch):
    """Odd names, links, empty files and folders give the rows of Spark's reader, in batches of any size, and the driver has no list of the files."""
    names = ["a.py", "r/one.txt", "r/.hid", "r/_x/y.txt", "r/_x=1/y.txt", "_metadata_x/z.txt", "_metadata", "r/empty.txt", "r/é ü%41.txt", "r/a=b/c/d/big.txt", ".git/c", "z._COPYING_", "r/new\nline.txt"]
    for n in names:
        target = tmp_path / "t x%20" / n
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"" if "empty" in n else b"x" * 500 if "big" in n else n.encode() + b"\xff")
    root = str(tmp_path / "t x%20")
    os.makedirs(f"{root}/void/none")
    os.symlink(f"{root}/r/a=b", f"{root}/linked")
    os.symlink(f"{root}/nowhere", f"{root}/dead.txt")
    monkeypatch.setattr(sources, "ROWS", 3)
    monkeypatch.setattr(sources, "BYTES", 12)
    for glob, limit in ((None, None), ("{a,o,b,y}*.{py,txt}", 100), ("[a-n]*.t?t", 600), ("*.none", 1)):
        want = sources.listed_by_spark(spark, root, root, glob, limit).select("inner", "size", sources.text.decode(sources.F.col("content")).alias("content"))
        files = sources.read_tree(spark, root, glob=glob, size_limit=limit)
        assert not any("/r/" in f for f in files.inputFiles())
        assert sorted(files.select("path", "size", "content").collect(), key=str) == sorted(want.collect(), key=str)


def valid(content: bytes) -> bool:
    return content.decode("utf-8", "ignore").encode() == content


def test_stored_corpus_prunes_partitions_and_changes_nothing(spark, tmp_path):
    files = sources.read_tree(spark, plant(tmp_path / "tree"), repo_depth=1)
    target = str(tmp_path / "table")
    sources.write_corpus(files, target)
    table = sources.read_corpus(spark, target).withColumn("bad_bytes", F.lit(False))
    key = lambda df: Counter((r.repo, r.path, r.rule, r.line) for r in df.where("path <> 'bad.py'").collect())
    assert key(collect_findings(files)) == key(collect_findings(table))
    plan = sources.of_groups(spark.read.parquet(target), sources.PYTHON)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [language_group" in plan.replace("isnotnull(language_group#", "language_group#") or "language_group" in plan.split("PartitionFilters")[1]


def test_history_round_trip(spark, make_files, tmp_path):
    files = make_files(("a.py", "print(1)\n"), ("SKILL.md", "x"))
    result = audit(files, "2024-01-01-0900")
    runs = stored.run_records(result.decision, result.coverage, reports.verification_record(files))
    target = str(tmp_path / "history")
    stored.write_history(result.findings, runs, target)
    later = audit(make_files(("a.py", "x = 1\n"), ("SKILL.md", "x")), "2024-01-02-0900", previous=stored.read_history(spark, target, "r")[1].withColumn("scanner", F.lit("policy_scan")).withColumn("snippet", F.lit(None).cast("string")))
    got = {(r.rule, r.status) for r in later.comparison.collect()}
    assert ("python-print-call", "resolved") in got and ("missing-gitignore", "carried") in got
    read_runs, read_found = stored.read_history(spark, target)
    (run,) = read_runs.collect()
    assert run.verdict == "NO-GO" and run.coverage.finding_count == read_found.count()
    assert "structure_scan" in run.verification.checks_run


def test_saved_reports_newest_readable_wins(spark, tmp_path):
    whole = '{"root": "r", "decision": {"verdict": "GO"}, "findings": [{"kind": "blocked", "rule": "scan-error", "path": "a"}, {"rule": "todo", "path": "b", "line": 3}]}'
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "2024-01-01-0900-audit.json").write_text(whole)
    (folder / "2024-01-02-0900-audit.json").write_text(whole)
    (folder / "2024-01-03-0900-audit.json").write_text(whole[:60])
    (folder / "notes.txt").write_text("x")
    runs, found = stored.read_saved_reports(spark, str(tmp_path))
    assert {(r.run_id, r.is_valid) for r in runs.collect()} == {("2024-01-01-0900", True), ("2024-01-02-0900", True), ("2024-01-03-0900", False)}
    (newest,) = history.latest_run(runs).collect()
    assert (newest.repo, newest.run_id) == ("r", "2024-01-02-0900")
    rows = {r.run_id: r for r in history.normalise_runs(runs, found).collect()}
    assert (rows["2024-01-02-0900"].finding_count, rows["2024-01-02-0900"].blocked_count, rows["2024-01-02-0900"].checks_run) == (2, 1, [])


def test_findings_as_json(spark, make_files, tmp_path):
    found = stamp_run(scan_files(make_files(("a.txt", "TODO x"))), "1")
    target = str(tmp_path / "json")
    stored.write_findings(found, target, "json")
    (row,) = stored.read_findings(spark, target, "json").collect()
    assert (row.rule, row.line, row.run_id, row.confidence) == ("todo", 1, "1", 0.85)
    assert verdict.verdict(stored.read_findings(spark, target, "json")).collect()[0].verdict == "GO"


def run(stream, folder, of_batch=None):
    st.append_to(stream, f"{folder}/rows", f"{folder}/checkpoint", of_batch).awaitTermination()
    return f"{folder}/rows"


def test_stream_scan_equals_batch(spark, make_files, tmp_path):
    files = make_files(("a.py", "x = eval(y)\n"), ("b.js", "el.addEventListener('x', f)"), ("docs/old.md", "TODO"))
    files.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = st.scan_stream(stream)
    out = spark.read.schema(found.schema).parquet(run(found, str(tmp_path / "out")))
    key = lambda df: Counter((r.path, r.rule, r.line, r.snippet) for r in df.collect())
    assert key(out) == key(scan_files(files)) and out.count() > 2


def test_windows_count_repeats_once_and_forget_late_rows(spark, tmp_path):
    """Four arrivals: a repeat inside the delay is dropped, a row behind the watermark too."""
    def arrival(n, rows):
        df = spark.createDataFrame(rows, "path string, ts string").selectExpr(
            "'r' AS repo", "path", "1 AS line", "'todo' AS rule", "'P2' AS severity", "CAST(concat(ts, 'Z') AS TIMESTAMP) AS ts"
        )
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
        return df.schema

    schema = arrival(1, [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 00:30:00")])
    arrival(2, [("a", "2024-01-01 00:40:00"), ("c", "2024-01-01 05:00:00")])
    arrival(3, [("e", "2024-01-01 09:00:00")])
    arrival(4, [("d", "2024-01-01 00:50:00")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    stored_rows = spark.read.parquet(run(st.unique_findings(stream), str(tmp_path / "out"), st.windowed_counts))
    rows = st.window_totals(stored_rows).selectExpr("hour(to_utc_timestamp(window_start, current_timezone())) AS h", "findings").collect()
    assert {(r.h, r.findings) for r in rows} == {(0, 2), (5, 1), (9, 1)}


def test_open_state_over_runs(spark, tmp_path):
    base = str(tmp_path / "in")
    def arrive(run_id, rules):
        rows = [("r", run_id, "finding", rule, "P2", "Cleanup", "a", None, None, "t", 0.8, None, "stale_scan") for rule in rules]
        spark.createDataFrame(rows, FINDING).coalesce(1).write.mode("append").parquet(base)

    arrive("1", ["x", "y"])
    arrive("2", ["y", "z"])
    stream = spark.readStream.schema(FINDING).option("maxFilesPerTrigger", 1).parquet(base)
    rows = st.span_totals(spark.read.parquet(run(stream, str(tmp_path / "out"), st.finding_spans)))
    latest = spark.createDataFrame([("r", "2")], "repo string, run_id string")
    assert {(r.rule, r.state) for r in st.open_findings(rows, latest).collect()} == {("x", "resolved"), ("y", "open"), ("z", "open")}
