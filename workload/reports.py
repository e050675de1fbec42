"""Settings, verdicts, summaries, runs and fix plans over all findings of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward import catalog
from corpusward.functions.tables import dimension
from corpusward.operators import changes, config, fixes, history, reports, review, verdict
from corpusward.operators.file_scan import scan_files, scan_with_context
from corpusward.plans.audit import collect_findings
from corpusward.schema import compact, stamp_run
from corpusward.session import fresh_path, written
from corpusward.sources.history import read_findings, read_history, run_id_of, run_records, write_findings, write_history
from fixtures.corpus import corpus
from workload import expected
from workload import sqlbase as b
from workload.scans import category_case, doc_files, shown, shown_sql
from workload.sqlbase import q, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


RUN = "2024-01-01-0900"


def all_findings(spark, sf_dir) -> DataFrame:
    return stamp_run(collect_findings(corpus(spark, sf_dir)), RUN)


def stored_findings(spark, sf_dir) -> DataFrame:
    """The findings written once, for reports that read them more than once."""
    return written(all_findings(spark, sf_dir), "findings")


OVERRIDES = (("verify-false", "P0"), ("python-print-call", "P3"))
SUPPRESSIONS = (("Dockerfile", "todo"), ("references/rules.md", "placeholder"), ("package.json", "floating-dependency-version"))


def settings(spark):
    overrides = dimension(spark, [dict(zip(("rule", "severity"), r)) for r in OVERRIDES])
    suppressions = dimension(spark, [dict(zip(("path", "rule"), r)) for r in SUPPRESSIONS])
    return overrides, suppressions


@query(
    sql(
        f"""SELECT rule, severity, count(*) AS findings FROM (
SELECT f.rule, coalesce(o.severity, f.severity) AS severity FROM findings f LEFT JOIN ({b.values(OVERRIDES)}) AS o(rule, severity) ON f.rule = o.rule
WHERE NOT EXISTS (SELECT 1 FROM ({b.values(SUPPRESSIONS)}) AS s(path, rule) WHERE s.path = f.path AND s.rule = f.rule)) GROUP BY ALL"""
    )
)
def config_applied(spark, sf_dir):
    out = config.apply_config(all_findings(spark, sf_dir), *settings(spark))
    return out.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


@query(
    sql(
        """SELECT repo, CASE WHEN grouping(rule) = 0 THEN 'rule' WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS dimension,
coalesce(rule, severity, category, 'total') AS name, count(*) AS count FROM findings GROUP BY GROUPING SETS ((repo, rule), (repo, severity), (repo, category), (repo))
UNION ALL SELECT DISTINCT repo, 'total', 'total', 0 FROM corpus WHERE repo NOT IN (SELECT repo FROM findings)"""
    )
)
def finding_summary(spark, sf_dir):
    return reports.finding_summary(stored_findings(spark, sf_dir), corpus(spark, sf_dir))


COVERAGE_SQL = f"""SELECT repo, total_files, reviewed_files, skipped_files, coalesce(finding_count, 0) AS finding_count, coalesce(blocked_count, 0) AS blocked_count,
coalesce(tech_debt_count, 0) AS tech_debt_count, coalesce(cleanup_count, 0) AS cleanup_count FROM
(SELECT repo, count(*) AS total_files, count(*) FILTER (skip_reason IS NULL) AS reviewed_files, count(*) FILTER (skip_reason IS NOT NULL) AS skipped_files FROM listed GROUP BY repo)
LEFT JOIN (SELECT repo, count(*) AS finding_count, count(*) FILTER (kind = 'blocked') AS blocked_count,
count(*) FILTER (rule IN ({b.names(expected.TECH_DEBT_RULES)})) AS tech_debt_count, count(*) FILTER (rule IN ({b.names(expected.CLEANUP_RULES)})) AS cleanup_count FROM findings GROUP BY repo) USING (repo)"""


@query(sql(COVERAGE_SQL))
def coverage(spark, sf_dir):
    return reports.coverage(corpus(spark, sf_dir), all_findings(spark, sf_dir))


STOPS = (
    f"(kind = 'blocked' OR severity = 'P0' OR rule IN ({b.names(expected.STOP_RULES)}) "
    f"OR (severity = 'P1' AND category IN ({b.names(expected.STOP_CATEGORIES)})))"
)
STOPS_DOC = f"(confidence >= 0.5 AND (kind = 'blocked' OR severity = 'P0' OR rule IN ({b.names(expected.DOCUMENTED_STOP_RULES)})))"


def verdict_sql(stops: str) -> str:
    return f"""SELECT repo, CASE WHEN sum(n) > 0 THEN 'NO-GO' ELSE 'GO' END AS verdict, CAST(coalesce(sum(n), 0) AS BIGINT) AS reason_count,
coalesce(string_agg(rule || ':' || n, ',' ORDER BY rule) FILTER (n > 0), '') AS reasons
FROM (SELECT DISTINCT repo FROM corpus) LEFT JOIN (SELECT repo, rule, count(*) FILTER ({stops}) AS n FROM findings GROUP BY repo, rule) USING (repo) GROUP BY repo"""


def flat_verdict(out: DataFrame) -> DataFrame:
    reasons = F.transform("reasons", lambda r: F.concat(r["rule"], F.lit(":"), r["count"].cast("string")))
    return out.select("repo", "verdict", "reason_count", F.array_join(reasons, ",").alias("reasons"))


@query(sql(verdict_sql(STOPS)))
def verdict_code(spark, sf_dir):
    return flat_verdict(verdict.verdict(all_findings(spark, sf_dir), repos=corpus(spark, sf_dir), run_id=RUN))


@query(sql(verdict_sql(STOPS_DOC)))
def verdict_documented(spark, sf_dir):
    return flat_verdict(verdict.verdict(all_findings(spark, sf_dir), verdict.DOCUMENTED, corpus(spark, sf_dir), RUN))


@query(sql(f"SELECT repo, path, rule, CAST(line_no AS BIGINT) AS line FROM findings WHERE {STOPS}"))
def verdict_reasons(spark, sf_dir):
    rows = verdict.verdict_reasons(all_findings(spark, sf_dir))
    return rows.select("repo", "path", "rule", F.col("line_rank").cast("long").alias("line"))


BLOCKING = f"severity = 'P0' OR kind = 'blocked' OR (repo, rule) IN (SELECT (repo, rule) FROM findings WHERE {STOPS})"


SOFTENED = {"softened": "SELECT * REPLACE (CASE WHEN rule IN ('debug-call', 'http-without-tls', 'bare-except') AND doc_id // 40 % 2 = 0 THEN 'P3' ELSE severity END AS severity) FROM findings"}


@query(sql(f"SELECT repo, path, rule, CAST(line_no AS BIGINT) AS line FROM softened WHERE {BLOCKING.replace('findings', 'softened')}", SOFTENED))
def blocking_findings(spark, sf_dir):
    """With some findings of a stopping rule weakened: the rule brings them in all the same."""
    found = stored_findings(spark, sf_dir)
    weak = F.col("rule").isin("debug-call", "http-without-tls", "bare-except") & (F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long") % 80 < 40)
    return shown(verdict.blocking_findings(found.withColumn("severity", F.when(weak, "P3").otherwise(F.col("severity"))))).drop("snippet")


@query(sql(f"SELECT repo, rule, CASE WHEN {BLOCKING} THEN 'required' ELSE 'optional' END AS due, count(*) AS findings FROM findings GROUP BY ALL"))
def release_checklist(spark, sf_dir):
    rows = verdict.release_checklist(stored_findings(spark, sf_dir))
    return rows.groupBy("repo", "rule", "due").agg(F.count("*").alias("findings"))


CATEGORY_RANKS = b.values(list(zip(expected.CATEGORIES, range(len(expected.CATEGORIES)))))


@query(
    sql(
        f"SELECT repo, path, rule, CAST(line_no AS BIGINT) AS line, CAST(category_rank AS BIGINT) AS category_rank, CAST(right(severity, 1) AS BIGINT) AS severity_rank "
        f"FROM findings JOIN ({CATEGORY_RANKS}) AS c(category, category_rank) USING (category)"
    )
)
def report_rows(spark, sf_dir):
    rows = reports.report_rows(all_findings(spark, sf_dir))
    return shown(rows, F.col("category_rank").cast("long").alias("category_rank"), F.col("severity_rank").cast("long").alias("severity_rank")).drop("snippet")


@query(
    sql(
        f"""SELECT repo, category, count(f.rule) AS count, CASE WHEN count(f.rule) = 0 THEN 'nothing found' ELSE '' END AS note
FROM (SELECT DISTINCT repo FROM corpus) r CROSS JOIN ({CATEGORY_RANKS}) AS c(category, category_rank) LEFT JOIN findings f USING (repo, category) GROUP BY repo, category"""
    )
)
def section_counts(spark, sf_dir):
    return reports.section_counts(all_findings(spark, sf_dir), corpus(spark, sf_dir)).select("repo", "category", "count", "note")


@query(
    sql(
        f"""SELECT repo, path, rule, CAST(line_no AS BIGINT) AS line, bucket || '-' || row_number() OVER (
PARTITION BY repo, bucket ORDER BY coalesce(category_rank, 8), path, line_no, rule, coalesce(snippet, '')) AS display_id
FROM (SELECT *, CASE WHEN confidence >= 0.5 THEN severity ELSE '?' END AS bucket FROM findings) LEFT JOIN ({CATEGORY_RANKS}) AS c(category, category_rank) USING (category)"""
    )
)
def display_ids(spark, sf_dir):
    return shown(reports.with_display_ids(stored_findings(spark, sf_dir)), "display_id").drop("snippet")


@query(
    sql(
        f"""SELECT repo, '2024-01-01' AS report_date, CASE WHEN coalesce(stops, 0) > 0 THEN 'NO-GO' ELSE 'GO' END AS verdict, total_files, reviewed_files, skipped_files, blocked_count,
coalesce(p0, 0) AS p0_count, coalesce(p1, 0) AS p1_count, coalesce(p2, 0) AS p2_count, coalesce(p3, 0) AS p3_count
FROM ({COVERAGE_SQL}) LEFT JOIN (SELECT repo, count(*) FILTER ({STOPS}) AS stops, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1,
count(*) FILTER (severity = 'P2') AS p2, count(*) FILTER (severity = 'P3') AS p3 FROM findings GROUP BY repo) USING (repo)"""
    )
)
def header_rows(spark, sf_dir):
    return reports.header_rows(corpus(spark, sf_dir), stored_findings(spark, sf_dir), "2024-01-01")


@query(
    sql(
        "SELECT repo, path FROM listed WHERE skip_reason IS NULL AND category <> 'source' "
        "AND (repo, path) NOT IN (SELECT (repo, path) FROM findings WHERE kind = 'blocked')"
    )
)
def coverage_gaps(spark, sf_dir):
    """Files nobody looked at when the reviewers only took the sources."""
    from corpusward.operators.inventory import inventory

    files = corpus(spark, sf_dir)
    seen = inventory(files).where("should_review_deeply AND category = 'source'")
    return reports.coverage_gaps(files, seen, all_findings(spark, sf_dir))


@query(
    sql(
        f"SELECT repo, {q(','.join(expected.RUN_STEPS))} || CASE WHEN has_skill THEN ',structure_scan' ELSE '' END AS checks_run, '' AS history_source FROM profile"
    )
)
def verification_record(spark, sf_dir):
    rows = reports.verification_record(corpus(spark, sf_dir))
    return rows.select("repo", F.array_join("checks_run", ",").alias("checks_run"), F.coalesce("history_source", F.lit("")).alias("history_source"))


GROUP_OF = b.values(expected.SCANNERS)


@query(sql(f'SELECT repo, "group", scanner, count(*) AS findings FROM findings JOIN ({GROUP_OF}) AS g(scanner, "group") USING (scanner) GROUP BY ALL'))
def scanner_routing(spark, sf_dir):
    rows = reports.scanner_routing(all_findings(spark, sf_dir))
    return rows.groupBy("repo", "group", "scanner").agg(F.count("*").alias("findings"))


def fix_case() -> str:
    cases = " ".join(f"WHEN rule IN ({b.names(rules)}) THEN {n}" for n, rules in ((2, expected.MIGRATION_RULES), (3, expected.REFACTOR_RULES)))
    return f"CASE {cases} ELSE 1 END"


FIX_SQL = f"SELECT *, ['surgical', 'migration', 'refactor'][max({fix_case()}) OVER (PARTITION BY repo, path)] AS fix_group FROM findings"


@query(sql(f"SELECT repo, path, rule, fix_group, count(*) AS findings FROM ({FIX_SQL}) GROUP BY ALL"))
def fix_groups(spark, sf_dir):
    rows = fixes.fix_groups(stored_findings(spark, sf_dir))
    return rows.groupBy("repo", "path", "rule", "fix_group").agg(F.count("*").alias("findings"))


MASKED = r"""regexp_replace(regexp_replace(snippet, '''([^''"]{2})[^''"]{2,}([^''"]{2})(''|$)', '''\1***\2\3', 'g'), '"([^''"]{2})[^''"]{2,}([^''"]{2})("|$)', '"\1***\2\3', 'g')"""


@query(
    sql(
        f"""SELECT repo, path, CAST(line AS BIGINT) AS line, {MASKED} AS snippet FROM (
SELECT source AS repo, 'doc_' || doc_id || '.txt' AS path, line, left({b.stripped()}, 160) AS snippet FROM doc_lines WHERE {b.has(dict(b.LINE_PATTERNS)['hardcoded-secret'])})
UNION ALL SELECT repo, path, CAST(line AS BIGINT), {MASKED} FROM line_hits WHERE rule IN ('hardcoded-secret', 'token-storage', 'sensitive-log-field')""",
        {"doc_lines": b.lines_of("(SELECT source, doc_id, text AS content FROM documents)", "source, doc_id")},
    )
)
def masked_evidence(spark, sf_dir):
    found = scan_files(doc_files(spark, sf_dir), ("hardcoded-secret",)).unionByName(
        scan_files(corpus(spark, sf_dir), ("hardcoded-secret", "token-storage", "sensitive-log-field"))
    )
    return shown(review.mask_evidence(found)).drop("rule")


@query(
    sql(
        f"""SELECT h.source AS repo, 'doc_' || h.doc_id || '.txt' AS path, CAST(h.line AS BIGINT) AS line, CAST(greatest(h.line - 10, 1) AS BIGINT) AS first_line,
string_agg(l.text, chr(10) ORDER BY l.line) AS context
FROM (SELECT DISTINCT source, doc_id, line FROM doc_lines WHERE {b.has(dict(b.LINE_PATTERNS)['hardcoded-secret'])}) h
JOIN doc_lines l ON l.doc_id = h.doc_id AND l.line BETWEEN h.line - 10 AND h.line + 10 GROUP BY ALL""",
        {"doc_lines": b.lines_of("(SELECT source, doc_id, text AS content FROM documents)", "source, doc_id")},
    )
)
def hit_context(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    rows = review.hit_context(files, scan_files(files, ("hardcoded-secret",)))
    return rows.select("repo", "path", F.col("line").cast("long").alias("line"), F.col("first_line").cast("long").alias("first_line"), F.array_join("context", "\n").alias("context"))


@query(ORACLES["hit_context"])
def scan_context(spark, sf_dir):
    """The same context taken while scanning, without a join."""
    rows = scan_with_context(doc_files(spark, sf_dir), ("hardcoded-secret",))
    return rows.select("repo", "path", F.col("line").cast("long").alias("line"), F.col("first_line").cast("long").alias("first_line"), F.array_join("context", "\n").alias("context"))


# priority, rule, path pattern, line pattern, action
# Rows of a project, beside those of the library.
CONTEXT_RULES = (
    (11, None, r"(^|/)[.]env[.]example$", None, "drop"),
    (11, "http-without-tls", None, r"example[.]com|a[.]example", "low"),
    (12, "python-print-call", "^scripts/", None, "drop"),
    (20, "python-print-call", "^scripts/tool_", None, "keep"),
    (5, "placeholder", "^README", None, "low"),
)


def context_case() -> str:
    cases = []
    for _, rule, path, line, action in sorted(expected.CONTEXT_TABLE + CONTEXT_RULES, key=lambda r: -r[0]):
        tests = [f"rule = {q(rule)}"] if rule else []
        tests += [b.has(path, "path")] if path else []
        tests += [b.has(line, "coalesce(snippet, '')")] if line else []
        cases.append(f"WHEN {' AND '.join(tests)} THEN {q(action)}")
    return f"CASE {' '.join(cases)} ELSE 'keep' END"


@query(
    sql(
        f"""SELECT repo, rule, CASE WHEN action = 'low' THEN least(confidence, CAST(0.3 AS DOUBLE)) ELSE confidence END AS confidence, count(*) AS findings
FROM (SELECT *, {context_case()} AS action FROM findings) WHERE action <> 'drop' GROUP BY ALL"""
    )
)
def context_filtered(spark, sf_dir):
    fields = ("priority", "rule", "path_regex", "line_regex", "action")
    table = dimension(spark, [dict(zip(fields, r)) for r in CONTEXT_RULES])
    rows = review.apply_context(all_findings(spark, sf_dir), review.default_context_rules(spark).unionByName(table, allowMissingColumns=True))
    return rows.groupBy("repo", "rule", "confidence").agg(F.count("*").alias("findings"))


# Two runs of the audit: each snapshot lacks another part of the files.
RUN_1, RUN_2 = "(doc_id + repo_no) % 5 <> 0", "(doc_id + repo_no) % 5 <> 1"


def two_runs(spark, sf_dir):
    """One audit over both snapshots, told apart by a mark before the repository."""
    files = corpus(spark, sf_dir)
    marks = F.array_compact(F.array(F.when(F.expr(RUN_1), F.lit("1|")), F.when(F.expr(RUN_2), F.lit("2|"))))
    marked = files.withColumn("mark", F.explode(marks)).withColumn("repo", F.concat("mark", "repo")).drop("mark")
    found = written(collect_findings(marked), "two_runs")
    of_run = lambda mark: found.where(F.col("repo").startswith(mark)).withColumn("repo", F.expr("substring(repo, 3)"))
    first = stamp_run(of_run("1|"), "2024-01-01-0900")
    second = stamp_run(of_run("2|"), "2024-02-01-0900")
    raised = F.when(F.col("rule") == "placeholder", "P1").when(F.col("rule") == "http-without-tls", "P3").otherwise(F.col("severity"))
    return first, second.withColumn("severity", raised)


RUNS = {**b.snapshot("_r1", RUN_1), **b.snapshot("_r2", RUN_2)}
KEYS_1 = "SELECT repo, rule, path, any_value(severity) AS s FROM findings_r1 GROUP BY ALL"
KEYS_2 = "SELECT repo, rule, path, any_value(CASE WHEN rule = 'placeholder' THEN 'P1' WHEN rule = 'http-without-tls' THEN 'P3' ELSE severity END) AS s, max(line_no) AS last_line FROM findings_r2 GROUP BY ALL"
DIFF = f"""SELECT repo, rule, path, CASE WHEN a.s IS NULL THEN 'new' WHEN c.s IS NULL THEN 'resolved' ELSE 'carried' END AS status,
coalesce(a.s, '') AS previous_severity, coalesce(c.s, a.s) AS severity FROM ({KEYS_1}) a FULL JOIN ({KEYS_2}) c USING (repo, rule, path)"""


@query(sql(DIFF, RUNS))
def run_diff(spark, sf_dir):
    rows = history.compare_runs(*two_runs(spark, sf_dir))
    return rows.select("repo", "rule", "path", "status", F.coalesce("previous_severity", F.lit("")).alias("previous_severity"), "severity")


@query(
    sql(
        f"SELECT repo, count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status = 'carried') AS carried_count, count(*) FILTER (status = 'resolved') AS resolved_count FROM ({DIFF}) GROUP BY repo",
        RUNS,
    )
)
def run_progress(spark, sf_dir):
    return history.progress(history.compare_runs(*two_runs(spark, sf_dir)))


@query(
    sql(
        f"""SELECT repo, rule, path, previous_severity, severity, CASE WHEN status = 'resolved' THEN 'fixed' WHEN severity > previous_severity THEN 'downgraded'
WHEN severity < previous_severity THEN 'raised' ELSE 'remaining' END AS prior_status FROM ({DIFF}) WHERE status <> 'new'""",
        RUNS,
    )
)
def prior_status(spark, sf_dir):
    return history.prior_status(history.compare_runs(*two_runs(spark, sf_dir)))


@query(
    sql(
        """SELECT a.repo, a.path, coalesce(a.line, 0) AS line, a.kind, a.severity FROM (
SELECT repo, rule, path, max(line_no) AS last FROM findings GROUP BY ALL) k JOIN findings a ON a.repo = k.repo AND a.rule = k.rule AND a.path = k.path AND a.line_no = k.last GROUP BY ALL"""
    ).replace("SELECT a.repo, a.path, coalesce(a.line, 0) AS line, a.kind, a.severity FROM", "SELECT a.repo, a.rule, a.path, CAST(a.line_no AS BIGINT) AS line, a.kind, a.severity FROM")
)
def last_per_key(spark, sf_dir):
    """The finding that stands for its key in a comparison: the last one in report order."""
    rows = history.last_per_key(all_findings(spark, sf_dir)).select("repo", "rule", "path", "f.*")
    return rows.select("repo", "rule", "path", F.coalesce("line", F.lit(0)).cast("long").alias("line"), "kind", "severity")


CHANGED_TEXT = "CASE WHEN tid IN (18, 39) THEN content || chr(10) || 'changed' ELSE content END"


@query(
    sql(
        f"""SELECT repo, path, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT repo, path, content FROM corpus WHERE {RUN_1}) o FULL JOIN (SELECT repo, path, {CHANGED_TEXT} AS content FROM corpus WHERE {RUN_2}) n USING (repo, path)
WHERE o.content IS DISTINCT FROM n.content"""
    )
)
def snapshot_diff(spark, sf_dir):
    files = corpus(spark, sf_dir)
    after = files.where(RUN_2).withColumn("content", F.when(F.col("tid").isin(18, 39), F.concat("content", F.lit("\nchanged"))).otherwise(F.col("content")))
    return history.snapshot_diff(files.where(RUN_1), after)


@query(
    sql(
        f"""SELECT repo, path, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT repo, path, content FROM corpus WHERE {RUN_1}) o FULL JOIN (SELECT repo, path, {CHANGED_TEXT} AS content FROM corpus WHERE {RUN_2}) n USING (repo, path)
WHERE o.content IS DISTINCT FROM n.content AND (repo, path) IN (SELECT (repo, path) FROM findings_r1)""",
        RUNS,
    )
)
def changed_with_findings(spark, sf_dir):
    return history.changed_with_findings(snapshot_diff(spark, sf_dir), two_runs(spark, sf_dir)[0])


# The second snapshot with a dummy value below some of its files.
EDITED_TEXT = "CASE WHEN tid IN (18, 39, 1000, 1002) THEN content || chr(10) || 'changeme' ELSE content END"
EDITED = {**b.snapshot("_e", "true"), "corpus_e": f"SELECT * REPLACE ({EDITED_TEXT} AS content) FROM corpus WHERE {RUN_2}"}
PATH_LINE, PATH_WEB, PATH_WALLET = (scope.split(" AND NOT contains(text")[0] for scope in (b.LINE_SCOPE, b.WEB_SCOPE, b.WALLET_SCOPE))
SKIPPED_PATH = f"{b.any_part(expected.SKIP_DIRS)} OR {b.LOWER_SUFFIX} IN ({b.names(expected.BINARY_SUFFIXES)}) OR contains({b.NAME}, '.min.')"
DEBT_SKIPPED = ("__pycache__", ".git", ".venv", "build", "dist", "docs", "references", "tests")
# All ways in which rules treat a path.
PATH_CLASS = "concat(" + ", '|', ".join(
    f"({test})"
    for test in (
        PATH_LINE, f"{b.SUFFIX} <> '.py'", f"({category_case()}) = 'source'", "contains(lower(path), 'test')", PATH_WEB, PATH_WALLET, b.REQ, b.MANIFEST,
        f"{b.LOWER_SUFFIX} IN ('.js', '.jsx', '.ts', '.tsx')", "ends_with(path, '.py')", f"{b.SUFFIX} = '.py' AND NOT {b.any_part(DEBT_SKIPPED)}", f"{b.FIRST} = 'references'", SKIPPED_PATH,
    )
) + ")"


def audited_changes(spark, sf_dir):
    """A first audit of one snapshot, then one of the other, which scans what the first has not seen."""
    files, folder = corpus(spark, sf_dir), fresh_path(spark, "kept")
    changes.audit_changes(files.where(RUN_1), folder)
    edited = F.when(F.col("tid").isin(18, 39, 1000, 1002), F.concat("content", F.lit("\nchangeme"))).otherwise(F.col("content"))
    return changes.audit_changes(files.where(RUN_2).withColumn("content", edited), folder)


@query(sql("SELECT repo, path, rule, CAST(line_no AS BIGINT) AS line, kind, severity FROM findings_e", EDITED))
def audit_of_changes(spark, sf_dir):
    """The second audit has all findings of a full one."""
    return shown(audited_changes(spark, sf_dir)[0], "kind", "severity").drop("snippet")


@query(
    sql(
        f"""SELECT first.repo AS repo, first.path AS path FROM (SELECT min({{'repo': repo, 'path': path}}) AS first FROM corpus_e
WHERE (content, {PATH_CLASS}) NOT IN (SELECT (content, {PATH_CLASS}) FROM corpus WHERE {RUN_1}) GROUP BY content, {PATH_CLASS})""",
        EDITED,
    )
)
def contents_scanned(spark, sf_dir):
    """The files that the second audit read: one of each content and path class that the first had not seen."""
    return audited_changes(spark, sf_dir)[1].select("repo", "path")


# Four runs per repository; the newest of odd repositories cannot be read.
RECORDED_RULES = tuple(r for r, _ in b.LINE_PATTERNS + b.WEB_PATTERNS)
MOMENTS = ("2024-01-01-0900", "2024-02-01-0900", "2024-03-01-0900", "2024-04-01-0900")


def recorded(spark, sf_dir):
    """History tables: run n holds the findings of the files whose number leaves no n - 1 by five.

    The texts are scanned once; a narrow table of files says in which runs each one is.
    """
    files = corpus(spark, sf_dir)
    held = [F.when((F.col("doc_id") + F.col("repo_no")) % 5 != n, F.lit(moment)) for n, moment in enumerate(MOMENTS)]
    runs_of = files.select("repo", "path", F.array_compact(F.array(*held)).alias("moments"))
    hits = scan_files(files, RECORDED_RULES).join(runs_of, ["repo", "path"])
    found = compact(hits.withColumn("run_id", F.explode("moments")))
    repos = files.groupBy("repo", "repo_no").agg(F.count("*").alias("n"))
    moments = F.array(*[F.lit(m) for m in MOMENTS])
    runs = repos.select("repo", "repo_no", "n", F.explode(moments).alias("run_id"))
    newest = F.col("run_id") == MOMENTS[-1]
    filled = F.struct(F.col("n").alias("total_files"), F.lit(7).cast("long").alias("finding_count"), F.lit(0).cast("long").alias("blocked_count"))
    runs = runs.select(
        "repo",
        "run_id",
        (~newest | (F.col("repo_no") % 2 == 0)).alias("is_valid"),
        F.when(F.col("run_id") != MOMENTS[1], filled).alias("coverage"),
        F.when(newest, F.struct(F.array(F.lit("inventory")).alias("checks_run"), F.lit(MOMENTS[2]).alias("history_source"))).alias("verification"),
    )
    return runs, found


def stored_history(spark, sf_dir):
    runs, found = recorded(spark, sf_dir)
    return runs, written(found, "history")


def recorded_sql() -> dict[str, str]:
    hits = " UNION ALL ".join(
        f"SELECT repo, {q(m)} AS run_id, rule, path FROM line_hits WHERE (doc_id + repo_no) % 5 <> {n}" for n, m in enumerate(MOMENTS)
    )
    runs = f"""SELECT repo, repo_no, n, run_id, NOT (run_id = {q(MOMENTS[-1])} AND repo_no % 2 = 1) AS is_valid
FROM (SELECT repo, repo_no, count(*) AS n FROM corpus GROUP BY ALL) CROSS JOIN ({b.values([(m,) for m in MOMENTS])}) AS m(run_id)"""
    return {"run_hits": hits, "run_rows": runs}


RECORDED = recorded_sql()


@query(sql("SELECT repo, max(run_id) AS run_id FROM run_rows WHERE is_valid GROUP BY repo", RECORDED))
def latest_run(spark, sf_dir):
    runs, _ = recorded(spark, sf_dir)
    return history.latest_run(runs).select("repo", "run_id")


@query(
    sql(
        f"""SELECT repo, run_id, is_valid, CASE WHEN run_id = {q(MOMENTS[1])} THEN 0 ELSE n END AS total_files,
CASE WHEN run_id = {q(MOMENTS[1])} THEN coalesce(h, 0) ELSE 7 END AS finding_count, CASE WHEN run_id = {q(MOMENTS[1])} THEN coalesce(e, 0) ELSE 0 END AS blocked_count,
CASE WHEN run_id = {q(MOMENTS[-1])} THEN 'inventory' ELSE '' END AS checks_run, CASE WHEN run_id = {q(MOMENTS[-1])} THEN {q(MOMENTS[2])} ELSE '' END AS history_source
FROM run_rows LEFT JOIN (SELECT repo, run_id, count(*) AS h, count(*) FILTER (rule = 'scan-error') AS e FROM run_hits GROUP BY ALL) USING (repo, run_id)""",
        RECORDED,
    )
)
def history_normalised(spark, sf_dir):
    rows = history.normalise_runs(*stored_history(spark, sf_dir))
    return rows.withColumn("checks_run", F.array_join("checks_run", ",")).withColumn("history_source", F.coalesce("history_source", F.lit("")))


@query(
    sql(
        """SELECT r.repo, r.run_id, CASE WHEN NOT r.is_valid OR r.run_id = newest OR (r.run_id = prior AND EXISTS (
  SELECT 1 FROM run_hits a JOIN run_hits c ON a.repo = c.repo AND a.rule = c.rule AND a.path = c.path WHERE a.repo = r.repo AND a.run_id = prior AND c.run_id = newest)) THEN 'keep' ELSE 'drop' END AS plan
FROM run_rows r JOIN (SELECT repo, max(run_id) AS newest FROM run_rows WHERE is_valid GROUP BY repo) USING (repo)
LEFT JOIN (SELECT repo, max(run_id) AS prior FROM run_rows x WHERE is_valid AND run_id < (SELECT max(run_id) FROM run_rows y WHERE y.is_valid AND y.repo = x.repo) GROUP BY repo) USING (repo)""",
        RECORDED,
    )
)
def retention_plan(spark, sf_dir):
    return history.retention_plan(*stored_history(spark, sf_dir))


SECRET = dict(b.LINE_PATTERNS)["hardcoded-secret"]
SECRET_LINES = b.lines_of("(SELECT source AS repo, doc_id, text AS content FROM documents)", "repo, doc_id")


@query(
    f"""SELECT repo, 'doc_' || doc_id || '.txt' AS path, CAST(line AS BIGINT) AS line, '2024-05-06-0708' AS run_id, 'critical' AS label, CAST(0 AS BIGINT) AS place
FROM ({SECRET_LINES}) WHERE {b.has(SECRET)}"""
)
def findings_round_trip(spark, sf_dir):
    """Findings written as JSON and read back, with the run id of a moment and the severity table beside them."""
    moment = F.lit("2024-05-06 07:08:09").cast("timestamp").alias("moment")
    found = scan_files(doc_files(spark, sf_dir), ("hardcoded-secret",)).select("*", moment)
    found = found.withColumn("run_id", run_id_of("moment")).drop("moment")
    target = fresh_path(spark, "json_findings")
    write_findings(found, target, "json")
    labels = catalog.severity_table(spark).select("severity", F.lower("severity_label").alias("label"), F.col("severity_rank").cast("long").alias("place"))
    read = read_findings(spark, target, "json").join(F.broadcast(labels), "severity")  # one row per severity
    return read.select("repo", "path", F.col("line").cast("long").alias("line"), "run_id", "label", "place")


@query(
    sql(
        f"""SELECT repo, {q(RUN)} AS run_id, verdict, total_files, finding_count, coalesce(stored, 0) AS stored
FROM ({verdict_sql(STOPS)}) JOIN ({COVERAGE_SQL}) USING (repo) LEFT JOIN (SELECT repo, count(*) AS stored FROM findings GROUP BY repo) USING (repo)"""
    )
)
def history_round_trip(spark, sf_dir):
    """One audit appended to a history and read back: a record per repository, clean ones too, and their findings."""
    files, found = corpus(spark, sf_dir), stored_findings(spark, sf_dir)
    decision = verdict.verdict(found, repos=files, run_id=RUN)
    target = fresh_path(spark, "history")
    write_history(found, run_records(decision, reports.coverage(files, found), reports.verification_record(files)), target)
    runs, kept = read_history(spark, target)
    counts = kept.groupBy("repo").agg(F.count("*").alias("stored"))
    rows = runs.join(counts, "repo", "left").select("repo", "run_id", "verdict", "coverage.total_files", "coverage.finding_count", "stored")
    return rows.fillna(0, ["stored"])
