"""Scans of texts, paths and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.tables import dimension
from corpusward.operators import config
from corpusward.operators import file_scan as fs
from corpusward.operators import repo_rules as rr
from corpusward.operators.code_facts import code_facts
from corpusward.operators.code_rules import CODE_RULES, scan_code
from corpusward.operators.inventory import inventory, reviewer_groups
from corpusward.session import fresh_path
from corpusward.sources.corpus import read_tree, write_tree
from fixtures.corpus import corpus, documents
from workload import expected
from workload import sqlbase as b
from workload.sqlbase import q, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def shown(findings: DataFrame, *more: str) -> DataFrame:
    """Plain columns for comparison: no nulls, long numbers."""
    return findings.select(
        "repo", "path", "rule", F.coalesce("line", F.lit(0)).cast("long").alias("line"), F.coalesce("snippet", F.lit("")).alias("snippet"), *more
    )


def shown_sql(source: str, where: str = "true") -> str:
    return f"SELECT repo, path, rule, CAST(coalesce(line, 0) AS BIGINT) AS line, coalesce(snippet, '') AS snippet FROM {source} WHERE {where}"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves as text files, one repository per source."""
    return documents(spark, sf_dir).select(
        F.col("source").alias("repo"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content")
    )


DOC_LINES = b.lines_of("(SELECT source AS repo, doc_id, text AS content FROM documents)", "repo, doc_id")


@query(
    f"""SELECT repo AS source, count(*) AS hits, count(DISTINCT doc_id) AS documents
FROM ({DOC_LINES}) WHERE {b.has(dict(b.LINE_PATTERNS)['hardcoded-secret'])} GROUP BY repo"""
)
def secret_hits_by_source(spark, sf_dir):
    hits = fs.scan_files(doc_files(spark, sf_dir), ("hardcoded-secret",))
    per_file = hits.groupBy("repo", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy(F.col("repo").alias("source")).agg(F.sum("n").alias("hits"), F.count("*").alias("documents"))


HOST = r"""(?i)http://([^/\s:'"<>]+)"""


@query(
    rf"""SELECT part, lower(host) AS host, count(*) AS hits
FROM (SELECT 'url' AS part, unnest(regexp_extract_all(url, {q(HOST)}, 1)) AS host FROM pages UNION ALL SELECT 'html', unnest(regexp_extract_all(html, {q(HOST)}, 1)) FROM pages
UNION ALL SELECT 'text', unnest(regexp_extract_all(text, {q(HOST)}, 1)) FROM documents UNION ALL SELECT 'chat', unnest(regexp_extract_all(text, {q(HOST)}, 1)) FROM conversations)
GROUP BY ALL"""
)
def http_urls_by_host(spark, sf_dir):
    """Hosts of all plain http addresses in pages, documents and conversations."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    part = lambda name, column: F.struct(F.lit(name).alias("part"), F.col(column).alias("text"))
    texts = pages.select(F.inline(F.array(part("url", "url"), part("html", "html"))))
    for name, rows in (("text", documents(spark, sf_dir)), ("chat", spark.read.parquet(f"{sf_dir}/conversations.parquet"))):
        texts = texts.unionByName(rows.select(F.lit(name).alias("part"), "text"))
    hosts = texts.select("part", F.explode(fs.http_hosts(F.col("text"))).alias("host"))
    return hosts.groupBy("part", F.lower("host").alias("host")).agg(F.count("*").alias("hits"))


CHAT_LINES = b.lines_of("(SELECT role, conv_id, text AS content FROM conversations)", "role, conv_id")


@query(
    "SELECT role, rule, count(*) AS hits FROM ("
    + " UNION ALL ".join(f"SELECT role, {q(r)} AS rule FROM chat WHERE {b.has(p)}" for r, p in b.LINE_PATTERNS)
    + ") GROUP BY ALL"
)
def conversation_line_hits(spark, sf_dir):
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    files = chat.select(F.col("role").alias("repo"), F.concat("conv_id", F.lit("/"), "turn", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    hits = fs.scan_files(files, [r for r, _ in b.LINE_PATTERNS])
    return hits.groupBy(F.col("repo").alias("role"), "rule").agg(F.count("*").alias("hits"))


ORACLES["conversation_line_hits"] = sql(ORACLES["conversation_line_hits"], {"chat": CHAT_LINES})

WEB_RULES = tuple(r for r, _ in b.WEB_PATTERNS)
FAST_RULES = tuple(r for r, _ in b.LINE_PATTERNS)


@query(sql(shown_sql("line_hits", f"rule IN ({b.names(WEB_RULES)})")))
def dom_and_storage_hits(spark, sf_dir):
    return shown(fs.scan_files(corpus(spark, sf_dir), WEB_RULES))


@query(
    sql(
        f"SELECT rule, severity, count(*) AS hits, count(DISTINCT (repo, path)) AS files FROM findings "
        f"WHERE rule IN ({b.names(FAST_RULES)}) GROUP BY ALL"
    )
)
def line_rule_counts(spark, sf_dir):
    hits = fs.scan_files(corpus(spark, sf_dir), FAST_RULES)
    per_file = hits.groupBy("rule", "severity", "repo", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("rule", "severity").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))


@query(sql(shown_sql("line_hits", f"rule IN ({b.names(FAST_RULES)})")))
def line_rule_findings(spark, sf_dir):
    return shown(fs.scan_files(corpus(spark, sf_dir), FAST_RULES))


@query(sql(shown_sql("wallet_hits")))
def wallet_material(spark, sf_dir):
    return shown(fs.scan_files(corpus(spark, sf_dir), fs.WALLET_RULES))


@query(sql(shown_sql("path_hits", "rule = 'event-listener-cleanup-missing'")))
def listener_cleanup(spark, sf_dir):
    return shown(fs.scan_files(corpus(spark, sf_dir), ("event-listener-cleanup-missing",)))


@query(sql(shown_sql("path_hits", "rule <> 'event-listener-cleanup-missing'")))
def stale_files(spark, sf_dir):
    return shown(fs.scan_files(corpus(spark, sf_dir), fs.PATH_RULES))


LARGE = 2000
SKIPPED = f"{b.any_part(expected.SKIP_DIRS)} OR {b.LOWER_SUFFIX} IN ({b.names(expected.BINARY_SUFFIXES)}) OR contains({b.NAME}, '.min.')"


@query(
    sql(
        f"""SELECT repo, path, 'scan-error' AS rule, CAST(0 AS BIGINT) AS line, '' AS snippet, 'blocked' AS kind, 'not read: over the size limit' AS error
FROM corpus WHERE strlen(content) > {LARGE} AND (NOT ({SKIPPED}) OR {b.WEB_SCOPE.split(' AND NOT')[0]} OR {b.WALLET_SCOPE.split(' AND NOT')[0]})
UNION ALL SELECT repo, path, rule, CAST(line AS BIGINT), snippet, 'finding', '' FROM line_hits JOIN (SELECT repo, path, content FROM corpus) USING (repo, path) WHERE rule = 'todo' AND strlen(content) <= {LARGE}"""
    )
)
def scan_errors(spark, sf_dir):
    hits = fs.scan_files(corpus(spark, sf_dir), ("scan-error", "todo"), size_limit=LARGE)
    return shown(hits, "kind", F.coalesce("error", F.lit("")).alias("error"))


@query(
    sql(
        "SELECT rule, count(*) AS suppressed FROM ("
        + " UNION ALL ".join(
            f"SELECT {q(r)} AS rule FROM lines WHERE {b.has(p)} AND {b.MARKED} AND {b.LINE_SCOPE.replace('NOT ' + b.MARKED, 'true')}"
            + (f" AND {b.SUFFIX} <> '.py'" if r == "todo" else "")
            for r, p in b.LINE_PATTERNS
        )
        + ") GROUP BY rule"
    )
)
def inline_suppressed(spark, sf_dir):
    """Hits per rule that the inline marker hides: the difference of two scans."""
    files = corpus(spark, sf_dir)
    count = lambda marker, name: fs.scan_files(files, FAST_RULES, marker=marker).groupBy("rule").agg(F.count("*").alias(name))
    every, left = count("\u0000", "every"), count(fs.DEFAULT_MARKER, "left")
    both = every.join(left, "rule", "left").select("rule", (F.col("every") - F.coalesce("left", F.lit(0))).alias("suppressed"))
    return both.where("suppressed > 0")


def category_case() -> str:
    return f"""CASE WHEN {b.LOWER_SUFFIX} IN ({b.names(expected.BINARY_SUFFIXES)}) THEN 'binary'
WHEN list_contains({b.PARTS}, 'tests') OR starts_with({b.NAME}, 'test_') THEN 'tests'
WHEN {b.NAME} IN ('Dockerfile', 'docker-compose.yml') OR {b.LOWER_SUFFIX} IN ('.tf', '.tfvars') THEN 'infra'
WHEN {b.any_part(('.github', '.gitlab'))} THEN 'ci'
WHEN list_contains({b.PARTS}, 'docs') OR {b.LOWER_SUFFIX} IN ('.md', '.rst') THEN 'docs'
WHEN {b.NAME} IN ('pyproject.toml', 'package.json', 'package-lock.json') OR {b.LOWER_SUFFIX} IN ('.json', '.toml', '.yaml', '.yml', '.ini', '.env') THEN 'config'
WHEN {b.LOWER_SUFFIX} IN ('.py', '.js', '.ts', '.tsx', '.jsx', '.go', '.rs', '.java', '.sh') THEN 'source' ELSE 'other' END"""


def skip_case() -> str:
    return f"""CASE WHEN {b.any_part(expected.SKIP_DIRS_INVENTORY)} OR contains(path || '/', '.egg-info/') THEN 'tooling-or-build-directory'
WHEN {b.NAME} IN ({b.names(expected.SERVICE_FILES)}) THEN 'service-file'
WHEN {b.LOWER_SUFFIX} IN ({b.names(expected.TEMP_SUFFIXES)}) THEN 'temp-or-backup-file'
WHEN contains({b.NAME}, '.min.') THEN 'minified-asset'
WHEN {b.LOWER_SUFFIX} IN ({b.names(expected.BINARY_SUFFIXES)}) THEN 'binary-file' END"""


b.CTES["listed"] = lambda: f"SELECT repo, repo_no, doc_id, tid, path, {category_case()} AS category, {skip_case()} AS skip_reason FROM corpus"


@query(sql("SELECT category, skip_reason IS NULL AS should_review_deeply, count(*) AS files FROM listed GROUP BY ALL"))
def inventory_by_category(spark, sf_dir):
    return inventory(corpus(spark, sf_dir)).groupBy("category", "should_review_deeply").agg(F.count("*").alias("files"))


@query(sql("SELECT repo, skip_reason, count(*) AS files FROM listed WHERE skip_reason IS NOT NULL GROUP BY ALL"))
def skip_reasons(spark, sf_dir):
    files = inventory(corpus(spark, sf_dir)).where("skip_reason IS NOT NULL")
    return files.groupBy("repo", "skip_reason").agg(F.count("*").alias("files"))


@query(sql("SELECT repo, path, category, coalesce(skip_reason, '') AS skip_reason FROM listed"))
def inventory_records(spark, sf_dir):
    return inventory(corpus(spark, sf_dir)).select("repo", "path", "category", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


@query(
    sql(
        f"""SELECT repo, "group", count(*) AS files FROM (
SELECT repo, 'source' AS "group" FROM listed WHERE skip_reason IS NULL AND category = 'source' AND {b.SUFFIX} = '.py'
UNION ALL SELECT repo, 'security' FROM listed WHERE skip_reason IS NULL AND category IN ('source', 'config')
UNION ALL SELECT repo, 'dependency' FROM listed WHERE skip_reason IS NULL AND (category = 'config' OR {b.REQ} OR starts_with(path, 'scripts/')))
GROUP BY ALL"""
    )
)
def file_routing(spark, sf_dir):
    return reviewer_groups(corpus(spark, sf_dir)).groupBy("repo", "group").agg(F.count("*").alias("files"))


@query(sql(shown_sql("dependency_hits") + " UNION ALL " + shown_sql("ignore_hits", "rule = 'missing-dependency-manifest'")))
def dependency_findings(spark, sf_dir):
    files = corpus(spark, sf_dir)
    profile = rr.repo_profile(files)
    missing = rr.profile_findings(profile, rr.MANIFEST_RULES)
    return shown(rr.scan_dependencies(files, profile).unionByName(missing))


@query(sql(shown_sql("ignore_hits", "rule <> 'missing-dependency-manifest'")))
def ignore_file_findings(spark, sf_dir):
    return shown(rr.profile_findings(rr.repo_profile(corpus(spark, sf_dir)), rr.IGNORE_RULES))


@query(sql(shown_sql("structure_hits")))
def required_paths(spark, sf_dir):
    return shown(rr.profile_findings(rr.repo_profile(corpus(spark, sf_dir)), rr.STRUCTURE_RULES))


@query(sql("SELECT repo, has_skill AS gated, has_header AS header_ok FROM profile"))
def header_check(spark, sf_dir):
    profile = rr.repo_profile(corpus(spark, sf_dir))
    return profile.select("repo", F.col("has_gate_file").alias("gated"), F.col("has_header").alias("header_ok"))


def code_findings(spark, sf_dir, area):
    rules = [rule for rule, (where, _) in CODE_RULES.items() if where == area]
    return scan_code(code_facts(corpus(spark, sf_dir)), rules, with_blocked=False)


def area_rules(area: str) -> str:
    return b.names(rule for rule, (where, _) in CODE_RULES.items() if where == area)


@query(sql(shown_sql("code_hits", f"rule IN ({area_rules('policy')}) AND rule <> 'python-parse-error'")))
def policy_findings(spark, sf_dir):
    return shown(code_findings(spark, sf_dir, "policy").where("rule <> 'python-parse-error'"))


@query(sql(shown_sql("code_hits", f"rule IN ({area_rules('debt')})")))
def debt_findings(spark, sf_dir):
    return shown(code_findings(spark, sf_dir, "debt"))


@query(sql(shown_sql("code_hits", f"rule IN ({area_rules('security')})")))
def injection_findings(spark, sf_dir):
    return shown(code_findings(spark, sf_dir, "security"))


@query(sql(shown_sql("code_hits", f"rule IN ({area_rules('resource')})")))
def resource_findings(spark, sf_dir):
    return shown(code_findings(spark, sf_dir, "resource"))


@query(
    sql(
        "SELECT repo, path, rule, CAST(coalesce(line, 0) AS BIGINT) AS line, 'finding' AS kind, '' AS error FROM code_hits WHERE rule = 'python-parse-error' "
        "UNION ALL SELECT repo, path, rule, 0, 'blocked', 'file cannot be tokenised' FROM blocked_hits"
    )
)
def unreadable_python(spark, sf_dir):
    found = scan_code(code_facts(corpus(spark, sf_dir)), ("python-parse-error",))
    return shown(found, "kind", F.coalesce("error", F.lit("")).alias("error")).drop("snippet")


OWN_RULES = (
    ("own-url", "P2", "Code Quality", "https?://[a-z]+", "line"),
    ("own-digits", "P3", "Code Quality", "[0-9]{6,}", "line"),
    ("own-element", "P3", "Security", r"\bel\.", "web"),
)
OWN_SCOPE = {"line": b.LINE_SCOPE, "web": b.WEB_SCOPE}


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT {q(r)} AS rule, {q(s)} AS severity, count(*) AS hits FROM lines WHERE {b.has(p)} AND {OWN_SCOPE[where]} HAVING count(*) > 0"
            for r, s, _, p, where in OWN_RULES
        )
    )
)
def own_rule_table(spark, sf_dir):
    """Line scan with rules that the user gives as a table."""
    table = dimension(spark, [dict(zip(("rule", "severity", "category", "pattern", "scope"), r)) for r in OWN_RULES])
    return fs.scan_lines_with_table(corpus(spark, sf_dir), table).groupBy("rule", "severity").agg(F.count("*").alias("hits"))


# Rules that the given conversations do break: an article and a run of accented letters.
CHAT_RULES = (
    ("chat-article", "P3", "Code Quality", "(^|[^A-Za-z])(the|les|der|los)([^A-Za-z]|$)", "line"),
    ("chat-accents", "P3", "Code Quality", "[éèêç]{2,}", "line"),
    ("chat-short-line", "P3", "Code Quality", "^.{1,20}$", "line"),
)


@query(sql(" UNION ALL ".join(f"SELECT role, {q(r)} AS rule, count(*) AS hits, count(DISTINCT conv_id) AS conversations FROM chat WHERE {b.has(p)} GROUP BY role" for r, _, _, p, _ in CHAT_RULES), {"chat": CHAT_LINES}))
def conversation_own_rules(spark, sf_dir):
    """Lines of conversations that a user's rules find, by role."""
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    files = chat.select(F.col("role").alias("repo"), F.concat("conv_id", F.lit("/"), "turn", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    table = dimension(spark, [dict(zip(("rule", "severity", "category", "pattern", "scope"), r)) for r in CHAT_RULES])
    per_talk = fs.scan_lines_with_table(files, table).groupBy("repo", "rule", F.substring_index("path", "/", 1).alias("conv")).agg(F.count("*").alias("n"))
    return per_talk.groupBy(F.col("repo").alias("role"), "rule").agg(F.sum("n").alias("hits"), F.count("*").alias("conversations"))


BROKEN = "doc_id % 4 = 1"  # these files get a byte that is no UTF-8


@query(
    sql(
        f"""SELECT 'repo=' || source AS repo, 'doc=' || doc_id AS folder, strlen(text) + 1 + CASE WHEN {BROKEN} THEN 1 ELSE 0 END AS size, {BROKEN} AS bad_bytes, md5(text || chr(10)) AS digest,
CASE WHEN strlen(text) + 1 + CASE WHEN {BROKEN} THEN 1 ELSE 0 END > {LARGE} THEN 'unread' ELSE 'read' END AS state FROM documents"""
    ).replace(f"{BROKEN} AS bad_bytes, md5(text || chr(10)) AS digest", f"{BROKEN} AND strlen(text) + 2 <= {LARGE} AS bad_bytes, CASE WHEN strlen(text) + 1 + CASE WHEN {BROKEN} THEN 1 ELSE 0 END > {LARGE} THEN '' ELSE md5(text || chr(10)) END AS digest")
)
def tree_scan(spark, sf_dir):
    """Documents written as a tree of files, some with a bad byte, and read back under a size limit."""
    root = fresh_path(spark, "tree")
    broken = F.when(F.expr(BROKEN), F.lit(b"\xff")).otherwise(F.lit(b""))
    body = F.concat(F.coalesce(F.concat(F.col("text").cast("binary"), broken), F.lit(b"")), F.lit(b"\n"))
    name = F.concat(F.lit("doc="), F.col("doc_id").cast("string"), F.lit("/"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    repo = F.concat(F.lit("repo="), F.coalesce(F.nullif("source", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))
    write_tree(documents(spark, sf_dir).select(repo.alias("repo"), name.alias("path"), body.alias("content")), root)
    files = read_tree(spark, root, repo_depth=1, glob="*.txt", size_limit=LARGE)
    return files.select(
        "repo", F.substring_index("path", "/", 1).alias("folder"), "size", "bad_bytes", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("")).alias("digest"),
        F.when(F.col("content").isNull(), "unread").otherwise("read").alias("state"),
    )


@query(sql(f"SELECT rule, severity, count(*) AS findings FROM findings WHERE rule IN ({b.names(FAST_RULES)}) GROUP BY ALL"))
def config_defaults(spark, sf_dir):
    """Settings of a project that sets nothing leave all findings as they are."""
    found = config.apply_config(fs.scan_files(corpus(spark, sf_dir), FAST_RULES), config.no_overrides(spark), config.no_suppressions(spark))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"))
