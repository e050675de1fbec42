"""Surroundings, callers, dependents, names and order, on Python files made of the documents' texts and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.functions.text import LINE_BREAK
from corpusward.operators import calls, names, review
from corpusward.operators import checklist as ck
from corpusward.operators.code_facts import code_facts
from corpusward.operators.code_rules import scan_code
from corpusward.operators.file_scan import scan_files
from corpusward.session import written
from fixtures.corpus import documents
from workload import expected
from workload import sqlbase as b
from workload.scans import shown
from workload.sqlbase import q, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return add


REPO = "concat('r', cast(floor(doc_id / 40) as bigint))"
PLACE = "(doc_id % 40)"


def python_files(spark, sf_dir, path: str, body: str, extra: str | None = None):
    """A file per document: ``body`` is an expression that both dialects read; the whole text follows as remarks."""
    docs = documents(spark, sf_dir)
    remarks = F.concat(F.lit("\n# "), F.regexp_replace("text", LINE_BREAK, "\n# "))
    return docs.select("doc_id", "n_chars", F.expr(REPO).alias("repo"), F.expr(path).alias("path"), F.concat(F.expr(body), remarks).alias("content"))


def python_sql(path: str, body: str) -> str:
    return f"SELECT doc_id, n_chars, {REPO} AS repo, {path} AS path, ({body}) || chr(10) || '# ' || regexp_replace(text, {q(b.BREAK)}, chr(10) || '# ', 'g') AS content FROM documents"


def lines_expr(*lines: str) -> str:
    """Lines as one text; a line in braces is an expression itself."""
    parts = [line[1:-1] if line.startswith("{") else q(line) for line in lines]
    return f"concat_ws(chr(10), {', '.join(parts)})"


# --- Surroundings of a hit: the blocks start after as many remarks as the text's length leaves by five ----
SHIFT = "n_chars % 5"
BLOCKS = lines_expr(
    "import abc, os",
    "{concat('# padding', repeat(concat(chr(10), '# padding'), CAST(n_chars % 5 AS INT)))}",
    "class Base(abc.ABC):",
    '    """changeme later"""',
    "    def run(self):",
    "        pass",
    "class Plain:",
    "    def run(self):",
    "        pass",
    "if settings.DEBUG:",
    '    allow_origins = "*"',
    'allow_origins = "*"',
    "try:",
    "    a = 1",
    "finally:",
    "    try:",
    "        b = 1",
    "    except OSError:",
    "        pass",
    'if __name__ == "__main__":',
    '    print("password")',
    """key = Account.from_key(f"{os.environ['KEY']}")""",
    "{concat('other = Account.from_key(\"', coalesce(lang, 'xx'), 'deadbeef123\")')}",
)
# kind, first and last line after the remarks
SPANS = (("abstract-class", 1, 4), ("docstring", 2, 2), ("debug-branch", 9, 9), ("finally", 14, 17), ("handler", 17, 17), ("main-guard", 19, 19))
CONTEXT_LINE_RULES = ("wildcard-cors", "except-pass", "debug-call", "placeholder")
SURROUNDINGS = {
    "block_files": python_sql("concat('src/m', doc_id, '.py')", BLOCKS),
    "block_lines": b.lines_of("block_files", "doc_id, n_chars, repo, path"),
    "block_hits": " UNION ALL ".join(f"SELECT repo, path, n_chars, {q(r)} AS rule, line, text FROM block_lines WHERE {b.has(p)}" for r, p in b.LINE_PATTERNS if r in CONTEXT_LINE_RULES)
    + " UNION ALL SELECT repo, path, n_chars, 'web3-inline-from-key', line, text FROM block_lines WHERE starts_with(text, 'key = ') OR starts_with(text, 'other = ')",
    "spans": f"SELECT * FROM ({b.values(SPANS)}) AS s(kind, first, last)",
    "placed": f"""SELECT h.repo, h.path, h.rule, h.line, any_value(h.text) AS text, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS within FROM block_hits h
LEFT JOIN spans s ON h.line BETWEEN 2 + h.{SHIFT} + first AND 2 + h.{SHIFT} + last GROUP BY h.repo, h.path, h.rule, h.line""",
}


def block_case() -> str:
    rows = [(p, [f"rule = {q(rule)}"] + ([b.has(path, "path")] if path else []) + ([b.has(line)] if line else []), action) for p, rule, path, line, action in expected.CONTEXT_TABLE]
    rows += [(p, [f"rule = {q(rule)}", f"list_contains(string_split(within, ','), {q(kind)})"], action) for p, rule, kind, action in expected.CONTEXT_BLOCKS]
    return "CASE " + " ".join(f"WHEN {' AND '.join(tests)} THEN {q(action)}" for _, tests, action in sorted(rows, key=lambda r: -r[0])) + " ELSE 'keep' END"


def surrounded(spark, sf_dir):
    files = python_files(spark, sf_dir, "concat('src/m', doc_id, '.py')", BLOCKS)
    facts = written(code_facts(files), "facts")
    found = scan_files(files, CONTEXT_LINE_RULES).unionByName(scan_code(facts, ("web3-inline-from-key",), with_blocked=False))
    return review.with_lines(review.with_blocks(written(found, "findings"), facts), files, ("placeholder", "web3-inline-from-key"))


@query(sql("SELECT repo, path, rule, CAST(line AS BIGINT) AS line, within FROM placed", SURROUNDINGS))
def hit_surroundings(spark, sf_dir):
    return shown(surrounded(spark, sf_dir), F.array_join("within", ",").alias("within")).drop("snippet")


@query(
    sql(
        f"""SELECT repo, path, rule, CAST(line AS BIGINT) AS line, CASE WHEN action = 'low' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence
FROM (SELECT *, {block_case()} AS action FROM placed) WHERE action <> 'drop'""",
        SURROUNDINGS,
    )
)
def context_surroundings(spark, sf_dir):
    """The default context rules on whole lines and the blocks around them."""
    rows = review.apply_context(surrounded(spark, sf_dir), review.default_context_rules(spark))
    return shown(rows, "confidence").drop("snippet")


# --- Modules that import each other: each one from another, up to thirteen ahead ---------------------------
AHEAD = f"(({PLACE} + 1 + n_chars % 13) % 40)"
STYLE = "doc_id % 5"
CALL = f"concat(CASE {STYLE} WHEN 0 THEN concat('pkg.m', {AHEAD}, '.') WHEN 1 THEN concat('m', {AHEAD}, '.') WHEN 2 THEN 'other.' WHEN 3 THEN '' ELSE '' END, "
IMPORT = (
    f"CASE {STYLE} WHEN 0 THEN concat('import pkg.m', {AHEAD}) WHEN 1 THEN concat('from pkg import m', {AHEAD}) WHEN 2 THEN concat('import pkg.m', {AHEAD}, ' as other') "
    f"WHEN 3 THEN concat('from pkg.m', {AHEAD}, ' import calc, find, Book') ELSE concat('from .m', {AHEAD}, ' import calc as reckon, find as seek, Book as Tome') END"
)
CALC = f"CASE WHEN {STYLE} = 4 THEN 'reckon' ELSE 'calc' END"
FIND = f"CASE WHEN {STYLE} = 4 THEN 'seek' ELSE 'find' END"
BOOK = f"CASE WHEN {STYLE} = 4 THEN 'Tome' ELSE 'Book' END"
# afterwards: a parameter more, another result type, no such function, or the same
EDITED = "n_chars % 4"


def modules(edited: bool) -> str:
    first = "'def calc(a, b=1) -> float:'"
    if edited:
        first = f"CASE {EDITED} WHEN 0 THEN 'def calc(a, b, c) -> float:' WHEN 1 THEN 'def calc(a, b=1) -> Decimal:' WHEN 2 THEN 'def calc_all(a, b=1) -> float:' ELSE {first} END"
    use = f"CASE n_chars % 7 WHEN 0 THEN concat('    return ', {CALL}{FIND}, '(y).name'), chr(10), '    # direct') WHEN 1 THEN concat('    z = ', {CALL}{FIND}, '(y)'), chr(10), '    return z.name') WHEN 2 THEN concat('    z = ', {CALL}{FIND}, '(y)'), chr(10), '    return z.name if z else 0') ELSE concat('    return ', {CALL}{FIND}, '(y)'), chr(10), '    # passed on') END"
    return lines_expr(
        f"{{{IMPORT}}}",
        f"{{{first}}}",
        f"{{concat('    return ', {CALL}{CALC}, '(a, b)'))}}",
        "def find(x):",
        "{CASE WHEN n_chars % 2 = 0 THEN concat('    if x:', chr(10), '        return None') ELSE concat('    if x:', chr(10), '        return 1') END}",
        "    return x",
        "def use(y):",
        f"{{{use}}}",
        "class Book:",
        "    def total(self):",
        "        return self.pages()",
        "    def pages(self):",
        f"{{concat('        return ', {CALL}{BOOK}, '()'))}}",
    )


MODULE_PATH = f"concat('pkg/m', {PLACE}, '.py')"
MODULE_CTES = {
    "mods": f"SELECT doc_id, n_chars, {REPO} AS repo, {PLACE} AS place, {AHEAD} AS ahead, {MODULE_PATH} AS path FROM documents",
    "uses": "SELECT a.*, c.path AS source, c.n_chars AS n_source FROM mods a JOIN mods c ON a.repo = c.repo AND a.ahead = c.place",
}


def module_files(spark, sf_dir, edited: bool = False):
    return python_files(spark, sf_dir, MODULE_PATH, modules(edited))


@query(
    sql(
        """SELECT repo, path, 'calc' AS scope, 3 AS line, 'pkg.m' || ahead || '.calc' AS target, source AS defined_in FROM uses
UNION ALL SELECT repo, path, 'use', 9, 'pkg.m' || ahead || '.find', source FROM uses
UNION ALL SELECT repo, path, 'Book.pages', 15, 'pkg.m' || ahead || '.Book', source FROM uses
UNION ALL SELECT repo, path, 'Book.total', 13, 'pkg.m' || place || '.Book.pages', path FROM mods""",
        MODULE_CTES,
    )
)
def call_graph(spark, sf_dir):
    return calls.call_graph(written(code_facts(module_files(spark, sf_dir)), "facts"))


@query(
    sql(
        f"""SELECT repo, source AS changed, 'pkg.m' || ahead || '.calc' AS target, CASE n_source % 4 WHEN 0 THEN 'new_required_parameter' WHEN 1 THEN 'return_type' ELSE 'removed' END AS change,
path, CASE WHEN {EDITED} = 2 THEN 'calc_all' ELSE 'calc' END AS scope, 3 AS line FROM uses WHERE n_source % 4 <> 3""",
        MODULE_CTES,
    )
)
def callers_of_changes(spark, sf_dir):
    before, after = (written(code_facts(module_files(spark, sf_dir, edited)), "facts") for edited in (False, True))
    return calls.callers_of_changes(before, after)


@query(
    sql(
        "SELECT repo, path, 'unchecked-none-result' AS rule, CAST(9 AS BIGINT) AS line, 'pkg.m' || ahead || '.find' AS snippet FROM uses WHERE n_source % 2 = 0 AND n_chars % 7 IN (0, 1)",
        MODULE_CTES,
    )
)
def unchecked_none(spark, sf_dir):
    return shown(calls.unchecked_none(written(code_facts(module_files(spark, sf_dir)), "facts")))


@query(
    sql(
        """SELECT repo, changed, dependent, CAST(min(distance) AS INTEGER) AS distance FROM (
WITH RECURSIVE r(repo, changed, dependent, distance) AS (
  SELECT repo, path, path, 0 FROM mods WHERE doc_id % 8 = 3
  UNION SELECT r.repo, r.changed, u.path, r.distance + 1 FROM r JOIN uses u ON u.repo = r.repo AND u.source = r.dependent WHERE r.distance < 40)
SELECT * FROM r) WHERE dependent <> changed GROUP BY ALL""",
        MODULE_CTES,
    )
)
def module_dependents(spark, sf_dir):
    """All files that a modified module reaches through imports, with the length of the shortest way."""
    files = module_files(spark, sf_dir)
    return calls.dependents(written(code_facts(files), "facts"), files.where("doc_id % 8 = 3"))


# --- Names in code, strings and comments ------------------------------------------------------------------
NAMES = lines_expr(
    f"{{CASE n_chars % 4 WHEN 0 THEN concat('from pkg.m', {PLACE}, ' import gone') WHEN 1 THEN '# gone for good' WHEN 2 THEN 'note = \"gone and past\"' ELSE 'gone_too = 1' END}}",
    "{CASE WHEN n_chars % 6 = 0 THEN concat('print(\"run tool', doc_id + 1, ' now\")') ELSE 'print(1)' END}",
)
NAME_PATH = "CASE WHEN doc_id % 3 = 0 THEN concat('scripts/tool', doc_id, '.py') ELSE concat('src/part', doc_id, '.py') END"
WORD_TEXT = r"regexp_matches(text, '(^|[^A-Za-z0-9_])gone($|[^A-Za-z0-9_])')"


def name_parts(spark, sf_dir):
    files = python_files(spark, sf_dir, NAME_PATH, NAMES)
    return files, written(names.name_index(files, written(code_facts(files), "facts")), "names")


@query(
    f"""SELECT {REPO} AS repo, 'gone' AS name, {NAME_PATH} AS path, CASE WHEN n_chars % 4 = 0 THEN 'use' ELSE 'mention' END AS reference
FROM documents WHERE n_chars % 4 IN (0, 1, 2) OR {WORD_TEXT}"""
)
def old_name_uses(spark, sf_dir):
    """Uses of a removed name told from words in strings and comments."""
    files, index = name_parts(spark, sf_dir)
    removed = files.select("repo").distinct().withColumn("name", F.lit("gone"))
    return names.old_name_references(removed, index)


@query(
    f"""SELECT {REPO} AS repo, {NAME_PATH} AS path FROM documents s WHERE doc_id % 3 = 0 AND NOT EXISTS (
SELECT 1 FROM documents o WHERE o.doc_id // 40 = s.doc_id // 40 AND o.doc_id + 1 = s.doc_id AND o.n_chars % 6 = 0)"""
)
def unreferenced_scripts(spark, sf_dir):
    return names.unreferenced_scripts(*name_parts(spark, sf_dir))


# --- Order inside a function: what comes before, and what stands in the same loop ----------------------
ORDERED = lines_expr(
    "import requests, time",
    "def ratio(n, volume):",
    "{CASE n_chars % 5 WHEN 0 THEN concat('    if volume == 0:', chr(10), '        return 0', chr(10), '    return n / volume') "
    "WHEN 1 THEN concat('    r = n / volume', chr(10), '    if volume == 0:', chr(10), '        r = 0') "
    "WHEN 2 THEN concat('    for k in n:', chr(10), '        assert volume', chr(10), '    return n / volume') "
    "WHEN 3 THEN concat('    r = n / volume if volume else 0', chr(10), '    r += 1', chr(10), '    return r') "
    "ELSE concat('    if n:', chr(10), '        assert volume', chr(10), '    return n % volume') END}",
    "def send(w3, tx):",
    "{CASE n_chars % 3 WHEN 0 THEN concat('    w3.estimate_gas(tx)', chr(10), '    w3.send_transaction(tx)') WHEN 1 THEN concat('    w3.send_transaction(tx)', chr(10), '    w3.estimate_gas(tx)') "
    "ELSE concat('    if tx: w3.estimate_gas(tx)', chr(10), '    w3.send_transaction(tx)') END}",
    "def load(urls):",
    "{CASE n_chars % 2 WHEN 0 THEN concat('    time.sleep(1)', chr(10), '    for u in urls:', chr(10), '        requests.get(u, timeout=1)') "
    "ELSE concat('    for u in urls:', chr(10), '        requests.get(u, timeout=1)', chr(10), '        time.sleep(1)') END}",
)


@query(
    f"""SELECT {REPO} AS repo, concat('src/o', doc_id, '.py') AS path, rule, CAST(line AS BIGINT) AS line, snippet FROM documents JOIN (
VALUES ('unguarded-division', 2, 'ratio'), ('send-without-gas-estimate', 6, 'send'), ('no-rate-limit', 9, 'load')) AS v(rule, line, snippet)
ON CASE rule WHEN 'unguarded-division' THEN n_chars % 5 IN (1, 2, 4) WHEN 'send-without-gas-estimate' THEN n_chars % 3 <> 0 ELSE n_chars % 2 = 0 END"""
)
def order_findings(spark, sf_dir):
    """A guard, an estimate or a pause counts only where it surely comes before, or in the same loop."""
    found = ck.checklist_code(code_facts(python_files(spark, sf_dir, "concat('src/o', doc_id, '.py')", ORDERED)))
    return shown(found.where(F.col("rule").isin("unguarded-division", "send-without-gas-estimate", "no-rate-limit")))
