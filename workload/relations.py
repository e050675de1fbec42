"""Relations between results, requirements, patterns, spans and modules, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.functions.text import LINE_BREAK
from corpusward.operators import ignores, nested, versions
from fixtures.corpus import documents
from workload import sqlbase as b
from workload.sqlbase import q, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return add


# --- Nested results: the shape of every document, before and after a change -----------------
REPO_OF = "concat('r', cast(floor(doc_id / 40) as bigint))"
SHIFTS = "CASE doc_id % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(0.009 AS DOUBLE) WHEN 2 THEN CAST(0.011 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"


def shape(after: bool):
    """JSON of a document's shape; afterwards some numbers moved, some lines, keys and flags changed."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.length(line).cast("double"))
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))
    lang, ok, tail = F.col("lang").alias("lang"), F.lit(True), F.lit(None).cast("string")
    if after:
        lines = F.transform(lines, lambda n: n + F.expr(SHIFTS))
        lines = F.when(F.col("doc_id") % 5 == 0, F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        ok = F.col("doc_id") % 7 != 0
        tail = F.when(F.col("doc_id") % 6 == 0, F.col("source"))
    inner = F.struct(F.get(words, F.lit(0)).alias("first"), F.get(words, F.size(words) - 1).alias("last"), F.size(words).alias("number"))
    whole = F.struct(lang, F.col("n_chars").alias("size"), lines.alias("lines"), F.struct(inner.alias("words"), ok.alias("ok"), tail.alias("tail")).alias("shape"))
    return F.to_json(whole, {"ignoreNullFields": "true"})


def shape_sql(after: bool) -> str:
    """Leaves (repo, name, path, kind, number, text) of the same shapes."""
    lines = "list_transform(string_split(text, chr(10)), lambda l: CAST(length(l) AS DOUBLE)" + (f" + {SHIFTS})" if after else ")")
    if after:
        lines = f"CASE WHEN doc_id % 5 = 0 THEN ({lines})[1:len(string_split(text, chr(10))) - 1] ELSE {lines} END"
    words = "regexp_extract_all(text, '[A-Za-z]+')"
    ok = "doc_id % 7 <> 0" if after else "true"
    rest = [
        ("$.size", "CAST(n_chars AS DOUBLE)", None),
        ("$.shape.words.number", f"CAST(len({words}) AS DOUBLE)", None),
        ("$.lang", None, "lang"),
        ("$.shape.words.first", None, f"{words}[1]"),
        ("$.shape.words.last", None, f"{words}[len({words})]"),
        ("$.shape.ok", None, f"CAST({ok} AS VARCHAR)"),
    ] + ([("$.shape.tail", None, "CASE WHEN doc_id % 6 = 0 THEN source END")] if after else [])
    rows = [f"SELECT doc_id, {q(path)} AS path, {number or 'NULL'} AS number, {text or 'NULL'} AS text FROM documents WHERE {number or text} IS NOT NULL" for path, number, text in rest]
    rows.append(f"SELECT doc_id, '$.lines[' || (k - 1) || ']', ls[k], NULL FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, {lines} AS ls FROM documents))")
    rows.append(f"SELECT doc_id, '$.lines', NULL, 'empty' FROM (SELECT doc_id, {lines} AS ls FROM documents) WHERE len(ls) = 0")
    return f"SELECT {REPO_OF} AS repo, 'doc_' || doc_id AS name, path, number, text FROM ({' UNION ALL '.join(rows)}) WHERE doc_id % {11 if after else 10} <> 0"


LEAF_CTES = {"leaves_b": shape_sql(False), "leaves_a": shape_sql(True)}
LEAF_DELTAS = """SELECT repo, name, path, CASE WHEN a.repo IS NULL THEN 'missing' WHEN b.repo IS NULL THEN 'extra'
WHEN (a.number IS NULL) = (b.number IS NULL) AND a.text IS NOT DISTINCT FROM b.text AND coalesce(abs(a.number - b.number) < 0.01::DOUBLE, true) THEN 'pass' ELSE 'regression' END AS status
FROM leaves_b b FULL JOIN leaves_a a USING (repo, name, path)"""


def shapes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    row = lambda after: docs.where(f"doc_id % {11 if after else 10} <> 0").select(
        F.expr(REPO_OF).alias("repo"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), shape(after).alias("value")
    )
    return nested.leaf_deltas(row(False), row(True))


@query(sql(LEAF_DELTAS, LEAF_CTES))
def nested_deltas(spark, sf_dir):
    return shapes(spark, sf_dir).select("repo", "name", "path", "status")


@query(sql(f"SELECT repo, name, count(*) AS leaves, count(*) FILTER (status <> 'pass') AS differing, CASE WHEN bool_or(status <> 'pass') THEN 'regression' ELSE 'pass' END AS status FROM ({LEAF_DELTAS}) GROUP BY ALL", LEAF_CTES))
def nested_verdict(spark, sf_dir):
    return nested.nested_verdicts(shapes(spark, sf_dir))


# --- Requirements whose versions come from the documents' lengths -----------------------------
# kind of file, ecosystem, written name, name, specification, lowest and highest version, excluded from and to.
# The expressions are valid in both dialects; a version x.y.z is the number x * 10000 + y * 100 + z.
MAJOR, MINOR = "(n_chars % 2)", "(n_chars % 5)"
CARET = "CASE WHEN n_chars % 3 > 0 THEN (n_chars % 3 + 1) * 10000 - 1 WHEN n_chars % 4 > 0 THEN (n_chars % 4 + 1) * 100 - 1 ELSE n_chars % 2 END"
REQUIRED = (
    (0, "python", "Shared_Lib[extra]", "shared-lib", f"concat('==', {MAJOR}, '.', {MINOR})", f"{MAJOR} * 10000 + {MINOR} * 100", f"{MAJOR} * 10000 + {MINOR} * 100", "-1", "-1"),
    (0, "python", "kit", "kit", f"concat('!=', {MAJOR}, '.*')", "-1", "99999", f"{MAJOR} * 10000", f"{MAJOR} * 10000 + 9999"),
    (0, "python", "other", "other", f"concat('>', {MINOR}, '.0,<=', {MINOR} + {MAJOR}, '.0')", f"{MINOR} * 10000 + 1", f"({MINOR} + {MAJOR}) * 10000", "-1", "-1"),
    (1, "python", "shared.lib", "shared-lib", f"concat('>=', {MAJOR}, '.', n_chars % 4, ',<2')", f"{MAJOR} * 10000 + n_chars % 4 * 100", "19999", "-1", "-1"),
    (1, "python", "KIT", "kit", f"concat('==', {MAJOR}, '.', n_chars % 3)", f"{MAJOR} * 10000 + n_chars % 3 * 100", f"{MAJOR} * 10000 + n_chars % 3 * 100", "-1", "-1"),
    (2, "python", "shared-lib", "shared-lib", f"concat('~=', {MAJOR}, '.', n_chars % 3, '.0')", f"{MAJOR} * 10000 + n_chars % 3 * 100", f"{MAJOR} * 10000 + (n_chars % 3 + 1) * 100 - 1", "-1", "-1"),
    (3, "node", "left-pad", "left-pad", f"concat('^', n_chars % 3, '.', n_chars % 4, '.', {MAJOR})", f"n_chars % 3 * 10000 + n_chars % 4 * 100 + {MAJOR}", CARET, "-1", "-1"),
    (3, "node", "left-pad", "left-pad", "concat('>=', n_chars % 4, '.0.0,<3')", "n_chars % 4 * 10000", "29999", "-1", "-1"),
)
SPEC_PATHS = ("requirements.txt", "requirements-dev.txt", "pyproject.toml", "package.json")


def specification_files(spark, sf_dir):
    """Four files per repository, each with versions from its document and the whole text as remarks."""
    docs = documents(spark, sf_dir)
    remarks = F.concat(F.lit("# "), F.regexp_replace("text", LINE_BREAK, "\n# "))
    entry = lambda row: F.concat(F.lit(row[2]), F.expr(row[4]))
    of = [[row for row in REQUIRED if row[0] == kind] for kind in range(4)]
    listed = [F.concat_ws("\n", remarks, *map(entry, rows)) for rows in of[:2]]
    project = F.concat(F.lit('[project]\nname = "p"\ndependencies = [\n    "'), entry(of[2][0]), F.lit('",\n]\n[tool.x]\nkit = "9.9"\n'), remarks)
    section = lambda row: F.create_map(F.lit("left-pad"), F.replace(F.expr(row[4]), F.lit(","), F.lit(" ")))
    package = F.to_json(F.struct(F.col("text").alias("description"), section(of[3][0]).alias("dependencies"), section(of[3][1]).alias("devDependencies")))
    contents = [*listed, project, package]
    kind = F.col("doc_id") % 4
    return docs.select(
        F.concat(F.lit("s"), F.floor(F.col("doc_id") / 4).cast("string")).alias("repo"),
        F.element_at(F.array(*map(F.lit, SPEC_PATHS)), (kind + 1).cast("int")).alias("path"),
        F.coalesce(*[F.when(kind == k, content) for k, content in enumerate(contents)]).alias("content"),
    )


def requirement_rows() -> str:
    lines = {0: "len(string_split_regex(text, {}))".format(q(b.BREAK)), 1: "len(string_split_regex(text, {}))".format(q(b.BREAK)), 2: "3", 3: "0"}
    rows, places = [], dict.fromkeys(range(4), 0)
    for kind, system, _, name, spec, low, high, gap_low, gap_high in REQUIRED:
        places[kind] += 1
        line = "1" if kind == 3 else f"{lines[kind]} + {places[kind]}"
        rows.append(f"SELECT 's' || doc_id // 4 AS repo, {q(SPEC_PATHS[kind])} AS path, {line} AS line, {q(system)} AS system, {q(name)} AS name, {spec} AS spec, {low} AS low, {high} AS high, {gap_low} AS gap_low, {gap_high} AS gap_high FROM documents WHERE doc_id % 4 = {kind}")
    return " UNION ALL ".join(rows)


@query(
    sql(
        """SELECT repo, first.path AS path, 'conflicting-dependency' AS rule, CAST(first.line AS BIGINT) AS line, name || ': ' || specs AS snippet FROM (
SELECT repo, system, name, min({'path': path, 'line': line}) AS first, array_to_string(list_sort(list_distinct(list(spec))), ' and ') AS specs FROM required GROUP BY ALL)
WHERE (repo, system, name) NOT IN (SELECT (r.repo, r.system, r.name) FROM required r JOIN candidates v ON true
  GROUP BY r.repo, r.system, r.name, v.version HAVING bool_and(v.version BETWEEN r.low AND r.high AND NOT v.version BETWEEN r.gap_low AND r.gap_high))""",
        {"required": requirement_rows(), "candidates": "SELECT x * 10000 + y * 100 + z AS version FROM range(0, 8) AS a(x), range(0, 8) AS c(y), range(0, 3) AS d(z)"},
    )
)
def conflicting_dependencies(spark, sf_dir):
    """Checked against every version up to 7.7.2, one by one."""
    found = versions.conflicting_dependencies(specification_files(spark, sf_dir))
    return found.select("repo", "path", "rule", F.col("line").cast("long").alias("line"), "snippet")


# --- Ignore files whose patterns come from the documents' words -------------------------------------
# path of the ignore file, and its lines; {w} is the first word of the document, {n} its length modulo four.
IGNORES = (
    (0, ".gitignore", "*.log\n/build/\n*.tmp\n!keep{n}.tmp\n.env\ndeep/**/x{n}.py\n  \n[a-m]*.key\n**/gen/*.py\n/src/*.swp\nlogs/**\n{w}.txt"),
    (1, "src/.gitignore", "!*.log\n/a{n}/\n*.p?c\n!a0/main.pyc\n\\#odd.pem  \n[!a-m]*.pem\n[z-a].txt"),
    (2, "src/a1/.gitignore", "*\n!*.py\n!.env.{w}"),
)
# Where the other documents lie, by doc_id modulo 12; {id} is the document, {n} its length modulo four, {w} its first word.
TRACKED = (
    "logs/run_{id}.log", "src/a{n}/run_{id}.log", "build/out_{id}.js", "src/build/out_{id}.js", "src/a{n}/keep{n}.tmp", "src/.env.{w}",
    "deep/one/two/x{n}.py", "src/a{n}/main.pyc", "keys/{w}{id}.pem", "src/gen/{id}.py", "src/a1/.env.{w}", "src/#odd.pem",
)


def filled(template: str):
    """A template as an expression that both dialects read."""
    word = "coalesce(nullif(lower(regexp_extract(text, '[A-Za-z]+', 0)), ''), 'none')"
    out = q(template)
    for name, value in (("{id}", "CAST(doc_id AS STRING)"), ("{n}", "CAST(n_chars % 4 AS STRING)"), ("{w}", word)):
        out = f"replace({out}, '{name}', {value})"
    return out


def tracked_case(what: int) -> str:
    """Path (1) or content (2) of a document's file."""
    cases = " ".join(f"WHEN doc_id % 40 = {k} THEN {q(path) if what == 1 else filled(lines)}" for k, path, lines in IGNORES)
    rest = "CASE " + " ".join(f"WHEN doc_id % 12 = {k} THEN {filled(path)}" for k, path in enumerate(TRACKED)) + " END" if what == 1 else "text"
    return f"CASE {cases} ELSE {rest} END"


def tracked_files(spark, sf_dir):
    escaped = [tracked_case(n).replace("\\", "\\\\") for n in (1, 2)]  # backslashes in literals of this dialect
    return documents(spark, sf_dir).selectExpr(f"{REPO_OF} AS repo", f"{escaped[0]} AS path", f"{escaped[1]} AS content").dropDuplicates(["repo", "path"])


def regex_sql(p: str) -> str:
    """A pattern of the files above as a regular expression; they hold one escape and no stand-ins."""
    steps = (
        (r"\\(.)", r"\1"), (r"\[!", "[^"), (r"\.", r"\\."), (r"^\*\*/", "\ue001"), (r"/\*\*$", "\ue002"), (r"/\*\*/", "/\ue001"),
        (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\ue001", "(?:.*/)?"), ("\ue002", "/.*"), ("#", r"\\#"),
    )
    for pattern, meant in steps:
        p = f"regexp_replace({p}, {q(pattern)}, {q(meant)}, 'g')"
    return p


COVERAGE_CTES = {
    "tracked": f"SELECT DISTINCT ON (repo, path) {REPO_OF.replace('bigint', 'BIGINT')} AS repo, {tracked_case(1)} AS path, {tracked_case(2)} AS content FROM documents",
    "ignore_lines": r"""SELECT repo, path AS file, regexp_replace(path, '/?[^/]*$', '') AS dir, unnest(range(1, len(ls) + 1)) AS line, regexp_replace(unnest(ls), '\s+$', '') AS pattern
FROM (SELECT *, string_split(content, chr(10)) AS ls FROM tracked WHERE path = '.gitignore' OR ends_with(path, '/.gitignore'))""",
    "ignore_rules": f"""SELECT *, CASE WHEN contains(body, '/') THEN '' ELSE '(?:.*/)?' END || {regex_sql("regexp_replace(body, '^/', '')")} AS regex FROM (
SELECT *, starts_with(pattern, '!') AS negated, ends_with(pattern, '/') AS only_dirs, regexp_replace(regexp_replace(pattern, '^!', ''), '/+$', '') AS body
FROM ignore_lines WHERE pattern <> '' AND NOT starts_with(pattern, '#') AND pattern <> '[z-a].txt')""",
    "entries": "SELECT repo, path, unnest(range(1, n + 1)) AS level, n, array_to_string(parts[1:unnest(range(1, n + 1))], '/') AS entry FROM (SELECT repo, path, string_split(path, '/') AS parts, len(parts) AS n FROM tracked)",
    "fitting": """SELECT e.repo, e.path, e.level, r.file, r.line, r.pattern, r.negated FROM entries e JOIN ignore_rules r ON e.repo = r.repo
AND (r.dir = '' OR starts_with(e.entry, r.dir || '/')) AND (NOT r.only_dirs OR e.level < e.n)
AND regexp_full_match(CASE WHEN r.dir = '' THEN e.entry ELSE substring(e.entry, length(r.dir) + 2) END, r.regex)
QUALIFY row_number() OVER (PARTITION BY e.repo, e.path, e.level ORDER BY length(r.dir) DESC, r.line DESC) = 1""",
    "covered": """SELECT t.repo, t.path, file || ':' || line || ' ' || pattern AS ignored_by FROM tracked t LEFT JOIN
(SELECT * FROM fitting WHERE NOT negated QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY level) = 1) USING (repo, path)""",
}


@query(sql("SELECT repo, path, coalesce(ignored_by, '') AS ignored_by FROM covered", COVERAGE_CTES))
def ignore_coverage(spark, sf_dir):
    return ignores.ignore_coverage(tracked_files(spark, sf_dir)).withColumn("ignored_by", F.coalesce("ignored_by", F.lit("")))


@query(
    sql(
        r"""SELECT repo, path, CASE WHEN secret THEN 'tracked-secret-file' ELSE 'tracked-temporary-file' END AS rule FROM (
SELECT repo, path, regexp_matches(path, '(^|/)(\.env\.[^/]+|[^/]*\.(pem|key))$') OR regexp_matches(path, '(^|/)\.env$') AS secret FROM covered WHERE ignored_by IS NULL)
WHERE secret OR regexp_matches(path, '\.(tmp|swp|pyc|log)$')""",
        COVERAGE_CTES,
    )
)
def tracked_risks(spark, sf_dir):
    return ignores.tracked_risks(tracked_files(spark, sf_dir)).select("repo", "path", "rule")
