"""Rules of the written checklists that a pattern or a fact decides.

They are reported with medium confidence, or low confidence where they report that
something is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusward.functions import paths, text
from corpusward.functions.sqltext import hit, one_of, quoted
from corpusward.operators import inventory, names
from corpusward.operators.code_rules import CALLS_OF, each
from corpusward.operators.file_scan import DEFAULT_MARKER, NO_HITS, SCOPES, LineRule, scan_files
from corpusward.operators.repo_rules import IGNORE_CHECKLIST, ignore_rules, profile_findings
from corpusward.schema import as_findings
from corpusward.sources.corpus import MARKERS, PYTHON, of_groups

B, E = text.NOT_WORD_BEFORE, text.NOT_WORD_AFTER

# Patterns of the checklist, in Java syntax.
LINE_RULES = (
    LineRule("url-with-key", "line", r"""(?iU)https?://[^\s'"]+[?&](key|apikey|token)=""", ("key=", "token="), True),
    LineRule("hardcoded-gas-price", "source", rf"(?iU){B}gas_?price\s*=\s*[0-9]", ("gas",), True),
    LineRule("hardcoded-chain-id", "source", rf"(?iU){B}chain_?id\s*=\s*[0-9]", ("chain",), True),
    LineRule("float-equality", "source", r"(?iU)price\w*\s*==|==\s*\w*price", ("==",), True),
    LineRule("round-amount", "source", rf"(?U){B}round\(\s*\w*amount\w*\s*,", ("round(",)),
    LineRule("extended-marker", "source", rf"{B}(TEMP|STUB){E}", ("TEMP", "STUB")),
    LineRule("not-implemented-stub", "source", rf"(?U){B}raise\s+NotImplementedError{E}", ("NotImplementedError",)),
    LineRule("debug-true", "line", rf"(?U){B}DEBUG\s*=\s*True{E}", ("DEBUG",)),
    LineRule("hardcoded-url", "source", r"(?i)https?://", ("://",)),
    LineRule("unvalidated-json-subscript", "source", r"(?U)\.json\(\)\s*\[", (".json()",)),
    LineRule("hardcoded-date", "dated", rf"{B}(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}{E}", ("-",)),
)
WALLET_CONTEXT_RULES = ("url-with-key", "hardcoded-gas-price", "hardcoded-chain-id", "float-equality", "round-amount", "unvalidated-json-subscript")

ORDER_CALLS = ("place_order", "create_order", "market_order", "create_market_order")
PRICE_LIMITS = ("max_slippage", "slippage", "worst_price", "price")
UNSAFE_LOADERS = ("pickle.load", "pickle.loads", "pickle.Unpickler", "marshal.load", "marshal.loads")
QUANTITIES = ("volume", "liquidity", "count")


def calls_have(condition: str) -> str:
    return f"exists({CALLS_OF}, c -> {condition})"


def of_calls(keep: str, rule: str) -> str:
    return each("calls", keep, rule, "f.qualified")


def of_functions(keep: str, rule: str) -> str:
    return each("functions", keep, rule, "f.name")


SENDS = calls_have("c.short IN ('send_transaction', 'send_raw_transaction')")
LOCKED = "exists(f.withs, w -> contains(lower(w), 'lock'))"
# Order counts: only what surely came before, or stands in the same loop, or around the call.
UNPREPARED_SEND = "exists(f.ordered_calls, c -> c.short IN ('send_transaction', 'send_raw_transaction') AND NOT array_contains(c.before, 'estimate_gas'))"
HASTY_LOOP = (
    "exists(f.ordered_calls, c -> c.loops > 0 AND c.short NOT IN ('send_transaction', 'send_raw_transaction') "
    "AND NOT array_contains(c.loop_calls, 'sleep') AND NOT exists(c.withs, w -> contains(lower(w), 'sem')))"
)
UNGUARDED = f"exists(f.unguarded, d -> {one_of('lower(substring_index(d, chr(46), -1))', QUANTITIES)})"
YAML_UNSAFE = "f.qualified = 'yaml.load' AND NOT exists(f.kwarg_values, v -> endswith(v, 'SafeLoader'))"

# Rules on code facts: rule -> expression.
FACT_RULES = {
    "client-session-no-timeout": of_calls("f.short = 'ClientSession' AND NOT array_contains(f.kwargs, 'timeout')", "client-session-no-timeout"),
    "gather-no-return-exceptions": of_calls("f.qualified IN ('asyncio.gather', 'gather') AND NOT array_contains(f.kwargs, 'return_exceptions')", "gather-no-return-exceptions"),
    "order-without-slippage-cap": of_calls(f"{one_of('f.short', ORDER_CALLS)} AND NOT exists(f.kwargs, k -> {one_of('k', PRICE_LIMITS)})", "order-without-slippage-cap"),
    "send-without-gas-estimate": of_functions(UNPREPARED_SEND, "send-without-gas-estimate"),
    "nonce-without-lock": of_functions(f"{SENDS} AND {calls_have('c.short = ' + quoted('get_transaction_count'))} AND NOT {LOCKED}", "nonce-without-lock"),
    "json-without-status-check": of_functions(
        f"{calls_have('c.short = ' + quoted('json') + ' AND c.func_kind = ' + quoted('attribute'))} "
        f"AND NOT exists(f.attrs, a -> a IN ('status', 'status_code', 'ok', 'raise_for_status'))",
        "json-without-status-check",
    ),
    "no-rate-limit": of_functions(HASTY_LOOP, "no-rate-limit"),
    "unguarded-division": of_functions(UNGUARDED, "unguarded-division"),
    "retry-without-idempotency": of_functions(
        "exists(f.decorators, d -> contains(lower(d), 'retry')) AND contains(lower(f.name), 'order') "
        "AND NOT exists(f.params, p -> contains(lower(p.name), 'idempot') OR p.name = 'client_order_id')",
        "retry-without-idempotency",
    ),
    "broad-except-silent": each("handlers", "(f.type_kind IS NULL OR array_contains(f.type_names, 'Exception')) AND NOT f.has_raise AND NOT f.has_log", "broad-except-silent", "''"),
    "unsafe-deserialization": of_calls(f"{one_of('f.qualified', UNSAFE_LOADERS)} OR ({YAML_UNSAFE})", "unsafe-deserialization"),
    "sql-write-outside-with": of_calls(r"f.short IN ('execute', 'executemany') AND f.arg0_value RLIKE '(?i)^\\s*insert' AND NOT f.inside_with", "sql-write-outside-with"),
    "type-ignore-no-reason": each("comments", r"f.text RLIKE '^#\\s*type:\\s*ignore(\\[[^\\]]*\\])?\\s*$'", "type-ignore-no-reason", "f.text"),
}
# Rules that only matter where the repository deals with chains, orders or prices.
CONTEXT_FACT_RULES = (
    "client-session-no-timeout", "gather-no-return-exceptions", "order-without-slippage-cap", "send-without-gas-estimate",
    "nonce-without-lock", "json-without-status-check", "no-rate-limit", "unguarded-division", "retry-without-idempotency",
    "sql-write-outside-with",
)

# Tools that only development needs.
DEV_TOOLS = ("black", "coverage", "flake8", "isort", "mypy", "pre-commit", "pylint", "pytest", "ruff", "tox")
# Packages that are imported under another name.
MODULE_OF = {
    "attrs": "attr", "beautifulsoup4": "bs4", "mysqlclient": "mysqldb", "opencv-python": "cv2", "pillow": "pil", "protobuf": "google",
    "psycopg2-binary": "psycopg2", "pycryptodome": "crypto", "pyjwt": "jwt", "pyserial": "serial", "python-dateutil": "dateutil",
    "python-dotenv": "dotenv", "pyyaml": "yaml", "scikit-image": "skimage", "scikit-learn": "sklearn", "setuptools": "pkg_resources",
}
TEMPORARY_SUFFIXES = (".tmp", ".swp", ".pyc")
MAX_DOC_AGE_MONTHS = 6


def checklist_lines(files: DataFrame, marker: str = DEFAULT_MARKER) -> DataFrame:
    """Line patterns of the checklist, in the same single pass as the coded line rules."""
    return scan_files(files, (), LINE_RULES, marker=marker)


def checklist_code(facts: DataFrame) -> DataFrame:
    """Fact rules of the checklist; narrow, like the coded ones."""
    arrays = ", ".join(f"coalesce({sql}, {NO_HITS})" for sql in FACT_RULES.values())
    sources = facts.where(~F.array_contains(paths.parts(F.col("path")), "tests"))
    return as_findings(sources.select("repo", "path", F.expr(f"inline(concat({arrays}))")))


def only_in_context(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """Keep trading and chain rules for repositories in that context, other rules always.

    One pass over the findings: contexts have one row per repository, so the left join
    keeps their number, and Spark broadcasts them or splits a hot repository by size.
    """
    gated = F.col("rule").isin(*WALLET_CONTEXT_RULES, *CONTEXT_FACT_RULES)
    marked = contexts.select("repo", F.lit(True).alias("in_context"))
    kept = findings.join(marked, "repo", "left").where(~gated | F.col("in_context").isNotNull())
    return kept.select(*findings.columns)


def banned_imports(facts: DataFrame, banned: DataFrame) -> DataFrame:
    """Imports of modules, or of parts of modules, that a project bars (column ``module``)."""
    imports = facts.select("repo", "path", F.posexplode_outer("imports").alias("place", "f")).where("f IS NOT NULL")
    names = F.array_distinct(F.array(F.col("f.module"), F.substring_index("f.module", ".", 1)))
    barred = imports.withColumn("module", F.explode(names)).join(banned.select("module").distinct(), "module", "left_semi")
    once = barred.select("repo", "path", "place", F.col("f.line").alias("line"), F.col("f.module").alias("name")).distinct()
    return as_findings(once.select("repo", "path", F.expr(f"inline(array({hit('banned-import', 'line', 'name')}))")))


def commented_blocks(files: DataFrame, longer_than: int = 3) -> DataFrame:
    """Runs of more than three comment lines in source files: first line and length.

    Only comment lines reach the window, whose groups are single files.
    """
    path = F.col("path")
    sources = files.where((inventory.category(path) == "source") & SCOPES["line"][0](path))
    lines = sources.select("repo", "path", F.posexplode(text.lines(F.col("content"))).alias("at", "text"))
    comments = lines.where(F.col("text").rlike(r"(?U)^\s*(#|//)"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("repo", "path").orderBy("at"))
    return (
        comments.withColumn("island", island)
        .groupBy("repo", "path", "island")
        .agg((F.min("at") + 1).alias("line"), F.count("*").alias("lines"))
        .where(F.col("lines") > longer_than)
        .select("repo", "path", "line", "lines")
    )


def duplicate_blocks(files: DataFrame, size: int = 4) -> DataFrame:
    """Blocks of ``size`` lines that occur in more than one place.

    Lines are stripped and blank ones dropped. A block is known by a 128 bit hash, so the
    shuffle moves numbers and not texts; occurrences are counted per file first, so that a
    block found in a third of all files is a small group too. Shown are the number of
    places and files and the first place (by repository, path and line).
    """
    numbered = F.expr(
        f"filter(transform(ls, (t, i) -> named_struct('n', i + 1, 't', regexp_replace(t, {quoted(text.STRIP)}, ''))), x -> x.t <> '')"
    )
    block = f"array_join(transform(slice(kept, i, {size}), x -> x.t), '\\n')"
    windows = F.expr(
        f"transform(IF(size(kept) >= {size}, sequence(1, size(kept) - {size} + 1), array()), "
        f"i -> named_struct('line', kept[i - 1].n, 'h1', xxhash64({block}), 'h2', xxhash64(1, {block})))"
    )
    split = files.select("repo", "path", text.lines(F.col("content")).alias("ls")).select("repo", "path", numbered.alias("kept"))
    rows = split.select("repo", "path", F.inline(windows))
    per_file = rows.groupBy("h1", "h2", "repo", "path").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    found = per_file.groupBy("h1", "h2").agg(
        F.sum("n").alias("places"), F.count("*").alias("files"), F.min(F.struct("repo", "path", "line")).alias("first")
    )
    return found.where("places > 1").select("first.*", "places", "files")


def block_findings(comments: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Comment runs and duplicate blocks as findings, at their first line."""
    number = lambda column: F.col(column).cast("string")
    commented = comments.withColumns({"rule": F.lit("commented-code-block"), "snippet": F.concat(number("lines"), F.lit(" comment lines"))})
    repeated = duplicates.withColumns(
        {"rule": F.lit("duplicate-block"), "snippet": F.concat(number("places"), F.lit(" places in "), number("files"), F.lit(" files"))}
    )
    columns = ["repo", "path", "rule", "line", "snippet"]
    hits = commented.select(*columns).unionByName(repeated.select(*columns))
    return as_findings(hits.withColumn("error", F.lit(None).cast("string")))


def requirement_names(files: DataFrame) -> DataFrame:
    """Named requirements: (repo, path, line, name), names in lower case with dashes."""
    chosen = of_groups(files, MARKERS).where(SCOPES["requirement"][0](F.col("path")))
    lines = chosen.select("repo", "path", F.posexplode(text.lines(F.col("content"))).alias("at", "text"))
    name = F.regexp_replace(F.lower(F.regexp_extract(text.strip(F.col("text")), r"^([A-Za-z0-9][A-Za-z0-9_.-]*)", 1)), r"[_.]", "-")
    return lines.select("repo", "path", (F.col("at") + 1).alias("line"), name.alias("name")).where("name <> ''")


def dependency_hygiene(files: DataFrame, facts: DataFrame, profile: DataFrame) -> DataFrame:
    """Duplicate, development-only and unused requirements, and missing ignore entries."""
    named = requirement_names(files)
    repeated = named.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first")).where("n > 1")
    duplicate = repeated.select("repo", F.col("first.path").alias("path"), F.col("first.line").alias("line"), F.lit("duplicate-dependency").alias("rule"), F.col("name").alias("snippet"))

    production = named.where(paths.file_name(F.col("path")) == "requirements.txt")
    tools = production.where(F.col("name").isin(*DEV_TOOLS)).select("repo", "path", "line", F.lit("dev-dependency-in-production").alias("rule"), F.col("name").alias("snippet"))

    # one row per repository and imported top module
    imported = facts.select("repo", F.explode(F.expr("array_distinct(transform(imports, i -> lower(substring_index(i.module, '.', 1))))")).alias("module")).distinct()
    other = F.create_map(*[F.lit(part) for pair in MODULE_OF.items() for part in pair])
    wanted = named.withColumn("module", F.coalesce(F.try_element_at(other, "name"), F.replace("name", F.lit("-"), F.lit("_"))))
    unused = wanted.join(imported, ["repo", "module"], "left_anti").select("repo", "path", "line", F.lit("unused-dependency").alias("rule"), F.col("name").alias("snippet"))

    hits = duplicate.unionByName(tools).unionByName(unused).withColumn("error", F.lit(None).cast("string"))
    return as_findings(hits).unionByName(profile_findings(profile, ignore_rules(IGNORE_CHECKLIST)))


def outdated_docs(files: DataFrame, as_of: str, months: int = MAX_DOC_AGE_MONTHS) -> DataFrame:
    """Documents whose newest date is more than six months old."""
    docs = files.where(inventory.category(F.col("path")) == "docs")
    dates = F.regexp_extract_all("content", F.lit(rf"{B}((?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}){E}"), F.lit(1))
    newest = F.array_max(F.filter(F.transform(dates, lambda d: F.try_to_date(d)), lambda d: d.isNotNull()))
    limit = F.add_months(F.lit(as_of).cast("date"), -months)
    rows = docs.select("repo", "path", newest.alias("newest")).where(F.col("newest") < limit)
    return _found(rows, "outdated-doc-date", F.col("newest").cast("string"))


def empty_packages(files: DataFrame) -> DataFrame:
    """Blank ``__init__.py`` files in folders without another Python file.

    The folder is reduced to two flags and a path before it is shuffled.
    """
    path = F.col("path")
    python = of_groups(files, PYTHON).where(path.endswith(".py"))
    init = paths.file_name(path) == "__init__.py"
    folders = python.groupBy("repo", paths.parent_dir(path).alias("dir")).agg(
        F.max(F.when(init & (text.strip(F.col("content")) == ""), path)).alias("path"), F.bool_or(~init).alias("has_modules")
    )
    return _found(folders.where("path IS NOT NULL AND NOT has_modules"), "empty-package-init")


def unreferenced_scripts(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files in ``scripts/`` whose name occurs in no other file of the repository, by the index of names."""
    return _found(names.unreferenced_scripts(files, index), "unreferenced-script")


def temporary_files(files: DataFrame) -> DataFrame:
    return _found(files.where(paths.suffix(F.col("path")).isin(*TEMPORARY_SUFFIXES)), "temporary-file")


def cleanup_hygiene(files: DataFrame, as_of: str, index: DataFrame) -> DataFrame:
    """Outdated documents, empty packages, unreferenced scripts (by ``names.name_index``) and temporary files."""
    return (
        outdated_docs(files, as_of)
        .unionByName(empty_packages(files))
        .unionByName(unreferenced_scripts(files, index))
        .unionByName(temporary_files(files))
    )


def _found(rows: DataFrame, rule: str, snippet: Column | None = None) -> DataFrame:
    none = F.lit(None)
    shown = none if snippet is None else snippet
    return as_findings(
        rows.select("repo", "path", F.lit(rule).alias("rule"), none.cast("int").alias("line"), shown.cast("string").alias("snippet"), none.cast("string").alias("error"))
    )
