"""Code rules: SQL expressions on the fact arrays of one file; no join, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import paths, text
from corpusward.functions.sqltext import hit, one_of, quoted
from corpusward.operators.file_scan import NO_HITS, is_test_key
from corpusward.schema import as_findings

# --- Fixed values: limits and name sets of the code rules ---------------------------
MAX_FUNCTION_LENGTH = 50
MAX_NESTING = 3
DEBT_SKIP_DIRS = ("__pycache__", ".git", ".venv", "build", "dist", "docs", "references", "tests")
WEAK_NAMES = ("data", "temp", "val", "x")
PLAIN_NUMBERS = (0, 1, 2)
NUMBER_WRAPPERS = ("Decimal", "dict", "list", "set")
MUTABLE_DEFAULTS = ("list", "dict", "set", "call:dict", "call:list", "call:set")
HTTP_VERBS = ("delete", "get", "patch", "post", "put", "request")
MONEY_NAMES = ("amount", "balance", "cost", "price", "profit", "size", "total", "value")
EXPENSIVE_CALLS = (
    "json.load", "json.loads", "open", "Path.read_bytes", "Path.read_text", "requests.get",
    "requests.post", "requests.put", "requests.patch", "requests.delete",
)
SHELL_CALLS = ("subprocess.run", "subprocess.Popen")
PATH_CALLS = ("open", "Path.open", "Path.read_text", "Path.read_bytes")
BUILT_TEXT = ("fstring", "add", "format")
COMMENT_MARKERS = rf"{text.NOT_WORD_BEFORE}(TODO|FIXME|HACK){text.NOT_WORD_AFTER}"

def each(facts: str, keep: str, rule: str, snippet: str) -> str:
    """Hits for the elements ``f`` of a fact array that ``keep`` accepts."""
    return f"transform(filter({facts}, f -> {keep}), f -> {hit(rule, 'f.line', snippet)})"


def said(facts: str, keep: str, rule: str, words: str) -> str:
    return each(facts, keep, rule, quoted(words))


def of_function(keep: str, rule: str, words: str) -> str:
    """Evidence that starts with the name of the function."""
    return each("functions", keep, rule, f"concat(f.name, ' ', {words})")


def sorted_names(values: str) -> str:
    return f"array_sort(array_distinct({values}))"


IS_PUBLIC = "NOT startswith(f.name, '_')"
LENGTH = "(f.end_line - f.line + 1)"
DEPTH = "coalesce(array_max(f.block_depths), 0)"

# Parameters without annotation in their order, then the result.
MISSING_HINTS = """concat(
    transform(
        filter(f.params, p -> NOT p.annotated AND NOT (p.name IN ('self', 'cls') AND p.kind NOT IN ('vararg', 'kwarg'))),
        p -> concat(CASE p.kind WHEN 'vararg' THEN '*' WHEN 'kwarg' THEN '**' ELSE '' END, p.name)),
    IF(f.returns_annotated, CAST(array() AS ARRAY<STRING>), array('return')))"""

PARAM_NAMES = "transform(filter(f.params, p -> p.kind IN ('normal', 'kwonly')), p -> p.name)"
FOUND_WEAK_NAMES = sorted_names(f"filter(concat({PARAM_NAMES}, f.targets), n -> {one_of('n', WEAK_NAMES)})")

UNEXPLAINED = (
    f"n.value NOT IN {PLAIN_NUMBERS} AND n.parent_kind <> 'unaryop' AND NOT n.upper_target "
    f"AND NOT {one_of('n.parent_call', NUMBER_WRAPPERS)}"
)
MAGIC_NUMBERS = sorted_names(f"transform(filter(f.literals, n -> {UNEXPLAINED}), n -> n.text)")

# The calls in the body of a function.
CALLS_OF = "transform(f.call_ids, i -> element_at(calls, i + 1))"
BLOCKING_CALLS = sorted_names(
    f"filter(transform({CALLS_OF}, c -> c.qualified), n -> n = 'time.sleep' OR startswith(n, 'requests.'))"
)

REQUESTS_CALL = f"f.func_kind = 'attribute' AND f.receiver <=> 'requests' AND {one_of('f.short', HTTP_VERBS)}"
INLINE_KEY = (
    f"contains(f.qualified, 'from_key') AND {one_of('f.arg0_kind', ('string', 'constant', 'fstring'))} "
    f"AND NOT (f.arg0_value IS NOT NULL AND {is_test_key('f.arg0_value')})"
)
# One hit for each loop around the call.
LOOPED = (
    f"flatten(transform(filter(calls, f -> f.loop_depth > 0 AND {one_of('f.qualified', EXPENSIVE_CALLS)}), "
    f"f -> array_repeat({hit('expensive-call-in-loop', 'f.line', 'f.qualified')}, f.loop_depth)))"
)


def built_text(rule: str, names: tuple[str, ...]) -> str:
    return each("calls", f"{one_of('f.qualified', names)} AND {one_of('f.arg0_kind', BUILT_TEXT)}", rule, "f.qualified")


SECURITY, POLICY, DEBT, RESOURCE = "security", "policy", "debt", "resource"

# rule -> (area, expression)
CODE_RULES: dict[str, tuple[str, str]] = {
    "subprocess-interpolated-command": (SECURITY, built_text("subprocess-interpolated-command", SHELL_CALLS)),
    "path-interpolation-risk": (SECURITY, built_text("path-interpolation-risk", PATH_CALLS)),
    "web3-inline-from-key": (SECURITY, each("calls", INLINE_KEY, "web3-inline-from-key", "f.qualified")),
    "expensive-call-in-loop": (RESOURCE, LOOPED),
    "open-without-context-manager": (RESOURCE, said("calls", "f.func_kind = 'name' AND f.short = 'open' AND NOT f.inside_with", "open-without-context-manager", "open(...)")),
    "aiohttp-session-without-context": (RESOURCE, said("calls", "f.qualified = 'aiohttp.ClientSession' AND NOT f.inside_with", "aiohttp-session-without-context", "aiohttp.ClientSession(...)")),
    "python-parse-error": (POLICY, f"IF(parse_error IS NULL, {NO_HITS}, array({hit('python-parse-error', 'parse_error.line', 'parse_error.message')}))"),
    "python-bare-except": (POLICY, said("handlers", "f.type_kind IS NULL", "python-bare-except", "catches without a type")),
    "python-except-pass": (POLICY, said("handlers", "f.sole_stmt <=> 'pass'", "python-except-pass", "handler only passes")),
    "python-print-call": (POLICY, said("calls", "f.short = 'print'", "python-print-call", "calls print")),
    "python-http-no-timeout": (POLICY, said("calls", f"{REQUESTS_CALL} AND NOT array_contains(f.kwargs, 'timeout')", "python-http-no-timeout", "request with no timeout")),
    "python-float-money": (POLICY, said("assigns", f"f.value_call <=> 'float' AND exists(f.targets, t -> {one_of('lower(t)', MONEY_NAMES)})", "python-float-money", "amount held as float")),
    "python-src-todo": (DEBT, each("comments", f"f.text RLIKE {quoted(COMMENT_MARKERS)}", "python-src-todo", f"regexp_replace(f.text, {quoted(text.STRIP)}, '')")),
    "python-long-function": (DEBT, of_function(f"{LENGTH} > {MAX_FUNCTION_LENGTH}", "python-long-function", f"'is ', {LENGTH}, ' lines long'")),
    "python-deep-nesting": (DEBT, of_function(f"{DEPTH} > {MAX_NESTING}", "python-deep-nesting", f"'is nested to depth ', {DEPTH}")),
    "python-missing-type-hints": (DEBT, of_function(f"{IS_PUBLIC} AND size({MISSING_HINTS}) > 0", "python-missing-type-hints", f"'no type for: ', array_join({MISSING_HINTS}, ', ')")),
    "python-public-function-no-docstring": (DEBT, of_function(f"{IS_PUBLIC} AND NOT f.has_docstring", "python-public-function-no-docstring", "'is undocumented'")),
    "python-empty-function": (DEBT, of_function(one_of("f.sole_stmt", ("pass", "return_none")), "python-empty-function", "'does nothing'")),
    "python-weak-name": (DEBT, of_function(f"size({FOUND_WEAK_NAMES}) > 0", "python-weak-name", f"'vague names: ', array_join({FOUND_WEAK_NAMES}, ', ')")),
    "python-magic-number": (DEBT, of_function(f"size({MAGIC_NUMBERS}) > 0", "python-magic-number", f"'numbers without a name: ', array_join({MAGIC_NUMBERS}, ', ')")),
    "python-mutable-default": (DEBT, of_function(f"exists(f.params, p -> {one_of('p.default_kind', MUTABLE_DEFAULTS)})", "python-mutable-default", "'shares a default value'")),
    "python-async-blocking-call": (DEBT, of_function(f"f.is_async AND size({BLOCKING_CALLS}) > 0", "python-async-blocking-call", f"'blocks on: ', array_join({BLOCKING_CALLS}, ', ')")),
    "python-broad-except": (DEBT, said("handlers", f"{one_of('f.type_kind', ('name', 'tuple'))} AND array_contains(f.type_names, 'Exception')", "python-broad-except", "catches every Exception")),
}


def in_debt_scope(path: Column) -> Column:
    return (paths.suffix(path) == ".py") & ~paths.any_part_in(path, DEBT_SKIP_DIRS)


def blocked_if(condition: str, words: str) -> str:
    return f"IF({condition}, array({hit('scan-error', error=quoted(words))}), {NO_HITS})"


def code_hits(rules: Iterable[str] = tuple(CODE_RULES), with_blocked: bool = True) -> str:
    """Array of hits of one fact row, as SQL. Files that cannot be read give blocked rows."""
    wanted = set(rules)
    scopes = {SECURITY: "is_python", RESOURCE: "is_python", POLICY: "NOT bad_bytes", DEBT: "in_debt_scope"}
    arrays = []
    for area, scope in scopes.items():
        found = [f"coalesce({sql}, {NO_HITS})" for rule, (where, sql) in CODE_RULES.items() if where == area and rule in wanted]
        if found:
            arrays.append(f"IF({scope}, concat({', '.join(found)}), {NO_HITS})")
    if with_blocked:
        arrays += [
            blocked_if("token_failure IS NOT NULL AND in_debt_scope", "file cannot be tokenised"),
            blocked_if("parse_failure IS NOT NULL", "file cannot be analysed"),
            blocked_if("bad_bytes", "file is not valid UTF-8"),
        ]
    return f"concat({', '.join(arrays)})"


def scan_code(facts: DataFrame, rules: Iterable[str] = tuple(CODE_RULES), with_blocked: bool = True) -> DataFrame:
    """Findings of the chosen code rules on fact rows."""
    path = F.col("path")
    scoped = facts.withColumns({"is_python": paths.suffix(path) == ".py", "in_debt_scope": in_debt_scope(path)})
    hits = scoped.select("repo", "path", F.expr(f"inline({code_hits(rules, with_blocked)})"))
    return as_findings(hits)
