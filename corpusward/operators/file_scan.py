"""One narrow pass over the files: line rules, whole-file rules and path rules.

Every text is read once. A file becomes the array [whole text, line 1, line 2, ...], so
after ``posexplode`` position 0 stands for the file and position n for its n-th line.
All rules look at that one stream of rows; nothing is shuffled. A rule that only needs
paths leaves ``content`` out of the plan, and a file in which no rule can match (no
guard word occurs) is never split into lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.catalog import Rule
from corpusward.functions import paths, text
from corpusward.functions.sqltext import contains_any, contains_any_folded, hit, one_of, quoted
from corpusward.operators import inventory
from corpusward.schema import HIT, as_findings

DEFAULT_MARKER = "# noqa: audit"
DEFAULT_SIZE_LIMIT = 5 * 1024 * 1024  # bytes; fixed value
SNIPPET_WIDTH = 160  # fixed value
BLOCKED_TEXT = "not read: over the size limit"

B, E = text.NOT_WORD_BEFORE, text.NOT_WORD_AFTER


class LineRule(NamedTuple):
    """A pattern for single lines.

    ``guard`` lists substrings of which each match contains at least one; ``fold`` says
    that case does not matter for them. Guards only save time.
    """

    rule: str
    scope: str
    pattern: str
    guard: tuple[str, ...]
    fold: bool = False


# --- Fixed values: patterns, in Java syntax. B and E stand for a word edge. -----------
LINE_RULES = (
    LineRule("todo", "marker", rf"{B}(TODO|FIXME|HACK|XXX){E}", ("TODO", "FIXME", "HACK", "XXX")),
    LineRule("placeholder", "line", rf"(?iU){B}(lorem ipsum|changeme|password|123456){E}", ("lorem", "changeme", "password", "123456"), True),
    LineRule("debug-call", "line", rf"{B}(console\.log|debugger|alert|print\()", ("console.log", "debugger", "alert", "print(")),
    LineRule("hardcoded-secret", "line", rf"""(?iU){B}(api[_-]?key|secret|token|password){E}\s*[:=]\s*['"][^'"]{{6,}}""", ("key", "secret", "token", "password"), True),
    LineRule("private-key-material", "line", r"-----BEGIN (RSA|EC|OPENSSH|PRIVATE) KEY-----", ("-----BEGIN ",)),
    LineRule("unsafe-exec", "line", rf"{B}(eval\(|exec\(|pickle\.loads\(|yaml\.load\()", ("eval(", "exec(", "pickle.loads(", "yaml.load(")),
    LineRule("os-system", "line", rf"{B}os\.system\(", ("os.system(",)),
    LineRule("shell-true", "line", rf"(?U){B}subprocess\.(run|Popen)\(.*shell\s*=\s*True", ("subprocess.",)),
    LineRule("verify-false", "line", rf"(?U){B}verify\s*=\s*False{E}", ("verify",)),
    LineRule("wildcard-cors", "line", r"""(?iU)(cors|allow_origins).*(\*|"\\*"|'\\*')""", ("cors", "allow_or"), True),
    LineRule("http-without-tls", "line", r"""(?iU)http://[^\s'"]+""", ("http://",), True),
    LineRule("bare-except", "line", r"(?U)^\s*except\s*:\s*$", ("except",)),
    LineRule("except-pass", "line", r"(?U)^\s*pass\s*(#.*)?$", ("pass",)),
    LineRule("dangerous-dom-write", "web", rf"(?U){B}document\.write\s*\(", ("document.write",)),
    LineRule("dangerous-inner-html", "web", rf"{B}(innerHTML|outerHTML|dangerouslySetInnerHTML){E}", ("innerHTML", "outerHTML", "dangerouslySetInnerHTML")),
    LineRule("token-storage", "web", r"""(?iU)(localStorage|sessionStorage)\.(setItem|getItem)\(\s*['"][^'"]*(token|jwt|auth|secret|session)[^'"]*['"]""", ("storage",), True),
    LineRule("sensitive-log-field", "web", r"(?iU)(logger\.(debug|info|warning|error)|console\.(log|debug|warn|error)|print\()([^#\n]{0,160})(token|secret|password|mnemonic|private[_ -]?key)", ("token", "secret", "password", "mnemon", "key"), True),
    LineRule("unpinned-python-dependency", "requirement", r"(?U)^[A-Za-z0-9_.-]+(\[[A-Za-z0-9_,.-]+\])?\s*(>=|>|<=|<|~=|!=)", ("<", ">", "=")),
    LineRule("direct-dependency-reference", "requirement", r"(?U)(@\s*(git\+|https?://|file:))|(^-e\s+)", ("@", "-e")),
    LineRule("floating-dependency-version", "manifest", r"""(?:"|')(\*|latest|main|master)(?:"|')""", ('"', "'")),
)
WEB_SUFFIXES = (".html", ".js", ".jsx", ".py", ".ts", ".tsx")
WALLET_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx")
LISTENER_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")
ROOT_MANIFESTS = ("pyproject.toml", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
LEGACY_NAMES = ("pytest.ini", "requirements.lock")
BACKUP_SUFFIXES = (".bak", ".old", ".orig", ".tmp")
STALE_WORDS = ("archive", "deprecated", "legacy", "old", "unused")
MNEMONIC = r"""(?U)(['"])((?:[a-z]{2,10}\s+){11}[a-z]{2,10}|(?:[a-z]{2,10}\s+){23}[a-z]{2,10})\1"""
PRIVATE_KEY = r"""(['"])(?:0x)?([0-9a-fA-F]{64})\1"""
ADDRESS = r"""(['"])(0x[0-9a-fA-F]{40})\1"""
TEST_KEY_STARTS = ("0000000000000000", "aaaaaaaaaaaaaaaa", "1111111111111111", "deadbeefdeadbeef")
DEAD_ADDRESSES = ("0" * 40, "dead" * 10)

WALLET_RULES = ("web3-hardcoded-mnemonic", "web3-hardcoded-private-key", "web3-address-no-checksum")
PATH_RULES = ("legacy-config-file", "stale-doc-file", "stale-test-file", "backup-artifact-file")
TEXT_RULES = tuple(r.rule for r in LINE_RULES if r.scope in ("marker", "line", "web")) + WALLET_RULES + (
    "event-listener-cleanup-missing",
    "scan-error",
)
DEPENDENCY_RULES = tuple(r.rule for r in LINE_RULES if r.scope in ("requirement", "manifest"))
NARROW_RULES = TEXT_RULES + PATH_RULES + DEPENDENCY_RULES


def _is_web(path: Column) -> Column:
    return paths.lower_suffix(path).isin(*WEB_SUFFIXES) & (paths.first_part(path) != "references")


def _is_line_scanned(path: Column) -> Column:
    return ~inventory.skipped_by_line_scan(path) & (paths.first_part(path) != "tests")


# Which files the lines of a scope come from. Scopes marked True skip oversized files.
SCOPES: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "line": (_is_line_scanned, True),
    "marker": (lambda p: _is_line_scanned(p) & (paths.suffix(p) != ".py"), True),
    "source": (lambda p: _is_line_scanned(p) & (inventory.category(p) == "source"), True),
    "dated": (lambda p: _is_line_scanned(p) & (inventory.category(p) == "source") & ~F.lower(p).rlike("test"), True),
    "web": (_is_web, True),
    "wallet": (lambda p: paths.lower_suffix(p).isin(*WALLET_SUFFIXES), True),
    "requirement": (lambda p: paths.file_name(p).rlike(r"^requirements.*\.txt\z"), False),
    "manifest": (lambda p: p.isin(*ROOT_MANIFESTS), False),
}


NO_HITS = f"CAST(array() AS ARRAY<{HIT}>)"
LINE_TEXT = "text"  # column with the line, or with the whole file at position 0
LOWER_TEXT = "lower_text"  # the same in lower case
STRIPPED = f"regexp_replace({LINE_TEXT}, {quoted(text.STRIP)}, '')"


def is_test_key(key: str) -> str:
    """Placeholder keys: a known start or at most two different characters in the first 16.

    Leading ``0`` and ``x`` characters are stripped first, so a key of zeros is left empty.
    """
    start = f"substring(regexp_replace(lower({key}), '^[0x]+', ''), 1, 16)"
    return f"({one_of(start, TEST_KEY_STARTS)} OR size(array_distinct(split({start}, ''))) <= 2)"


def _matches(rule: str, guard: str, pattern: str, keep: str, shown: str) -> str:
    """One hit per match ``v`` in the line, with the value masked."""
    values = f"filter(regexp_extract_all({LINE_TEXT}, {quoted(pattern)}, 2), v -> {keep})"
    return (
        f"IF({guard} AND {LINE_TEXT} RLIKE {quoted(pattern)}, "
        f"transform({values}, v -> {hit(rule, 'line', shown)}), {NO_HITS})"
    )


_QUOTE = contains_any(LINE_TEXT, ("'", '"'))
_WORDS = r"split(v, '(?U)\\s+')"
_SAME_CASE = "(substring(v, 3) = lower(substring(v, 3)) OR substring(v, 3) = upper(substring(v, 3)))"
WALLET_HITS = {
    "web3-hardcoded-mnemonic": _matches(
        "web3-hardcoded-mnemonic", f"{_QUOTE} AND length({LINE_TEXT}) > 36", MNEMONIC, "true",
        f"concat('\"', {_WORDS}[0], ' ', {_WORDS}[1], ' ... ', element_at({_WORDS}, -1), '\" (', size({_WORDS}), ' words)')",
    ),
    "web3-hardcoded-private-key": _matches(
        "web3-hardcoded-private-key", f"{_QUOTE} AND length({LINE_TEXT}) > 65", PRIVATE_KEY, f"NOT {is_test_key('v')}",
        "concat('\"0x', substring(v, 1, 8), '...', right(v, 4), '\"')",
    ),
    "web3-address-no-checksum": _matches(
        "web3-address-no-checksum", f"contains({LINE_TEXT}, '0x')", ADDRESS,
        f"{_SAME_CASE} AND NOT {one_of('lower(substring(v, 3))', DEAD_ADDRESSES)}",
        "concat('\"', substring(v, 1, 10), '...', right(v, 4), '\"')",
    ),
}


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def with_size(files: DataFrame) -> DataFrame:
    """Files with a byte ``size``; a table without one gets it from its texts."""
    if "size" in files.columns:
        return files
    return files.withColumn("size", F.octet_length("content").cast("long"))


class _Scan(NamedTuple):
    """Parts of one scan: rows with scope flags, the array of units, what a line must
    contain to be looked at, and the hits of a unit."""

    rows: DataFrame
    flags: list[str]
    units: Column
    candidate: str
    hits: str


def scan_files(
    files: DataFrame,
    rules: Iterable[str] = NARROW_RULES,
    extra_rules: Iterable[LineRule] = (),
    extra_catalog: tuple[Rule, ...] = (),
    marker: str = DEFAULT_MARKER,
    size_limit: int | None = DEFAULT_SIZE_LIMIT,
) -> DataFrame:
    """Findings of the chosen narrow rules, in one pass and without a shuffle.

    ``extra_rules`` are line rules of the user, with their catalog rows in
    ``extra_catalog``. A ``size_limit`` of None reads files of any size. Works on a stream
    of files as well.
    """
    scan = _prepare(files, set(rules), list(extra_rules), marker, size_limit)
    rows = scan.rows.select("repo", "path", *scan.flags, F.posexplode(scan.units).alias("line", LINE_TEXT))
    rows = rows.withColumn(LOWER_TEXT, F.when(F.col("line") > 0, F.lower(LINE_TEXT))).where(scan.candidate)
    return as_findings(rows.select("repo", "path", F.expr(f"inline({scan.hits})")), tuple(extra_catalog))


def scan_with_context(
    files: DataFrame,
    rules: Iterable[str] = TEXT_RULES,
    reach: int = 10,
    marker: str = DEFAULT_MARKER,
    size_limit: int | None = DEFAULT_SIZE_LIMIT,
) -> DataFrame:
    """Line hits with the lines around them: (repo, path, rule, line, first_line, context).

    The lines of a file are at hand while it is scanned, so the context is a slice of
    them: no join, and no text is shuffled.
    """
    scan = _prepare(files, set(rules), [], marker, size_limit)
    first = f"greatest(h.line - {reach}, 1)"
    # a line that no rule can match is not looked at closer; its lower case form is only made then
    hits = f"IF({scan.candidate}, {scan.hits}, {NO_HITS})".replace(LOWER_TEXT, f"lower({LINE_TEXT})")
    found = f"flatten(transform(units, ({LINE_TEXT}, line) -> {hits}))"
    shown = (
        f"transform(filter({found}, h -> h.line IS NOT NULL), h -> named_struct('rule', h.rule, 'line', h.line, "
        f"'first_line', {first}, 'context', slice(units, {first} + 1, h.line + {reach} - {first} + 1)))"
    )
    rows = scan.rows.withColumn("units", scan.units)
    return rows.select("repo", "path", F.expr(f"inline({shown})"))


def _prepare(files: DataFrame, wanted: set[str], extra: list[LineRule], marker: str, size_limit: int | None) -> _Scan:
    line_rules = [r for r in LINE_RULES if r.rule in wanted] + extra
    wallet = [r for r in WALLET_RULES if r in wanted]
    scopes = sorted({r.scope for r in line_rules} | ({"wallet"} if wallet else set()))
    path_rules = [r for r in PATH_RULES if r in wanted]
    listener = "event-listener-cleanup-missing" in wanted
    blocked = "scan-error" in wanted
    path, content = F.col("path"), F.col("content")

    flags: dict[str, Column] = {}
    too_large = F.lit(False)
    if size_limit is not None and (blocked or any(SCOPES[s][1] for s in scopes)):
        files = with_size(files)
        too_large = F.col("size") > size_limit
    for scope in scopes:
        in_scope, guarded = SCOPES[scope]
        flags[f"in_{scope}"] = in_scope(path) & ~too_large if guarded else in_scope(path)
    if listener:
        flags["in_listener"] = paths.lower_suffix(path).isin(*LISTENER_SUFFIXES)
    if blocked:  # a file that the line, web or wallet rules would have read
        read = ~inventory.skipped_by_line_scan(path) | _is_web(path) | SCOPES["wallet"][0](path)
        flags["is_blocked"] = F.coalesce(too_large & read, F.lit(False))

    rows = files.withColumns(flags) if flags else files
    units = F.array(F.when(F.col("in_listener"), content) if listener else F.lit(None).cast("string"))
    if scopes:
        # in lower case once for all rules, and only for files that have such rules
        folding = [F.col(f"in_{scope}") for scope in sorted({r.scope for r in line_rules if r.fold})]
        if folding:
            rows = rows.withColumn("lower_content", F.when(_any(folding), F.lower(content)))
        split = F.when(F.expr(_may_match(line_rules, wallet, "content", "lower_content")), text.lines(content))
        units = F.concat(units, F.coalesce(split, F.array().cast("array<string>")))
    if not path_rules:
        rows = rows.where(_any(F.col(name) for name in flags))
    candidate = "line = 0" if not scopes else f"line = 0 OR {_may_match(line_rules, wallet, LINE_TEXT, LOWER_TEXT)}"
    return _Scan(rows, list(flags), units, candidate, _hits(line_rules, wallet, path_rules, listener, blocked, marker))


def _may_match(line_rules: list[LineRule], wallet: list[str], subject: str, lowered: str) -> str:
    """False only for a text, or a line, that no rule in scope can match."""
    tests = []
    for scope in sorted({r.scope for r in line_rules}):
        of_scope = [r for r in line_rules if r.scope == scope]
        if any(not r.guard for r in of_scope):
            tests.append(f"in_{scope}")
            continue
        plain = dict.fromkeys(g for r in of_scope if not r.fold for g in r.guard)
        fold = dict.fromkeys(g for r in of_scope if r.fold for g in r.guard)
        words = [contains_any(subject, plain)] if plain else []
        words += [contains_any_folded(subject, lowered, fold)] if fold else []
        tests.append(f"(in_{scope} AND ({' OR '.join(words)}))")
    if wallet:
        tests.append(f"(in_wallet AND {contains_any(subject, (chr(39), chr(34)))})")
    return " OR ".join(tests)


def _when(condition: str, found: str) -> str:
    return f"CASE WHEN {condition} THEN {found} END"


def _line_rule(rule: LineRule, marker: str) -> str:
    unmarked = f"NOT contains({LINE_TEXT}, {quoted(marker)})"
    subject, allowed, evidence = LINE_TEXT, unmarked, f"substring({STRIPPED}, 1, {SNIPPET_WIDTH})"
    if rule.scope == "requirement":
        subject, allowed, evidence = STRIPPED, f"NOT startswith({STRIPPED}, '#')", STRIPPED
    elif rule.scope == "manifest":
        allowed = "true"
    elif rule.scope in ("line", "marker", "source", "dated"):
        allowed = f"{unmarked} AND NOT (substring_index(path, '/', 1) = 'references' AND contains({LINE_TEXT}, '`'))"
    guard = "true"
    if rule.guard:
        guard = contains_any_folded(LINE_TEXT, LOWER_TEXT, rule.guard) if rule.fold else contains_any(LINE_TEXT, rule.guard)
    return _when(
        f"in_{rule.scope} AND line > 0 AND {guard} AND {subject} RLIKE {quoted(rule.pattern)} AND {allowed}",
        hit(rule.rule, "line", evidence),
    )


_STEM = r"regexp_extract(lower(substring_index(path, '/', -1)), '(?s)^(.+?)(\\.[^.]+)?\\z', 1)"
_STALE = contains_any(_STEM, STALE_WORDS)
PATH_TESTS = {
    "legacy-config-file": one_of("substring_index(path, '/', -1)", LEGACY_NAMES),
    "stale-doc-file": f"array_contains(split(path, '/'), 'docs') AND {_STALE}",
    "stale-test-file": f"array_contains(split(path, '/'), 'tests') AND {_STALE}",
    "backup-artifact-file": "(" + " OR ".join(f"endswith(path, {quoted(e)})" for e in BACKUP_SUFFIXES) + ")",
}
_UNCLEANED = f"contains({LINE_TEXT}, 'addEventListener(') AND NOT contains({LINE_TEXT}, 'removeEventListener(')"


def _hits(line_rules: list[LineRule], wallet: list[str], path_rules: list[str], listener: bool, blocked: bool, marker: str) -> str:
    singles = [_line_rule(rule, marker) for rule in line_rules]
    if listener:
        singles.append(_when(f"line = 0 AND in_listener AND {_UNCLEANED}", hit("event-listener-cleanup-missing", "NULL", "'addEventListener(...)'")))
    if blocked:
        singles.append(_when("line = 0 AND is_blocked", hit("scan-error", error=quoted(BLOCKED_TEXT))))
    singles += [_when(f"line = 0 AND {PATH_TESTS[rule]}", hit(rule)) for rule in path_rules]
    packed = f"array_compact(array({', '.join(singles)}))" if singles else NO_HITS
    if wallet:
        allowed = f"in_wallet AND line > 0 AND NOT contains({LINE_TEXT}, {quoted(marker)})"
        many = [f"IF({allowed}, {WALLET_HITS[rule]}, {NO_HITS})" for rule in wallet]
        packed = f"concat({packed}, {', '.join(many)})"
    return packed


def http_hosts(content: Column) -> Column:
    """Hosts of all addresses without TLS in a text."""
    return F.regexp_extract_all(content, F.lit(r"""(?i)http://([^/\s:'"<>]+)"""), F.lit(1))


RULES_AT_ONCE = 300


def scan_lines_with_table(files: DataFrame, rule_table: DataFrame, marker: str = DEFAULT_MARKER) -> DataFrame:
    """Line scan with rules given as a table (rule, severity, category, pattern, scope).

    The table holds settings, so its rows become literal patterns: each is compiled once
    per task and no row is paired with every rule. ``scope`` is a key of ``SCOPES``. A
    table of more than ``RULES_AT_ONCE`` rules takes a pass over the texts for each so many.
    """
    rows = rule_table.orderBy("rule").collect()
    own = [LineRule(r["rule"], r["scope"], r["pattern"], ()) for r in rows]
    known = tuple(Rule(r["rule"], r["severity"], r["category"], "line_scan", r["rule"], "") for r in rows)
    if not own:
        return scan_files(files, PATH_RULES).limit(0)
    parts = [scan_files(files, (), own[at : at + RULES_AT_ONCE], known, marker) for at in range(0, len(own), RULES_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)
