"""SQL counterparts of the derived corpus and of its findings, for the DuckDB check."""

from __future__ import annotations

import re

from fixtures import templates as tp
from workload import expected


def q(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def values(rows) -> str:
    return "VALUES " + ",\n".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)


def template_values(templates) -> str:
    rows = [
        f"({t}, {q(path)}, {mod}, [{', '.join(map(str, res))}], {q(kind)}, {q(body)})"
        for t, path, (mod, res), kind, body in templates
    ]
    return "SELECT * FROM (VALUES " + ",\n".join(rows) + ") AS v(tid, path_tpl, modulus, residues, kind, body)"


def corpus_sql(template_cte: str, count: int) -> str:
    return f"""SELECT 'r' || repo_no AS repo, repo_no, doc_id, tid,
  replace(path_tpl, '{{id}}', CAST(doc_id AS VARCHAR)) AS path,
  CASE WHEN kind = 'text' THEN body || chr(10) || text ELSE body END AS content
FROM (SELECT doc_id, text, doc_id // {count} AS repo_no, doc_id % {count} AS tid FROM documents) d
JOIN {template_cte} USING (tid) WHERE list_contains(residues, repo_no % modulus)
UNION ALL
SELECT 'r' || doc_id // {count}, doc_id // {count}, doc_id, 1000 + doc_id % 5, path, text
FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'notes/text_' || doc_id || '.txt' WHEN 1 THEN 'lib/text_' || doc_id || '.sh'
  WHEN 2 THEN 'web/text_' || doc_id || '.js' WHEN 3 THEN 'src/text_' || doc_id || '.go' ELSE 'conf/text_' || doc_id || '.toml' END AS path FROM documents)
UNION ALL
SELECT 'r' || doc_id // {count}, doc_id // {count}, doc_id, 1010 + doc_id % 5, path,
  CASE WHEN doc_id % 5 = 3 THEN '# ' || regexp_replace(text, {q(BREAK)}, chr(10) || '# ', 'g') ELSE text END
FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 1 THEN 'docs/text_' || doc_id || '.md' WHEN 3 THEN 'src/text_' || doc_id || '.py'
  ELSE 'build/text_' || doc_id || '.js' END AS path FROM documents WHERE doc_id % 5 IN (1, 3, 4))
UNION ALL
SELECT 't' || doc_id, doc_id // {count}, doc_id, tid, path, coalesce(content, text) FROM documents JOIN (
  VALUES (2000, '.gitignore', '.env' || chr(10) || '*.log' || chr(10) || '__pycache__/', 10),
         (2001, 'pyproject.toml', '[project]' || chr(10) || 'name = "tidy"', 10), (2002, 'notes.txt', NULL, 20)) AS t(tid, path, content, every) ON doc_id % every = 7"""


BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SP = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def lines_of(source: str, columns: str) -> str:
    """Rows (columns, line, text) of the texts in column ``content``."""
    return f"""SELECT {columns}, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (
  SELECT {columns}, CASE WHEN content = '' THEN [] WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS ls
  FROM (SELECT {columns}, content, string_split_regex(content, {q(BREAK)}) AS parts FROM {source}))"""


def stripped(column: str = "text") -> str:
    return f"regexp_replace({column}, '^{SP}+|{SP}+$', '', 'g')"


def has(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {q(pattern)})"


SUFFIX = r"regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\.[^.]+)$', 1)"
LOWER_SUFFIX = f"lower({SUFFIX})"
NAME = "string_split(path, '/')[-1]"
PARTS = "string_split(path, '/')"
FIRST = "string_split(path, '/')[1]"
STEM = f"left({NAME}, length({NAME}) - length({SUFFIX}))"


def any_part(values_) -> str:
    return f"list_has_any({PARTS}, [{names(values_)}])"


# The suffixes and names of the scopes.
MARKED = "contains(text, '# noqa: audit')"
LINE_SCOPE = (
    f"NOT {any_part(expected.SKIP_DIRS)} AND {LOWER_SUFFIX} NOT IN ({names(expected.BINARY_SUFFIXES)}) AND NOT contains({NAME}, '.min.') "
    f"AND {FIRST} <> 'tests' AND NOT {MARKED} AND NOT ({FIRST} = 'references' AND contains(text, '`'))"
)
WEB_SCOPE = f"{LOWER_SUFFIX} IN ('.html', '.js', '.jsx', '.py', '.ts', '.tsx') AND {FIRST} <> 'references' AND NOT {MARKED}"
WALLET_SCOPE = f"{LOWER_SUFFIX} IN ('.py', '.js', '.jsx', '.ts', '.tsx') AND NOT {MARKED}"

# The patterns of the rules in RE2 syntax.
LINE_PATTERNS = (
    ("todo", f"{B}(TODO|FIXME|HACK|XXX){E}"),
    ("placeholder", f"(?i){B}(lorem ipsum|changeme|password|123456){E}"),
    ("debug-call", rf"{B}(console\.log|debugger|alert|print\()"),
    ("hardcoded-secret", rf"(?i){B}(api[_-]?key|secret|token|password){SP}*[:=]{SP}*['\"][^'\"]{{6,}}"),
    ("private-key-material", "-----BEGIN (RSA|EC|OPENSSH|PRIVATE) KEY-----"),
    ("unsafe-exec", rf"{B}(eval\(|exec\(|pickle\.loads\(|yaml\.load\()"),
    ("os-system", rf"{B}os\.system\("),
    ("shell-true", rf"{B}subprocess\.(run|Popen)\(.*shell{SP}*={SP}*True"),
    ("verify-false", rf"{B}verify{SP}*={SP}*False{E}"),
    ("wildcard-cors", r"""(?i)(cors|allow_origins).*(\*|"\\*"|'\\*')"""),
    ("http-without-tls", r"(?i)http://[^\s\p{Z}'" + '"' + "]+"),
    ("bare-except", rf"^{SP}*except{SP}*:{SP}*$"),
    ("except-pass", rf"^{SP}*pass{SP}*(#.*)?$"),
)
WEB_PATTERNS = (
    ("dangerous-dom-write", rf"{B}document\.write{SP}*\("),
    ("dangerous-inner-html", f"{B}(innerHTML|outerHTML|dangerouslySetInnerHTML){E}"),
    ("token-storage", rf"""(?i)(localStorage|sessionStorage)\.(setItem|getItem)\({SP}*['"][^'"]*(token|jwt|auth|secret|session)[^'"]*['"]"""),
    ("sensitive-log-field", r"(?i)(logger\.(debug|info|warning|error)|console\.(log|debug|warn|error)|print\()([^#\n]{0,160})(token|secret|password|mnemonic|private[_ -]?key)"),
)


def rule_select(rule: str, where: str, source: str = "lines", snippet: str | None = None) -> str:
    cut = snippet or f"left({stripped()}, 160)"
    return f"SELECT repo, repo_no, doc_id, tid, path, {q(rule)} AS rule, line, {cut} AS snippet FROM {source} WHERE {where}"


def line_hits() -> str:
    parts = [
        rule_select(rule, f"{has(pattern)} AND {LINE_SCOPE}" + (f" AND {SUFFIX} <> '.py'" if rule == "todo" else ""))
        for rule, pattern in LINE_PATTERNS
    ]
    parts += [rule_select(rule, f"{has(pattern)} AND {WEB_SCOPE}") for rule, pattern in WEB_PATTERNS]
    return "\nUNION ALL\n".join(parts)


def either_quote(inner: str) -> str:
    return f"'({inner})'|\"({inner})\""


WORDS = f"(?:[a-z]{{2,10}}{SP}+){{11}}[a-z]{{2,10}}|(?:[a-z]{{2,10}}{SP}+){{23}}[a-z]{{2,10}}"


def wallet_hits() -> str:
    """All matches of a line, quotes included; the value is what stands between them."""

    def matches(pattern: str) -> str:
        return f"SELECT repo, repo_no, doc_id, tid, path, line, unnest(regexp_extract_all(text, {q(pattern)})) AS m FROM lines WHERE {WALLET_SCOPE}"

    inner = "substring(m, 2, length(m) - 2)"
    words = f"string_split_regex({inner}, '{SP}+')"
    key = f"right({inner}, 64)"
    start = "left(regexp_replace(lower(k), '^[0x]+', ''), 16)"
    digits = "substring(a, 3)"
    return f"""SELECT repo, repo_no, doc_id, tid, path, 'web3-hardcoded-mnemonic' AS rule, line,
  '"' || w[1] || ' ' || w[2] || ' ... ' || w[len(w)] || '" (' || len(w) || ' words)' AS snippet
FROM (SELECT *, {words} AS w FROM ({matches(either_quote(WORDS))}))
UNION ALL
SELECT repo, repo_no, doc_id, tid, path, 'web3-hardcoded-private-key', line, '"0x' || left(k, 8) || '...' || right(k, 4) || '"'
FROM (SELECT *, {key} AS k FROM ({matches(either_quote('(?:0x)?[0-9a-fA-F]{64}'))}))
WHERE NOT ({start} IN ({names(('0000000000000000', 'aaaaaaaaaaaaaaaa', '1111111111111111', 'deadbeefdeadbeef'))}) OR len(list_distinct(string_split({start}, ''))) <= 2)
UNION ALL
SELECT repo, repo_no, doc_id, tid, path, 'web3-address-no-checksum', line, '"' || left(a, 10) || '...' || right(a, 4) || '"'
FROM (SELECT *, {inner} AS a FROM ({matches(either_quote('0x[0-9a-fA-F]{40}'))}))
WHERE ({digits} = lower({digits}) OR {digits} = upper({digits})) AND {digits} <> repeat('0', 40) AND lower({digits}) <> repeat('dead', 10)"""


# Names of dependency files.
REQ = rf"regexp_matches({NAME}, '^requirements.*\.txt$')"
MANIFEST = "path IN ('pyproject.toml', 'package.json', 'package-lock.json', 'pnpm-lock.yaml', 'yarn.lock')"


def dependency_hits() -> str:
    s = stripped()
    live = f"repo IN (SELECT repo FROM profile WHERE has_manifest) AND {s} <> '' AND NOT starts_with({s}, '#')"
    return "\nUNION ALL\n".join(
        [
            rule_select("unpinned-python-dependency", f"{live} AND {REQ} AND regexp_matches({s}, {q(rf'^[A-Za-z0-9_.-]+(\[[A-Za-z0-9_,.-]+\])?{SP}*(>=|>|<=|<|~=|!=)')})", snippet=s),
            rule_select("direct-dependency-reference", f"{live} AND {REQ} AND regexp_matches({s}, {q(rf'(@{SP}*(git\+|https?://|file:))|(^-e{SP}+)')})", snippet=s),
            rule_select("floating-dependency-version", f"repo IN (SELECT repo FROM profile WHERE has_manifest) AND {MANIFEST} AND " + has(r"""["'](\*|latest|main|master)["']""")),
        ]
    )


def flag(condition: str) -> str:
    return f"coalesce(bool_or({condition}), false)"


def profile() -> str:
    ignore = "path = '.gitignore'"
    header = r"(?s)^---\n.*\bname:\s*.+\n.*\bdescription:\s*.+\n---"
    columns = {
        "has_ignore": flag(ignore),
        "ig_env": flag(f"{ignore} AND contains(content, '.env')"),
        "ig_log": flag(f"{ignore} AND contains(content, '*.log')"),
        "ig_pyc": flag(f"{ignore} AND contains(content, '__pycache__')"),
        "has_env": flag("path = '.env'"),
        "has_manifest": flag("path IN ('requirements.txt', 'pyproject.toml', 'package.json')"),
        "has_skill": flag("path = 'SKILL.md'"),
        "has_header": flag(f"path = 'SKILL.md' AND regexp_matches(content, {q(header)})"),
        "has_yaml": flag("path = 'agents/openai.yaml'"),
        "has_refs": flag("starts_with(path, 'references/')"),
        "has_scripts": flag("starts_with(path, 'scripts/')"),
    }
    return "SELECT repo, any_value(repo_no) AS repo_no, " + ", ".join(f"{c} AS {n}" for n, c in columns.items()) + " FROM corpus GROUP BY repo"


def profile_select(rule: str, path: str, where: str, snippet: str | None = None) -> str:
    return f"SELECT repo, repo_no, NULL AS doc_id, NULL AS tid, {q(path)} AS path, {q(rule)} AS rule, NULL AS line, {q(snippet)} AS snippet FROM profile WHERE {where}"


def lacks(entry: str) -> str:
    return f".gitignore has no line for `{entry}`"


# Rule ids and the paths they are reported at.
IGNORE_SELECTS = (
    ("missing-gitignore", ".gitignore", "NOT has_ignore", None),
    ("gitignore-missing-dotenv", ".gitignore", "has_ignore AND NOT ig_env", lacks(".env")),
    ("gitignore-missing-logs", ".gitignore", "has_ignore AND NOT ig_log", lacks("*.log")),
    ("gitignore-missing-pycache", ".gitignore", "has_ignore AND NOT ig_pyc", lacks("__pycache__")),
    ("tracked-env-risk", ".env", "has_env AND has_ignore AND NOT ig_env", None),
    ("missing-dependency-manifest", ".", "NOT has_manifest AND NOT (has_skill AND has_yaml)", None),
)
STRUCTURE_SELECTS = (
    ("missing-skill-md", "SKILL.md", "NOT has_skill", None),
    ("invalid-skill-frontmatter", "SKILL.md", "has_skill AND NOT has_header", None),
    ("missing-openai-yaml", "agents/openai.yaml", "has_skill AND NOT has_yaml", None),
    ("missing-references-dir", "references", "has_skill AND NOT has_refs", None),
    ("missing-scripts-dir", "scripts", "has_skill AND NOT has_scripts", None),
)


def repo_hits(selects) -> str:
    return "\nUNION ALL\n".join(profile_select(*s) for s in selects)


def path_hits() -> str:
    stale = " OR ".join(f"contains(lower({STEM}), '{w}')" for w in ("archive", "deprecated", "legacy", "old", "unused"))
    tests = (
        ("legacy-config-file", f"{NAME} IN ('pytest.ini', 'requirements.lock')"),
        ("stale-doc-file", f"list_contains({PARTS}, 'docs') AND ({stale})"),
        ("stale-test-file", f"list_contains({PARTS}, 'tests') AND ({stale})"),
        ("backup-artifact-file", " OR ".join(f"ends_with({NAME}, '{e}')" for e in (".bak", ".old", ".orig", ".tmp"))),
    )
    listener = f"{LOWER_SUFFIX} IN ('.js', '.jsx', '.ts', '.tsx') AND contains(content, 'addEventListener(') AND NOT contains(content, 'removeEventListener(')"
    parts = [
        f"SELECT repo, repo_no, doc_id, tid, path, {q(rule)} AS rule, NULL AS line, NULL AS snippet FROM corpus WHERE {where}" for rule, where in tests
    ]
    parts.append(
        f"SELECT repo, repo_no, doc_id, tid, path, 'event-listener-cleanup-missing', NULL, 'addEventListener(...)' FROM corpus WHERE {listener}"
    )
    return "\nUNION ALL\n".join(parts)


def code_hits() -> str:
    golden = values([(t, r, ln, s) for t, r, ln, s in tp.CODE_FINDINGS])
    return f"""SELECT repo, repo_no, doc_id, tid, path, rule, line, snippet
FROM corpus JOIN ({golden}) AS g(tid, rule, line, snippet) USING (tid)"""


CTES = {
    "templates": lambda: template_values(tp.TEMPLATES),
    "corpus": lambda: corpus_sql("templates", len(tp.TEMPLATES)),
    "lines": lambda: lines_of("corpus", "repo, repo_no, doc_id, tid, path"),
    "profile": profile,
    "line_hits": line_hits,
    "wallet_hits": wallet_hits,
    "dependency_hits": dependency_hits,
    "path_hits": path_hits,
    "ignore_hits": lambda: repo_hits(IGNORE_SELECTS),
    "structure_hits": lambda: repo_hits(STRUCTURE_SELECTS),
    "code_hits": code_hits,
    "rules": lambda: "SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ("
    + values(expected.RULES)
    + ") AS v(rule, severity, category, scanner, confidence)",
    "blocked_hits": lambda: "SELECT repo, repo_no, doc_id, tid, path, 'scan-error' AS rule, NULL AS line, NULL AS snippet FROM corpus WHERE tid = 29",
    "all_hits": lambda: "\nUNION ALL\n".join(
        f"SELECT repo, repo_no, doc_id, tid, path, rule, line, snippet FROM {t}"
        for t in ("line_hits", "wallet_hits", "dependency_hits", "path_hits", "ignore_hits", "code_hits", "blocked_hits")
    )
    + "\nUNION ALL SELECT repo, repo_no, doc_id, tid, path, rule, line, snippet FROM structure_hits WHERE rule <> 'missing-skill-md'",
    "findings": lambda: "SELECT h.*, coalesce(h.line, 0) AS line_no, CASE WHEN rule = 'scan-error' THEN 'blocked' ELSE 'finding' END AS kind, "
    "severity, category, scanner, confidence FROM all_hits h JOIN rules USING (rule)",
}


def snapshot(suffix: str, where: str, files: str = "corpus") -> dict[str, str]:
    """The common tables again, over the part of the corpus that a snapshot holds.

    Each is called like its original with ``suffix`` added.
    """
    fixed = ("templates", "rules")
    renamed = {n for n in CTES if n not in fixed}
    pattern = re.compile(rf"\b({'|'.join(renamed)})\b")
    out = {f"{n}{suffix}": pattern.sub(lambda m: m.group(1) + suffix, CTES[n]()) for n in renamed if n != files}
    out[f"{files}{suffix}"] = f"SELECT * FROM {files} WHERE {where}"
    return out


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the common tables it needs, in order."""
    known = {**{n: None for n in CTES}, **(extra or {})}
    texts: dict[str, str] = {}

    def need(text: str) -> None:
        for name in known:
            if name not in texts and re.search(rf"\b{name}\b", text):
                texts[name] = ""
                definition = (extra or {}).get(name) or CTES[name]()
                need(definition)
                texts.pop(name)
                texts[name] = definition

    need(body)
    if not texts:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{t}\n)" for n, t in texts.items()) + "\n" + body
