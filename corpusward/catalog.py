"""Rule catalog, severities, categories and scanners: the fixed dimensions of every report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from corpusward.functions.tables import dimension

# --- Fixed values: severities, categories and their report order --------------------
SEVERITIES = (("P0", "Critical"), ("P1", "High"), ("P2", "Medium"), ("P3", "Low"))
CATEGORIES = (
    "Bugs and Logic Errors",
    "Security",
    "Performance and Memory",
    "Data Leaks",
    "Code Quality",
    "Technical Debt",
    "Dependencies and Configuration",
    "Cleanup",
)
BUGS, SECURITY, PERFORMANCE, LEAKS, QUALITY, DEBT, DEPENDENCIES, CLEANUP = CATEGORIES
BLOCKED = "Blocked"

# What each severity means for a release.
SEVERITY_MEANING = {
    "P0": "stops the release: compromise, loss of money, leaked secret, remote code or a sure crash",
    "P1": "serious: likely regression or incident; stops the release in security, leak and runtime areas",
    "P2": "visible quality, reliability or upkeep problem; recorded, seldom stops a release",
    "P3": "minor debt, style or readability",
}

# --- Scanners, in report order, and the reviewer group each one feeds ----------------
SCANNERS = (
    ("line_scan", "source"),
    ("web_scan", "security"),
    ("wallet_scan", "security"),
    ("resource_scan", "source"),
    ("dependency_scan", "dependency"),
    ("policy_scan", "source"),
    ("debt_scan", "source"),
    ("ignore_scan", "security"),
    ("stale_scan", "dependency"),
    ("structure_scan", "dependency"),
    ("checklist_scan", "source"),
)
SCANNER_RANK = {name: rank for rank, (name, _) in enumerate(SCANNERS)}

CODED_CONFIDENCE = 0.85
BLOCKED_CONFIDENCE = 1.0
CONFIDENCE_LEVELS = {"high": 0.9, "medium": 0.6, "low": 0.3}
REVIEW_THRESHOLD = 0.5


class Rule(NamedTuple):
    rule: str
    severity: str
    category: str
    scanner: str
    title: str
    advice: str
    confidence: float = CODED_CONFIDENCE


# --- Fixed values: rule ids, severities and categories. Titles and advice are ours. --
RULES = (
    Rule("todo", "P2", DEBT, "line_scan", "Open task marker", "Finish the task or move it to the tracker"),
    Rule("placeholder", "P2", QUALITY, "line_scan", "Dummy value left in", "Put the real setting or a named constant here"),
    Rule("debug-call", "P2", QUALITY, "line_scan", "Debug output left in", "Delete it or use the application log"),
    Rule("hardcoded-secret", "P0", SECURITY, "line_scan", "Secret written into a file", "Read it from the environment and replace the leaked value"),
    Rule("private-key-material", "P0", SECURITY, "line_scan", "Private key block in a file", "Purge it from history, replace the key, load it from a vault"),
    Rule("unsafe-exec", "P0", SECURITY, "line_scan", "Runs code or unpickles data at run time", "Use a safe parser, loader or dispatch table"),
    Rule("os-system", "P1", SECURITY, "line_scan", "Command through os.system", "Call subprocess with an argument list"),
    Rule("shell-true", "P1", SECURITY, "line_scan", "Subprocess goes through a shell", "Pass a list of arguments without a shell"),
    Rule("verify-false", "P1", SECURITY, "line_scan", "Certificate check switched off", "Keep verification on and trust the right authority"),
    Rule("wildcard-cors", "P1", SECURITY, "line_scan", "Any origin may call", "List the origins that may call"),
    Rule("http-without-tls", "P1", LEAKS, "line_scan", "Unencrypted URL", "Use https"),
    Rule("bare-except", "P1", BUGS, "line_scan", "Except without a type", "Name the exceptions that are expected"),
    Rule("except-pass", "P1", BUGS, "line_scan", "Line does nothing but pass", "Handle or log the case"),
    Rule("scan-error", "P1", BLOCKED, "line_scan", "File could not be read", "Split the file or repair it, then scan again", BLOCKED_CONFIDENCE),
    Rule("dangerous-dom-write", "P1", SECURITY, "web_scan", "Writes raw markup into the page", "Escape or sanitise the markup"),
    Rule("dangerous-inner-html", "P1", SECURITY, "web_scan", "Sets markup of an element", "Escape or sanitise the markup"),
    Rule("token-storage", "P1", LEAKS, "web_scan", "Token kept in browser storage", "Use a secure cookie or memory"),
    Rule("sensitive-log-field", "P1", LEAKS, "web_scan", "Secret named in a log call", "Drop or mask the field"),
    Rule("subprocess-interpolated-command", "P1", SECURITY, "web_scan", "Command built from pieces of text", "Pass a list of checked arguments"),
    Rule("path-interpolation-risk", "P1", SECURITY, "web_scan", "File path built from pieces of text", "Join checked parts below a known folder"),
    Rule("web3-hardcoded-mnemonic", "P0", SECURITY, "wallet_scan", "Seed phrase in a file", "Move the phrase to the environment"),
    Rule("web3-hardcoded-private-key", "P0", SECURITY, "wallet_scan", "Wallet key in a file", "Move the key to the environment"),
    Rule("web3-address-no-checksum", "P2", SECURITY, "wallet_scan", "Address without checksum case", "Store the checksum form"),
    Rule("web3-inline-from-key", "P0", SECURITY, "wallet_scan", "Account made from a literal key", "Read the key from the environment"),
    Rule("event-listener-cleanup-missing", "P2", PERFORMANCE, "resource_scan", "Listener never removed", "Remove it on teardown"),
    Rule("expensive-call-in-loop", "P2", PERFORMANCE, "resource_scan", "Costly call repeated by a loop", "Do the work once or in batches"),
    Rule("open-without-context-manager", "P2", PERFORMANCE, "resource_scan", "File opened outside with", "Open it in a with statement"),
    Rule("aiohttp-session-without-context", "P1", PERFORMANCE, "resource_scan", "HTTP session opened outside with", "Open it in async with"),
    Rule("missing-dependency-manifest", "P2", DEPENDENCIES, "dependency_scan", "No dependency manifest", "Add a manifest"),
    Rule("unpinned-python-dependency", "P2", DEPENDENCIES, "dependency_scan", "Version range in requirements", "Pin one version"),
    Rule("direct-dependency-reference", "P2", DEPENDENCIES, "dependency_scan", "Dependency from a URL or path", "Depend on a released version"),
    Rule("floating-dependency-version", "P2", DEPENDENCIES, "dependency_scan", "Floating version in a manifest", "Name a released version"),
    Rule("python-parse-error", "P1", BUGS, "policy_scan", "Python file does not compile", "Repair the syntax"),
    Rule("python-bare-except", "P1", BUGS, "policy_scan", "Handler without an exception type", "Name the exceptions that are expected"),
    Rule("python-except-pass", "P1", BUGS, "policy_scan", "Handler only passes", "Log, handle or raise again"),
    Rule("python-print-call", "P2", QUALITY, "policy_scan", "print in Python code", "Use the application log"),
    Rule("python-http-no-timeout", "P1", PERFORMANCE, "policy_scan", "HTTP request without timeout", "Set a timeout"),
    Rule("python-float-money", "P1", BUGS, "policy_scan", "Amount of money held as float", "Use Decimal"),
    Rule("python-src-todo", "P2", DEBT, "debt_scan", "Open task marker in a comment", "Finish the task or move it to the tracker"),
    Rule("python-long-function", "P2", DEBT, "debt_scan", "Function too long", "Split it"),
    Rule("python-deep-nesting", "P2", DEBT, "debt_scan", "Blocks nested too deep", "Return early or split the function"),
    Rule("python-missing-type-hints", "P2", QUALITY, "debt_scan", "Public function lacks annotations", "Annotate parameters and result"),
    Rule("python-public-function-no-docstring", "P3", QUALITY, "debt_scan", "Public function lacks a docstring", "Say what it does"),
    Rule("python-empty-function", "P2", DEBT, "debt_scan", "Function does nothing", "Implement, raise or delete it"),
    Rule("python-weak-name", "P3", QUALITY, "debt_scan", "Name says nothing", "Name the thing it holds"),
    Rule("python-magic-number", "P3", QUALITY, "debt_scan", "Unexplained number", "Give the number a name"),
    Rule("python-mutable-default", "P1", BUGS, "debt_scan", "Default value is shared and mutable", "Default to None"),
    Rule("python-async-blocking-call", "P1", PERFORMANCE, "debt_scan", "Coroutine blocks its loop", "Use the asynchronous call"),
    Rule("python-broad-except", "P2", BUGS, "debt_scan", "Handler catches every Exception", "Narrow the type"),
    Rule("missing-gitignore", "P1", DEPENDENCIES, "ignore_scan", "No ignore file", "Add one"),
    Rule("gitignore-missing-dotenv", "P1", DEPENDENCIES, "ignore_scan", "Ignore file lacks .env", "Add the entry"),
    Rule("gitignore-missing-logs", "P1", DEPENDENCIES, "ignore_scan", "Ignore file lacks *.log", "Add the entry"),
    Rule("gitignore-missing-pycache", "P1", DEPENDENCIES, "ignore_scan", "Ignore file lacks __pycache__", "Add the entry"),
    Rule("tracked-env-risk", "P0", LEAKS, "ignore_scan", "Environment file is not ignored", "Ignore it and replace what it held"),
    Rule("legacy-config-file", "P2", CLEANUP, "stale_scan", "Old configuration file", "Delete it if unused"),
    Rule("stale-doc-file", "P2", CLEANUP, "stale_scan", "Document looks outdated", "Update or delete it"),
    Rule("stale-test-file", "P2", CLEANUP, "stale_scan", "Test looks outdated", "Update or delete it"),
    Rule("backup-artifact-file", "P2", CLEANUP, "stale_scan", "Backup copy of a file", "Delete it"),
    Rule("missing-skill-md", "P1", DEPENDENCIES, "structure_scan", "Main instruction file missing", "Add it"),
    Rule("invalid-skill-frontmatter", "P1", DEPENDENCIES, "structure_scan", "Header lacks name or description", "Complete the header"),
    Rule("missing-openai-yaml", "P1", DEPENDENCIES, "structure_scan", "Agent manifest missing", "Add it"),
    Rule("missing-references-dir", "P1", DEPENDENCIES, "structure_scan", "References folder missing", "Add it"),
    Rule("missing-scripts-dir", "P1", DEPENDENCIES, "structure_scan", "Scripts folder missing", "Add it"),
)

MEDIUM, LOW = CONFIDENCE_LEVELS["medium"], CONFIDENCE_LEVELS["low"]

# Rules of the written checklists. A rule that reports an absence is of low confidence.
CHECKLIST_RULES = (
    Rule("url-with-key", "P0", LEAKS, "checklist_scan", "Key inside a URL", "Send the key in a header", MEDIUM),
    Rule("hardcoded-gas-price", "P2", BUGS, "checklist_scan", "Fixed gas price", "Estimate the price", MEDIUM),
    Rule("hardcoded-chain-id", "P2", BUGS, "checklist_scan", "Fixed chain id", "Take it from the settings", MEDIUM),
    Rule("float-equality", "P2", BUGS, "checklist_scan", "Prices compared with ==", "Compare with a tolerance or Decimal", MEDIUM),
    Rule("round-amount", "P2", BUGS, "checklist_scan", "Amount rounded without direction", "Say which way to round", MEDIUM),
    Rule("client-session-no-timeout", "P1", PERFORMANCE, "checklist_scan", "HTTP session without timeout", "Set a timeout", LOW),
    Rule("gather-no-return-exceptions", "P2", BUGS, "checklist_scan", "gather stops at the first error", "Set return_exceptions", LOW),
    Rule("send-without-gas-estimate", "P2", BUGS, "checklist_scan", "Transaction sent without estimate", "Estimate first", LOW),
    Rule("nonce-without-lock", "P1", BUGS, "checklist_scan", "Nonce read and used without a lock", "Guard both calls by one lock", LOW),
    Rule("json-without-status-check", "P1", BUGS, "checklist_scan", "Response used unchecked", "Check the status first", LOW),
    Rule("order-without-slippage-cap", "P1", BUGS, "checklist_scan", "Order without a price limit", "Pass a limit", LOW),
    Rule("commented-code-block", "P2", DEBT, "checklist_scan", "Block of disabled code", "Delete it", MEDIUM),
    Rule("duplicate-block", "P2", DEBT, "checklist_scan", "Same lines in several places", "Move them to one place", MEDIUM),
    Rule("extended-marker", "P2", DEBT, "checklist_scan", "Temporary marker", "Finish the task", MEDIUM),
    Rule("not-implemented-stub", "P2", DEBT, "checklist_scan", "Stub raises NotImplementedError", "Implement it", MEDIUM),
    Rule("debug-true", "P1", SECURITY, "checklist_scan", "Debug mode on", "Switch it off for release", MEDIUM),
    Rule("type-ignore-no-reason", "P3", QUALITY, "checklist_scan", "Type check silenced without a reason", "Give the reason", MEDIUM),
    Rule("duplicate-dependency", "P2", DEPENDENCIES, "checklist_scan", "Dependency listed more than once", "Keep one entry", MEDIUM),
    Rule("conflicting-dependency", "P1", DEPENDENCIES, "checklist_scan", "No version meets all requirements", "Agree on one range", MEDIUM),
    Rule("dev-dependency-in-production", "P2", DEPENDENCIES, "checklist_scan", "Tool listed as a run time dependency", "Move it to the dev list", MEDIUM),
    Rule("unused-dependency", "P2", DEPENDENCIES, "checklist_scan", "Dependency never imported", "Drop it", LOW),
    Rule("gitignore-missing-venv", "P2", DEPENDENCIES, "checklist_scan", "Ignore file lacks venv/", "Add the entry", LOW),
    Rule("gitignore-missing-dist", "P2", DEPENDENCIES, "checklist_scan", "Ignore file lacks dist/", "Add the entry", LOW),
    Rule("gitignore-missing-build", "P2", DEPENDENCIES, "checklist_scan", "Ignore file lacks build/", "Add the entry", LOW),
    Rule("outdated-doc-date", "P2", CLEANUP, "checklist_scan", "Document carries an old date", "Review it", MEDIUM),
    Rule("empty-package-init", "P2", CLEANUP, "checklist_scan", "Package file without modules", "Delete it", MEDIUM),
    Rule("unreferenced-script", "P2", CLEANUP, "checklist_scan", "Script named nowhere", "Delete or document it", LOW),
    Rule("temporary-file", "P2", CLEANUP, "checklist_scan", "Temporary file in the tree", "Delete it", MEDIUM),
    Rule("tracked-secret-file", "P0", LEAKS, "checklist_scan", "File with secrets is not ignored", "Ignore it and replace what it held", MEDIUM),
    Rule("tracked-temporary-file", "P2", CLEANUP, "checklist_scan", "Temporary file is not ignored", "Delete and ignore it", MEDIUM),
    Rule("unchecked-none-result", "P1", BUGS, "checklist_scan", "Result that may be None is used untested", "Test for None first", LOW),
    Rule("broad-except-silent", "P2", BUGS, "checklist_scan", "Broad handler neither logs nor raises", "Log or raise", LOW),
    Rule("hardcoded-url", "P2", QUALITY, "checklist_scan", "URL in source", "Move it to the settings", MEDIUM),
    Rule("unsafe-deserialization", "P0", SECURITY, "checklist_scan", "Unsafe loader", "Use a safe loader", MEDIUM),
    Rule("unvalidated-json-subscript", "P1", BUGS, "checklist_scan", "Subscript on a fresh response", "Check the fields first", MEDIUM),
    Rule("sql-write-outside-with", "P2", BUGS, "checklist_scan", "SQL insert outside with", "Wrap it in a transaction", LOW),
    Rule("no-rate-limit", "P2", PERFORMANCE, "checklist_scan", "Requests in a loop without a pause", "Sleep or use a semaphore", LOW),
    Rule("unguarded-division", "P1", BUGS, "checklist_scan", "Division by a quantity that may be zero", "Test for zero", LOW),
    Rule("retry-without-idempotency", "P0", BUGS, "checklist_scan", "Order retried without a key", "Add an idempotency key", LOW),
    Rule("hardcoded-date", "P2", BUGS, "checklist_scan", "Fixed date in code", "Take it from the settings", MEDIUM),
    Rule("banned-import", "P2", QUALITY, "checklist_scan", "Import barred by the project", "Use the agreed library", MEDIUM),
)

BY_ID = {r.rule: r for r in RULES + CHECKLIST_RULES}

# --- Fixed values: rule sets counted in the coverage summary -------------------------
CLEANUP_RULES = ("backup-artifact-file", "legacy-config-file", "stale-doc-file", "stale-test-file")
TECH_DEBT_RULES = (
    "python-async-blocking-call",
    "python-broad-except",
    "python-deep-nesting",
    "python-empty-function",
    "python-long-function",
    "python-magic-number",
    "python-missing-type-hints",
    "python-mutable-default",
    "python-public-function-no-docstring",
    "python-src-todo",
    "python-weak-name",
)


def severity_table(spark: SparkSession) -> DataFrame:
    return dimension(
        spark,
        [
            {"severity": s, "severity_label": label, "severity_rank": n, "meaning": SEVERITY_MEANING[s]}
            for n, (s, label) in enumerate(SEVERITIES)
        ],
    )


def category_table(spark: SparkSession) -> DataFrame:
    return dimension(spark, [{"category": c, "category_rank": n} for n, c in enumerate(CATEGORIES)])


def scanner_table(spark: SparkSession) -> DataFrame:
    return dimension(
        spark, [{"scanner": s, "group": g, "scanner_rank": n} for n, (s, g) in enumerate(SCANNERS)]
    )
