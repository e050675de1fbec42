"""What the queries must find, written out for the SQL side alone.

Fixed values: names, rule tables and word lists as the rules define them. Nothing here is
read from the engine, so that a wrong value there shows up as a difference.
"""

from __future__ import annotations

SKIP_DIRS = (
    ".git", ".venv", "venv", "env", ".env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    ".nox", ".cache", "build", "dist", "node_modules", ".eggs", "docs", "doc", ".github", ".gitlab", ".vscode",
    ".idea", ".claude", "htmlcov", "coverage", ".coverage", "data", "output", "outputs", "logs", "tmp", "temp",
    "notebooks",
)
BINARY_SUFFIXES = (
    ".bin", ".csv", ".db", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".parquet", ".pdf",
    ".pickle", ".pkl", ".png", ".pyc", ".so", ".sqlite", ".sqlite3", ".svgz", ".tar", ".webp", ".whl", ".zip",
)
SERVICE_FILES = (
    ".env", ".env.local", ".env.production", ".env.development", ".DS_Store", "Thumbs.db", ".editorconfig",
    ".prettierrc", ".eslintrc", "poetry.lock", "package-lock.json", "yarn.lock", "Pipfile.lock",
)
TEMP_SUFFIXES = (
    ".log", ".bak", ".old", ".orig", ".swp", ".swo", ".tmp",
)
TECH_DEBT_RULES = (
    "python-async-blocking-call", "python-broad-except", "python-deep-nesting", "python-empty-function",
    "python-long-function", "python-magic-number", "python-missing-type-hints", "python-mutable-default",
    "python-public-function-no-docstring", "python-src-todo", "python-weak-name",
)
CLEANUP_RULES = (
    "backup-artifact-file", "legacy-config-file", "stale-doc-file", "stale-test-file",
)
STOP_RULES = (
    "hardcoded-secret", "missing-gitignore", "private-key-material", "tracked-env-risk",
)
STOP_CATEGORIES = (
    "Bugs and Logic Errors", "Data Leaks", "Performance and Memory", "Security",
)
DOCUMENTED_STOP_RULES = (
    "hardcoded-secret", "missing-gitignore", "private-key-material", "tracked-env-risk", "gitignore-missing-dotenv",
    "gitignore-missing-logs",
)
RUN_STEPS = (
    "inventory", "line_scan", "web_scan", "wallet_scan", "resource_scan", "dependency_scan", "policy_scan",
    "debt_scan", "ignore_scan", "stale_scan", "comparison", "verdict",
)
MIGRATION_RULES = (
    "python-print-call", "debug-call", "python-async-blocking-call", "banned-import",
)
REFACTOR_RULES = (
    "python-float-money", "python-long-function", "python-deep-nesting", "python-magic-number", "duplicate-block",
)
CONTEXT_WORDS = (
    "web3", "aiohttp", "order", "trade", "balance", "pnl",
)
DEV_TOOLS = (
    "black", "coverage", "flake8", "isort", "mypy", "pre-commit", "pylint", "pytest", "ruff", "tox",
)
CATEGORIES = (
    "Bugs and Logic Errors", "Security", "Performance and Memory", "Data Leaks", "Code Quality", "Technical Debt",
    "Dependencies and Configuration", "Cleanup",
)
CONTEXT_RULES = (
    "url-with-key", "hardcoded-gas-price", "hardcoded-chain-id", "float-equality", "round-amount",
    "unvalidated-json-subscript", "client-session-no-timeout", "gather-no-return-exceptions",
    "order-without-slippage-cap", "send-without-gas-estimate", "nonce-without-lock", "json-without-status-check",
    "no-rate-limit", "unguarded-division", "retry-without-idempotency", "sql-write-outside-with",
)
SKIP_DIRS_INVENTORY = SKIP_DIRS + ("*.egg-info",)
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
# rule, severity, category, scanner, confidence
RULES = (
    ("todo", "P2", "Technical Debt", "line_scan", 0.85),
    ("placeholder", "P2", "Code Quality", "line_scan", 0.85),
    ("debug-call", "P2", "Code Quality", "line_scan", 0.85),
    ("hardcoded-secret", "P0", "Security", "line_scan", 0.85),
    ("private-key-material", "P0", "Security", "line_scan", 0.85),
    ("unsafe-exec", "P0", "Security", "line_scan", 0.85),
    ("os-system", "P1", "Security", "line_scan", 0.85),
    ("shell-true", "P1", "Security", "line_scan", 0.85),
    ("verify-false", "P1", "Security", "line_scan", 0.85),
    ("wildcard-cors", "P1", "Security", "line_scan", 0.85),
    ("http-without-tls", "P1", "Data Leaks", "line_scan", 0.85),
    ("bare-except", "P1", "Bugs and Logic Errors", "line_scan", 0.85),
    ("except-pass", "P1", "Bugs and Logic Errors", "line_scan", 0.85),
    ("scan-error", "P1", "Blocked", "line_scan", 1.0),
    ("dangerous-dom-write", "P1", "Security", "web_scan", 0.85),
    ("dangerous-inner-html", "P1", "Security", "web_scan", 0.85),
    ("token-storage", "P1", "Data Leaks", "web_scan", 0.85),
    ("sensitive-log-field", "P1", "Data Leaks", "web_scan", 0.85),
    ("subprocess-interpolated-command", "P1", "Security", "web_scan", 0.85),
    ("path-interpolation-risk", "P1", "Security", "web_scan", 0.85),
    ("web3-hardcoded-mnemonic", "P0", "Security", "wallet_scan", 0.85),
    ("web3-hardcoded-private-key", "P0", "Security", "wallet_scan", 0.85),
    ("web3-address-no-checksum", "P2", "Security", "wallet_scan", 0.85),
    ("web3-inline-from-key", "P0", "Security", "wallet_scan", 0.85),
    ("event-listener-cleanup-missing", "P2", "Performance and Memory", "resource_scan", 0.85),
    ("expensive-call-in-loop", "P2", "Performance and Memory", "resource_scan", 0.85),
    ("open-without-context-manager", "P2", "Performance and Memory", "resource_scan", 0.85),
    ("aiohttp-session-without-context", "P1", "Performance and Memory", "resource_scan", 0.85),
    ("missing-dependency-manifest", "P2", "Dependencies and Configuration", "dependency_scan", 0.85),
    ("unpinned-python-dependency", "P2", "Dependencies and Configuration", "dependency_scan", 0.85),
    ("direct-dependency-reference", "P2", "Dependencies and Configuration", "dependency_scan", 0.85),
    ("floating-dependency-version", "P2", "Dependencies and Configuration", "dependency_scan", 0.85),
    ("python-parse-error", "P1", "Bugs and Logic Errors", "policy_scan", 0.85),
    ("python-bare-except", "P1", "Bugs and Logic Errors", "policy_scan", 0.85),
    ("python-except-pass", "P1", "Bugs and Logic Errors", "policy_scan", 0.85),
    ("python-print-call", "P2", "Code Quality", "policy_scan", 0.85),
    ("python-http-no-timeout", "P1", "Performance and Memory", "policy_scan", 0.85),
    ("python-float-money", "P1", "Bugs and Logic Errors", "policy_scan", 0.85),
    ("python-src-todo", "P2", "Technical Debt", "debt_scan", 0.85),
    ("python-long-function", "P2", "Technical Debt", "debt_scan", 0.85),
    ("python-deep-nesting", "P2", "Technical Debt", "debt_scan", 0.85),
    ("python-missing-type-hints", "P2", "Code Quality", "debt_scan", 0.85),
    ("python-public-function-no-docstring", "P3", "Code Quality", "debt_scan", 0.85),
    ("python-empty-function", "P2", "Technical Debt", "debt_scan", 0.85),
    ("python-weak-name", "P3", "Code Quality", "debt_scan", 0.85),
    ("python-magic-number", "P3", "Code Quality", "debt_scan", 0.85),
    ("python-mutable-default", "P1", "Bugs and Logic Errors", "debt_scan", 0.85),
    ("python-async-blocking-call", "P1", "Performance and Memory", "debt_scan", 0.85),
    ("python-broad-except", "P2", "Bugs and Logic Errors", "debt_scan", 0.85),
    ("missing-gitignore", "P1", "Dependencies and Configuration", "ignore_scan", 0.85),
    ("gitignore-missing-dotenv", "P1", "Dependencies and Configuration", "ignore_scan", 0.85),
    ("gitignore-missing-logs", "P1", "Dependencies and Configuration", "ignore_scan", 0.85),
    ("gitignore-missing-pycache", "P1", "Dependencies and Configuration", "ignore_scan", 0.85),
    ("tracked-env-risk", "P0", "Data Leaks", "ignore_scan", 0.85),
    ("legacy-config-file", "P2", "Cleanup", "stale_scan", 0.85),
    ("stale-doc-file", "P2", "Cleanup", "stale_scan", 0.85),
    ("stale-test-file", "P2", "Cleanup", "stale_scan", 0.85),
    ("backup-artifact-file", "P2", "Cleanup", "stale_scan", 0.85),
    ("missing-skill-md", "P1", "Dependencies and Configuration", "structure_scan", 0.85),
    ("invalid-skill-frontmatter", "P1", "Dependencies and Configuration", "structure_scan", 0.85),
    ("missing-openai-yaml", "P1", "Dependencies and Configuration", "structure_scan", 0.85),
    ("missing-references-dir", "P1", "Dependencies and Configuration", "structure_scan", 0.85),
    ("missing-scripts-dir", "P1", "Dependencies and Configuration", "structure_scan", 0.85),
    ("url-with-key", "P0", "Data Leaks", "checklist_scan", 0.6),
    ("hardcoded-gas-price", "P2", "Bugs and Logic Errors", "checklist_scan", 0.6),
    ("hardcoded-chain-id", "P2", "Bugs and Logic Errors", "checklist_scan", 0.6),
    ("float-equality", "P2", "Bugs and Logic Errors", "checklist_scan", 0.6),
    ("round-amount", "P2", "Bugs and Logic Errors", "checklist_scan", 0.6),
    ("client-session-no-timeout", "P1", "Performance and Memory", "checklist_scan", 0.3),
    ("gather-no-return-exceptions", "P2", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("send-without-gas-estimate", "P2", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("nonce-without-lock", "P1", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("json-without-status-check", "P1", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("order-without-slippage-cap", "P1", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("commented-code-block", "P2", "Technical Debt", "checklist_scan", 0.6),
    ("duplicate-block", "P2", "Technical Debt", "checklist_scan", 0.6),
    ("extended-marker", "P2", "Technical Debt", "checklist_scan", 0.6),
    ("not-implemented-stub", "P2", "Technical Debt", "checklist_scan", 0.6),
    ("debug-true", "P1", "Security", "checklist_scan", 0.6),
    ("type-ignore-no-reason", "P3", "Code Quality", "checklist_scan", 0.6),
    ("duplicate-dependency", "P2", "Dependencies and Configuration", "checklist_scan", 0.6),
    ("conflicting-dependency", "P1", "Dependencies and Configuration", "checklist_scan", 0.6),
    ("dev-dependency-in-production", "P2", "Dependencies and Configuration", "checklist_scan", 0.6),
    ("unused-dependency", "P2", "Dependencies and Configuration", "checklist_scan", 0.3),
    ("gitignore-missing-venv", "P2", "Dependencies and Configuration", "checklist_scan", 0.3),
    ("gitignore-missing-dist", "P2", "Dependencies and Configuration", "checklist_scan", 0.3),
    ("gitignore-missing-build", "P2", "Dependencies and Configuration", "checklist_scan", 0.3),
    ("outdated-doc-date", "P2", "Cleanup", "checklist_scan", 0.6),
    ("empty-package-init", "P2", "Cleanup", "checklist_scan", 0.6),
    ("unreferenced-script", "P2", "Cleanup", "checklist_scan", 0.3),
    ("temporary-file", "P2", "Cleanup", "checklist_scan", 0.6),
    ("tracked-secret-file", "P0", "Data Leaks", "checklist_scan", 0.6),
    ("tracked-temporary-file", "P2", "Cleanup", "checklist_scan", 0.6),
    ("unchecked-none-result", "P1", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("broad-except-silent", "P2", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("hardcoded-url", "P2", "Code Quality", "checklist_scan", 0.6),
    ("unsafe-deserialization", "P0", "Security", "checklist_scan", 0.6),
    ("unvalidated-json-subscript", "P1", "Bugs and Logic Errors", "checklist_scan", 0.6),
    ("sql-write-outside-with", "P2", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("no-rate-limit", "P2", "Performance and Memory", "checklist_scan", 0.3),
    ("unguarded-division", "P1", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("retry-without-idempotency", "P0", "Bugs and Logic Errors", "checklist_scan", 0.3),
    ("hardcoded-date", "P2", "Bugs and Logic Errors", "checklist_scan", 0.6),
    ("banned-import", "P2", "Code Quality", "checklist_scan", 0.6),
)
# priority, rule, path pattern, evidence pattern, action
CONTEXT_TABLE = (
    (10, "todo", "^(tests|docs)/", None, "drop"),
    (10, "placeholder", "^(tests|docs|examples)/", r"(?i)example[.]com|test@|sample|dummy", "drop"),
    (10, "wildcard-cors", r"(^|/)(dev|local)[^/]*$", None, "low"),
    (10, "python-print-call", r"(^|/)[^/]*backtest[^/]*$", None, "drop"),
    (10, "except-pass", r"(^|/)__init__[.]py$", None, "drop"),
    (10, "python-except-pass", r"(^|/)__init__[.]py$", None, "drop"),
    (10, "unsafe-exec", "^tests/", None, "drop"),
    (10, "python-float-money", r"(?i)(^|/)[^/]*(report|plot|display)[^/]*$", None, "low"),
    (10, "web3-inline-from-key", None, r"os[.](environ|getenv)", "drop"),
    (10, "hardcoded-date", r"(^|/)[^/]*backtest[^/]*$", None, "drop"),
)
# priority, rule, kind of block, action
CONTEXT_BLOCKS = (
    (10, "wildcard-cors", "debug-branch", "low"),
    (10, "except-pass", "abstract-class", "drop"),
    (10, "except-pass", "protocol-class", "drop"),
    (10, "except-pass", "finally", "low"),
    (10, "python-except-pass", "finally", "low"),
    (10, "python-empty-function", "abstract-class", "drop"),
    (10, "python-empty-function", "protocol-class", "drop"),
    (10, "python-missing-type-hints", "main-guard", "drop"),
    (10, "python-print-call", "main-guard", "low"),
    (10, "debug-call", "main-guard", "low"),
    (10, "placeholder", "docstring", "low"),
)
