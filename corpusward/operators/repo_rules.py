"""Rules on whole repositories: ignore files, manifests, required paths.

All of them are answers from one aggregate with a row per repository. Its columns are
boolean, so partial aggregation leaves a few bytes per repository and task: a repository
that holds a third of all files costs no more than a small one, and no presence test
needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import paths, text
from corpusward.functions.sqltext import hit
from corpusward.operators.file_scan import DEFAULT_MARKER, DEPENDENCY_RULES, SCOPES, scan_files
from corpusward.schema import as_findings
from corpusward.sources.corpus import MARKERS, of_groups

# --- Fixed values: paths and entries that are looked for -----------------------------
IGNORE_FILE, ENV_FILE = ".gitignore", ".env"
IGNORE_ENTRIES = (
    (".env", "gitignore-missing-dotenv"),
    ("*.log", "gitignore-missing-logs"),
    ("__pycache__", "gitignore-missing-pycache"),
)
# Further entries of the written checklist.
IGNORE_CHECKLIST = (
    ("venv/", "gitignore-missing-venv"),
    ("dist/", "gitignore-missing-dist"),
    ("build/", "gitignore-missing-build"),
)
MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json")
GATE_FILE = "SKILL.md"
REQUIRED_PATHS = (
    ("agents/openai.yaml", "missing-openai-yaml"),
    ("references", "missing-references-dir"),
    ("scripts", "missing-scripts-dir"),
)
HEADER_PATTERN = r"(?sU)^---\n.*\bname:\s*.+\n.*\bdescription:\s*.+\n---"
CONTEXT_WORDS = ("web3", "aiohttp", "order", "trade", "balance", "pnl")


def any_file(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def repo_profile(files: DataFrame) -> DataFrame:
    """One row of presence flags per repository.

    Two scans feed one aggregate: a listing that reads paths only, and the texts of the
    two marker files, picked by name so that Parquet can skip row groups (and, in a stored
    corpus, all but one partition).
    """
    path, content = F.col("path"), F.col("content")
    listing = files.select("repo", "path", F.lit(None).cast("string").alias("content"))
    marked = of_groups(files, MARKERS).where(path.isin(IGNORE_FILE, GATE_FILE)).select("repo", "path", "content")
    ignore = path == IGNORE_FILE
    entries = {
        f"ignores_{rule}": any_file(ignore & F.contains(content, F.lit(entry)))
        for entry, rule in IGNORE_ENTRIES + IGNORE_CHECKLIST
    }
    required = {f"has_{rule}": any_file(paths.exists_at(path, wanted)) for wanted, rule in REQUIRED_PATHS}
    columns = {
        "has_ignore_file": any_file(ignore),
        "has_env_file": any_file(paths.exists_at(path, ENV_FILE)),
        "has_manifest": any_file(path.isin(*MANIFESTS)),
        "has_gate_file": any_file(path == GATE_FILE),
        "has_header": any_file((path == GATE_FILE) & text.unix_newlines(content).rlike(HEADER_PATTERN)),
        **entries,
        **required,
    }
    return listing.unionByName(marked).groupBy("repo").agg(*[value.alias(name) for name, value in columns.items()])


def gated(profile: DataFrame) -> DataFrame:
    """Repositories that carry the gate file; only these are checked for structure."""
    return profile.where("has_gate_file").select("repo")


def _one(condition: str, rule: str, path: str, snippet: str = "NULL") -> str:
    return f"CASE WHEN {condition} THEN named_struct('path', '{path}', 'h', {hit(rule, 'NULL', snippet)}) END"


def ignore_rules(entries: tuple = IGNORE_ENTRIES) -> list[str]:
    rows = [
        _one(f"has_ignore_file AND NOT `ignores_{rule}`", rule, IGNORE_FILE, f"'{IGNORE_FILE} has no line for `{entry}`'")
        for entry, rule in entries
    ]
    return rows


IGNORE_RULES = (
    [_one("NOT has_ignore_file", "missing-gitignore", IGNORE_FILE)]
    + ignore_rules()
    + [_one("has_env_file AND has_ignore_file AND NOT `ignores_gitignore-missing-dotenv`", "tracked-env-risk", ENV_FILE)]
)
# A repository with the gate file and the agent manifest needs no dependency manifest.
MANIFEST_RULES = [
    _one("NOT has_manifest AND NOT (has_gate_file AND `has_missing-openai-yaml`)", "missing-dependency-manifest", ".")
]
# Without the gate file nothing else is reported.
STRUCTURE_RULES = (
    [_one("NOT has_gate_file", "missing-skill-md", GATE_FILE)]
    + [_one("has_gate_file AND NOT has_header", "invalid-skill-frontmatter", GATE_FILE)]
    + [_one(f"has_gate_file AND NOT `has_{rule}`", rule, wanted) for wanted, rule in REQUIRED_PATHS]
)


def profile_findings(profile: DataFrame, tests: list[str]) -> DataFrame:
    rows = profile.select("repo", F.explode(F.expr(f"array_compact(array({', '.join(tests)}))")).alias("r"))
    return as_findings(rows.select("repo", "r.path", "r.h.*"))


def scan_repos(profile: DataFrame, check_gate: bool = True) -> DataFrame:
    """Ignore-file, manifest and structure findings of every repository.

    With ``check_gate`` structure is only checked where the gate file exists, as in a
    full audit; without it a missing gate file is reported.
    """
    tests = IGNORE_RULES + MANIFEST_RULES
    return profile_findings(profile, tests + (STRUCTURE_RULES[1:] if check_gate else STRUCTURE_RULES))


def scan_dependencies(files: DataFrame, profile: DataFrame) -> DataFrame:
    """Requirement and manifest lines, for repositories that have a manifest at their root.

    The few dependency files are picked by name before anything else, so the join with
    the profile moves those files only.
    """
    path = F.col("path")
    chosen = of_groups(files, MARKERS).where(SCOPES["requirement"][0](path) | SCOPES["manifest"][0](path))
    with_manifest = chosen.join(profile.where("has_manifest").select("repo"), "repo", "left_semi")
    return scan_files(with_manifest, DEPENDENCY_RULES, marker=DEFAULT_MARKER)


def in_context(files: DataFrame, words: tuple[str, ...] = CONTEXT_WORDS) -> DataFrame:
    """Repositories in which one of the context words occurs in a text."""
    found = text.contains_any(F.col("content"), words)
    return files.groupBy("repo").agg(any_file(found).alias("in_context")).where("in_context").select("repo")
