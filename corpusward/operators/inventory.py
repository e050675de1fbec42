"""Inventory: what kind of file a path names and whether it deserves a close review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import paths

# --- Fixed values: names that decide how a path is treated --------------------------
SKIP_DIRS = (
    ".git", ".venv", "venv", "env", ".env", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".nox", ".cache", "build", "dist", "node_modules", ".eggs",
    "docs", "doc", ".github", ".gitlab", ".vscode", ".idea", ".claude", "htmlcov", "coverage",
    ".coverage", "data", "output", "outputs", "logs", "tmp", "temp", "notebooks",
)
SKIP_DIRS_INVENTORY = SKIP_DIRS + ("*.egg-info",)
SERVICE_FILES = (
    ".env", ".env.local", ".env.production", ".env.development", ".DS_Store", "Thumbs.db",
    ".editorconfig", ".prettierrc", ".eslintrc", "poetry.lock", "package-lock.json", "yarn.lock",
    "Pipfile.lock",
)
TEMP_SUFFIXES = (".log", ".bak", ".old", ".orig", ".swp", ".swo", ".tmp")
BINARY_SUFFIXES = (
    ".bin", ".csv", ".db", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico", ".jpeg", ".jpg",
    ".parquet", ".pdf", ".pickle", ".pkl", ".png", ".pyc", ".so", ".sqlite", ".sqlite3", ".svgz",
    ".tar", ".webp", ".whl", ".zip",
)
INFRA_NAMES, INFRA_SUFFIXES = ("Dockerfile", "docker-compose.yml"), (".tf", ".tfvars")
CI_DIRS = (".github", ".gitlab")
DOC_SUFFIXES = (".md", ".rst")
CONFIG_NAMES = ("pyproject.toml", "package.json", "package-lock.json")
CONFIG_SUFFIXES = (".json", ".toml", ".yaml", ".yml", ".ini", ".env")
SOURCE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".sh")


def is_binary(path: Column) -> Column:
    return paths.lower_suffix(path).isin(*BINARY_SUFFIXES)


def is_minified(path: Column) -> Column:
    return F.contains(paths.file_name(path), F.lit(".min."))


def category(path: Column) -> Column:
    """Coarse kind of the file; the first fitting case counts."""
    name, ending = paths.file_name(path), paths.lower_suffix(path)
    return (
        F.when(is_binary(path), "binary")
        .when(paths.has_part(path, "tests") | name.startswith("test_"), "tests")
        .when(name.isin(*INFRA_NAMES) | ending.isin(*INFRA_SUFFIXES), "infra")
        .when(paths.any_part_in(path, CI_DIRS), "ci")
        .when(paths.has_part(path, "docs") | ending.isin(*DOC_SUFFIXES), "docs")
        .when(name.isin(*CONFIG_NAMES) | ending.isin(*CONFIG_SUFFIXES), "config")
        .when(ending.isin(*SOURCE_SUFFIXES), "source")
        .otherwise("other")
    )


def skip_reason(path: Column) -> Column:
    """Why a file is left out of close review; null when it is not.

    The folder test also sees the file name, so a file called ``.env`` counts as a
    tooling folder.
    """
    in_tooling = paths.any_part_in(path, SKIP_DIRS_INVENTORY) | F.exists(
        paths.parts(path), lambda part: part.endswith(".egg-info")
    )
    return (
        F.when(in_tooling, "tooling-or-build-directory")
        .when(paths.file_name(path).isin(*SERVICE_FILES), "service-file")
        .when(paths.lower_suffix(path).isin(*TEMP_SUFFIXES), "temp-or-backup-file")
        .when(is_minified(path), "minified-asset")
        .when(is_binary(path), "binary-file")
    )


def skipped_by_line_scan(path: Column) -> Column:
    """The narrower test of the line scan: no package metadata, service or backup files in it."""
    return paths.any_part_in(path, SKIP_DIRS) | is_binary(path) | is_minified(path)


def inventory(files: DataFrame) -> DataFrame:
    """Add ``category``, ``skip_reason`` and ``should_review_deeply``. Reads paths only."""
    path = F.col("path")
    return files.withColumns({"category": category(path), "skip_reason": skip_reason(path)}).withColumn(
        "should_review_deeply", F.col("skip_reason").isNull()
    )


def reviewer_groups(files: DataFrame) -> DataFrame:
    """One row per file and reviewer group that gets it.

    Source reviewers take Python sources outside tests, security reviewers sources and
    configuration, dependency reviewers configuration, requirements and scripts.
    """
    path = F.col("path")
    kind = category(path)
    groups = F.array_compact(
        F.array(
            F.when((kind == "source") & (paths.suffix(path) == ".py"), "source"),
            F.when(kind.isin("source", "config"), "security"),
            F.when(
                (kind == "config")
                | paths.file_name(path).rlike(r"^requirements.*\.txt$")
                | path.startswith("scripts/"),
                "dependency",
            ),
        )
    )
    return files.where(skip_reason(path).isNull()).select("repo", "path", F.explode(groups).alias("group"))
