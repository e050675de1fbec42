"""An audit that scans only contents it has not seen.

What the text and code rules find in a file depends on its content and on how its path is treated, not on its
repository or number. So findings are kept by a key of content hash and path class, under the version of the rule set.
A later audit hashes its files, scans one file of each key that is not known, and joins all findings back to the files.
Rules on paths and on whole repositories need no text but a few marker files and are evaluated every time.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions import paths
from corpusward.operators import file_scan
from corpusward.operators.code_facts import code_facts
from corpusward.operators.code_rules import CODE_RULES, in_debt_scope, scan_code
from corpusward.operators.file_scan import DEFAULT_MARKER, DEFAULT_SIZE_LIMIT, DEPENDENCY_RULES, LISTENER_SUFFIXES, PATH_RULES, SCOPES, TEXT_RULES, scan_files, with_size
from corpusward.operators.inventory import skipped_by_line_scan
from corpusward.operators.repo_rules import repo_profile, scan_repos
from corpusward.schema import as_findings
from corpusward.session import written

HIT_COLUMNS = ("rule", "line", "snippet", "error")
SHOWS_NAME = "python-parse-error"  # its evidence holds the name of the file


class Kept(NamedTuple):
    """Folders of what is known: ``keys`` (key, scan, version) and ``hits`` (key, scan, version, name, and a hit).

    Only hits whose key was written by the same scan count, so a scan that is lost halfway leaves nothing behind that counts.
    """

    keys: str
    hits: str


def store_at(folder: str) -> Kept:
    return Kept(f"{folder.rstrip('/')}/keys", f"{folder.rstrip('/')}/hits")


def rule_set_version(marker: str = DEFAULT_MARKER, size_limit: int = DEFAULT_SIZE_LIMIT) -> str:
    """Changes with every rule, pattern and setting that decides what a file yields."""
    parts = (file_scan.LINE_RULES, file_scan.WALLET_HITS, CODE_RULES, marker, size_limit)
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def path_class(path: Column) -> Column:
    """One digit for each way in which a rule may treat a path; equal classes are treated alike."""
    tests = [in_scope(path) for in_scope, _ in SCOPES.values()]
    tests += [paths.lower_suffix(path).isin(*LISTENER_SUFFIXES), path.endswith(".py"), in_debt_scope(path), paths.first_part(path) == "references", ~skipped_by_line_scan(path)]
    return F.concat(*[F.when(test, "1").otherwise("0") for test in tests])


def keyed(files: DataFrame) -> DataFrame:
    """repo, path and key of every file with a content."""
    key = F.concat(F.sha2(F.col("content").cast("binary"), 256), path_class(F.col("path")))
    return files.where(F.col("content").isNotNull()).select("repo", "path", key.alias("key"))


def known_or_empty(spark: SparkSession, folder: str, schema: str, version: str) -> DataFrame:
    """Rows of this rule set version; none where nothing has been kept."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, version string").parquet(folder).where(F.col("version") == version).drop("version")


KEYS = "key string, scan string"
HITS = "key string, scan string, name string, rule string, line int, snippet string, error string"


def scan_unknown(files: DataFrame, keys: DataFrame, kept: Kept, marker: str = DEFAULT_MARKER, size_limit: int = DEFAULT_SIZE_LIMIT) -> DataFrame:
    """Scan one file of every unknown key, keep what is found, and return the files scanned: (repo, path, key)."""
    spark, version, scan = files.sparkSession, rule_set_version(marker, size_limit), uuid.uuid4().hex
    unknown = keys.join(known_or_empty(spark, kept.keys, KEYS, version), "key", "left_anti")
    first = unknown.groupBy("key").agg(F.min(F.struct("repo", "path")).alias("f"))
    chosen = written(first.select("key", "f.*"), "chosen")
    scanned = with_size(files.where(F.col("content").isNotNull())).join(chosen.select("repo", "path"), ["repo", "path"], "left_semi")
    parts = [scan_files(scanned, TEXT_RULES + DEPENDENCY_RULES, marker=marker, size_limit=size_limit), scan_code(code_facts(scanned))]
    found = reduce(DataFrame.unionByName, [part.select("repo", "path", *HIT_COLUMNS) for part in parts])
    hits = found.join(chosen, ["repo", "path"]).select("key", paths.file_name(F.col("path")).alias("name"), *HIT_COLUMNS)
    stamp = [F.lit(scan).alias("scan"), F.lit(version).alias("version")]
    hits.select("*", *stamp).write.mode("append").parquet(kept.hits)
    chosen.select("key", *stamp).write.mode("append").parquet(kept.keys)  # last: from now on the hits count
    return chosen


def findings_of(files: DataFrame, keys: DataFrame, kept: Kept, marker: str = DEFAULT_MARKER, size_limit: int = DEFAULT_SIZE_LIMIT) -> DataFrame:
    """All findings of the files: kept ones joined back, and those of the rules that need no text."""
    spark, version = files.sparkSession, rule_set_version(marker, size_limit)
    known, hits = known_or_empty(spark, kept.keys, KEYS, version), known_or_empty(spark, kept.hits, HITS, version)
    joined = keys.join(known, "key").join(hits, ["key", "scan"])
    snippet = F.when(F.col("rule") == SHOWS_NAME, F.replace("snippet", F.col("name"), paths.file_name(F.col("path")))).otherwise(F.col("snippet"))
    of_contents = joined.select("repo", "path", "rule", "line", snippet.alias("snippet"), "error")
    profile = written(repo_profile(files), "profile")
    gated = F.col("rule").isin(*DEPENDENCY_RULES)
    with_manifest = profile.where("has_manifest").select(F.col("repo").alias("_repo"))
    allowed = of_contents.where(~gated).unionByName(of_contents.where(gated).join(with_manifest, F.col("repo").eqNullSafe(F.col("_repo")), "left_semi"))
    return as_findings(allowed).unionByName(scan_files(files, PATH_RULES, marker=marker)).unionByName(scan_repos(profile))


def audit_changes(files: DataFrame, folder: str, marker: str = DEFAULT_MARKER, size_limit: int = DEFAULT_SIZE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Findings of a full audit of ``files``, and the files scanned for it; ``folder`` holds what earlier audits have kept.

    Audits of one folder run one after the other. A first audit, or one with another rule set, scans every different content.
    """
    kept = store_at(folder)
    keys = written(keyed(files), "keys")
    scanned = scan_unknown(files, keys, kept, marker, size_limit)
    return findings_of(files, keys, kept, marker, size_limit), scanned
