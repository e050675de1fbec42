"""The full audit: files in, findings and their reports out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from corpusward.operators.code_facts import code_facts
from corpusward.operators.code_rules import scan_code
from corpusward.operators.config import apply_config
from corpusward.operators.file_scan import DEFAULT_MARKER, DEFAULT_SIZE_LIMIT, PATH_RULES, TEXT_RULES, scan_files
from corpusward.operators.history import compare_runs
from corpusward.operators.repo_rules import repo_profile, scan_dependencies, scan_repos
from corpusward.operators.reports import coverage, finding_summary
from corpusward.operators.verdict import verdict
from corpusward.schema import stamp_run
from corpusward.session import written


class Audit(NamedTuple):
    findings: DataFrame
    comparison: DataFrame | None
    decision: DataFrame
    coverage: DataFrame
    summary: DataFrame


def collect_findings(files: DataFrame, marker: str = DEFAULT_MARKER, size_limit: int = DEFAULT_SIZE_LIMIT) -> DataFrame:
    """Findings of all scanners, before settings are applied.

    The text pass and the code pass are narrow. Only the repository profile and the
    manifest gate shuffle, and both move little.
    """
    profile = repo_profile(files)
    return (
        scan_files(files, TEXT_RULES + PATH_RULES, marker=marker, size_limit=size_limit)
        .unionByName(scan_code(code_facts(files)))
        .unionByName(scan_dependencies(files, profile))
        .unionByName(scan_repos(profile))
    )


def audit(
    files: DataFrame,
    run_id: str,
    overrides: DataFrame | None = None,
    suppressions: DataFrame | None = None,
    previous: DataFrame | None = None,
    marker: str = DEFAULT_MARKER,
    size_limit: int = DEFAULT_SIZE_LIMIT,
) -> Audit:
    """Scan, apply settings, compare with the previous run and decide.

    Findings are written once under the shared folder, so that the reports read that
    table and no text is scanned twice.
    """
    found = apply_config(collect_findings(files, marker, size_limit), overrides, suppressions)
    findings = written(stamp_run(found, run_id), "findings", ("scanner",))
    repos = files.select("repo").distinct()  # a clean repository has its reports too
    return Audit(
        findings,
        compare_runs(previous, findings) if previous is not None else None,
        verdict(findings, repos=repos, run_id=run_id),
        coverage(files, findings),
        finding_summary(findings, repos),
    )
