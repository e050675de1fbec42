"""Version requirements as intervals, and requirements of one package that exclude each other.

Requirements come from requirement files, ``pyproject.toml`` (dependency lists and dependency tables) and
``package.json``. Every clause is an interval of versions, or excludes one version or one series. Versions
are arrays of numbers that sort like versions, so an intersection is the greatest lower and
the smallest upper end: one aggregate with partial sums per repository, ecosystem and
package, whatever the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusward.functions import text
from corpusward.functions.paths import file_name
from corpusward.operators.file_scan import SCOPES
from corpusward.schema import as_findings
from corpusward.sources.corpus import MARKERS, of_groups

PYTHON, NODE = "python", "node"
RELEASE = 6  # numbers of a release that count; further ones are rare and cut
VERSION = r"v?\d+(?:\.\d+)*(?:[._-]?(?:a|b|c|rc|alpha|beta|pre|preview|post|rev|r|dev)[._-]?\d*)*"
CLAUSE = rf"(===|==|~=|!=|>=|<=|=|>|<|\^|~)?\s*(({VERSION})(?:\.[*xX])*|[*xX])"
NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)"
NODE_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
LOWEST, HIGHEST = -1, 1 << 30  # below and above every number of a version


def numbers(found: Column) -> Column:
    return F.transform(found, lambda n: F.least(F.coalesce(n.try_cast("decimal(38,0)"), F.lit(0)), F.lit(HIGHEST - 1)).cast("int"))


def release(version: Column) -> Column:
    """Numbers of the release part."""
    return numbers(F.split(F.regexp_extract(version, r"^[vV]?(\d+(?:\.\d+)*)", 1), r"\."))


def padded(found: Column, filler: int = 0) -> Column:
    return F.slice(F.concat(F.slice(found, 1, RELEASE), F.array_repeat(F.lit(filler), RELEASE)), 1, RELEASE)


def tail_number(version: Column, names: str) -> Column:
    """The number after a part such as ``rc``; 0 if it has none; null without the part."""
    there = version.rlike(rf"(?i)\d[._-]?(?:{names})(?![a-z])")
    number = F.regexp_extract(version, rf"(?i)\d[._-]?(?:{names})[._-]?(\d*)", 1)
    return F.when(there, F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("int"), F.lit(0)))


def version_key(version: Column) -> Column:
    """Array of ten numbers that sorts like the version: release, phase, its number, post and dev.

    Development releases come before previews, these before the release, post releases after it.
    """
    previews = (("a|alpha", 1), ("b|beta", 2), ("c|rc|pre|preview", 3))
    parts = [(tail_number(version, names), rank) for names, rank in previews]
    post, dev = tail_number(version, "post|rev|r"), tail_number(version, "dev")
    phase, number = F.lit(4), F.lit(0)
    for found, rank in parts:
        phase, number = F.when(found.isNotNull(), rank).otherwise(phase), F.coalesce(found, number)
    phase = F.when((phase == 4) & dev.isNotNull() & post.isNull(), 0).otherwise(phase)
    return F.concat(padded(release(version)), F.array(phase, number, F.coalesce(post + 1, F.lit(0)), F.coalesce(dev, F.lit(HIGHEST))))


def series_start(found: Column) -> Column:
    """Before the first version, previews included, whose release starts with these numbers."""
    return F.concat(padded(found), F.array_repeat(F.lit(LOWEST), 4))


def series_end(found: Column) -> Column:
    """After the last version whose release starts with these numbers."""
    return F.concat(padded(found, HIGHEST), F.array_repeat(F.lit(HIGHEST), 4))


def next_series(found: Column, keep: Column) -> Column:
    """The start of the series after that of the first ``keep`` numbers."""
    own, keep = padded(found), F.least(keep, F.lit(RELEASE))
    return series_start(F.concat(F.slice(own, F.lit(1), keep - 1), F.array(F.element_at(own, keep) + 1)))


def interval(op: Column, written: Column, version: Column, node: Column) -> Column:
    """Struct of low, high (arrays, null where open), low_in, high_in (whether the end belongs to it) and the excluded ends."""
    wild = written.rlike(r"[*xX]$")
    any_version = version == ""
    key, rel = version_key(version), release(version)
    length = F.size(rel)
    bare = op == ""
    exact = op.isin("=", "==", "===") | (bare & ~node) | (bare & node & (length >= 3))
    series = wild | (bare & node & (length < 3))
    caret = F.coalesce(F.nullif(F.array_position(F.transform(rel, lambda n: n > 0), F.lit(True)), F.lit(0)), length).cast("int")
    none = F.lit(None).cast("array<int>")

    def made(low, low_in, high, high_in, out_low=none, out_high=none):
        return F.struct(low.alias("low"), F.lit(low_in).alias("low_in"), high.alias("high"), F.lit(high_in).alias("high_in"), out_low.alias("out_low"), out_high.alias("out_high"))

    tilde_keep = F.when(node, F.least(length, F.lit(2))).otherwise(F.greatest(length - 1, F.lit(1)))
    return (
        F.when(any_version, made(none, False, none, False))
        .when((op == "!=") & wild, made(none, False, none, False, series_start(rel), series_end(rel)))
        .when(op == "!=", made(none, False, none, False, key, key))
        .when((op == "^"), made(key, True, next_series(rel, caret), False))
        .when(op.isin("~", "~="), made(key, True, next_series(rel, tilde_keep), False))
        .when(op == ">=", made(F.when(wild, series_start(rel)).otherwise(key), True, none, False))
        .when(op == ">", made(F.when(wild, series_end(rel)).otherwise(key), False, none, False))
        .when(op == "<=", made(none, False, F.when(wild, series_end(rel)).otherwise(key), True))
        .when(op == "<", made(none, False, F.when(wild, series_start(rel)).otherwise(key), False))
        .when(series, made(series_start(rel), True, series_end(rel), True))
        .when(exact, made(key, True, key, True))
    )


def requirement_lines(files: DataFrame) -> DataFrame:
    chosen = files.where(SCOPES["requirement"][0](F.col("path")))
    return chosen.select("repo", "path", F.lit(PYTHON).alias("ecosystem"), F.posexplode(text.lines(F.col("content"))).alias("line", "entry")).withColumn("line", F.col("line") + 1)


def project_entries(files: DataFrame) -> DataFrame:
    """Entries of dependency lists and dependency tables of ``pyproject.toml``."""
    projects = files.where(F.col("path") == "pyproject.toml").select("repo", "path", F.lit(PYTHON).alias("ecosystem"), F.posexplode(text.lines(F.col("content"))).alias("at", "t"))
    # the section and the list that a line belongs to, from the lines before it: all of one file
    before = Window.partitionBy("repo", "path").orderBy("at")
    section = F.last(F.when(F.col("t").rlike(r"^\s*\["), F.regexp_extract("t", r"^\s*\[+([^\]]*)\]", 1)), ignorenulls=True).over(before)
    opened = F.regexp_extract("t", r"^\s*([A-Za-z0-9_.-]+)\s*=\s*\[", 1)
    marked = projects.withColumn("section", F.coalesce(section, F.lit("")))
    key = F.when(opened != "", opened).when(F.col("t").rlike(r"^\s*\]|^\s*\[|^\s*[A-Za-z0-9_.-]+\s*="), F.lit(""))
    marked = marked.withColumn("list", F.coalesce(F.last(key, ignorenulls=True).over(before), F.lit("")))
    in_list = ((F.col("section") == "project") & (F.col("list") == "dependencies")) | (F.col("section") == "project.optional-dependencies") & (F.col("list") != "")
    quoted = F.regexp_extract_all("t", F.lit(r"""["']([A-Za-z0-9][^"']*)["']"""), F.lit(1))
    in_table = F.col("section").rlike(r"^tool\.poetry\.(group\.[^.]+\.)?(dev-)?dependencies$")
    pair = F.regexp_extract_all("t", F.lit(r"""^\s*([A-Za-z0-9][A-Za-z0-9._-]*\s*=\s*(?:\{.*version\s*=\s*)?["'][^"']*)["']"""), F.lit(1))
    as_entry = F.transform(pair, lambda p: F.regexp_replace(p, r"""\s*=.*["']""", " "))
    python_itself = lambda e: ~F.lower(e).rlike(r"^python\s")
    entries = F.when(in_list, quoted).when(in_table, F.filter(as_entry, python_itself))
    return marked.select("repo", "path", "ecosystem", (F.col("at") + 1).alias("line"), F.explode(entries).alias("entry"))


def package_entries(files: DataFrame) -> DataFrame:
    """Entries of the dependency sections of ``package.json``; ranges with alternatives say nothing certain and are left out."""
    packages = files.where(F.col("path") == "package.json")
    schema = ", ".join(f"{s} map<string,string>" for s in NODE_SECTIONS)
    parsed = packages.select("repo", "path", "content", F.from_json("content", schema).alias("j"))
    held = F.flatten(F.array_compact(F.array(*[F.map_entries(f"j.{s}") for s in NODE_SECTIONS])))
    rows = parsed.select("repo", "path", "content", F.inline(held).alias("package", "range")).where(~F.contains("range", F.lit("||")) & ~F.col("range").rlike(r"\s-\s|[:/]"))
    ahead = F.expr("substring_index(content, concat('\"', package, '\"'), 1)")
    line = F.size(F.split(ahead, "\n"))
    return rows.select("repo", "path", F.lit(NODE).alias("ecosystem"), line.alias("line"), F.concat_ws(" ", "package", "range").alias("entry"))


def requirements(files: DataFrame) -> DataFrame:
    """(repo, path, line, ecosystem, name, marker, spec) of every requirement that names a package.

    ``marker`` is the condition after a semicolon, empty without one.
    """
    chosen = of_groups(files, MARKERS).select("repo", "path", "content")
    rows = requirement_lines(chosen).unionByName(project_entries(chosen)).unionByName(package_entries(chosen))
    plain = text.strip(F.regexp_replace("entry", r"(^|\s)#.*$", ""))
    marker = F.regexp_replace(F.regexp_extract(plain, r";(.*)$", 1), r"\s+", "")
    rows = rows.withColumn("marker", F.when(F.col("ecosystem") == NODE, "").otherwise(marker))
    rows = rows.withColumn("entry", F.when(F.col("ecosystem") == NODE, F.col("entry")).otherwise(text.strip(F.regexp_replace(plain, r";.*$", ""))))
    node_name = F.substring_index("entry", " ", 1)
    python_name = F.regexp_replace(F.lower(F.regexp_extract("entry", NAME, 1)), r"[-_.]+", "-")
    name = F.when(F.col("ecosystem") == NODE, node_name).otherwise(python_name)
    after = F.when(F.col("ecosystem") == NODE, F.regexp_replace("entry", r"^\S+\s*", "")).otherwise(F.regexp_replace("entry", rf"{NAME}\s*(\[[^\]]*\])?\s*", ""))
    spec = F.regexp_replace(F.regexp_replace(after, r"\s+", ""), r"[()]", "")
    spaced = F.when(F.col("ecosystem") == NODE, F.regexp_replace(F.regexp_replace(after, r"([<>=~^])\s+", "$1"), r"\s+", ",")).otherwise(spec)
    return rows.select("repo", "path", "line", "ecosystem", name.alias("name"), "marker", spaced.alias("spec")).where("name <> '' AND NOT contains(spec, '@')")


def clauses(rows: DataFrame) -> DataFrame:
    """A row for each clause of a requirement, with its interval; clauses that are no version say nothing."""
    split = rows.select("*", F.explode(F.split("spec", ",")).alias("clause"))
    part = lambda n: F.regexp_extract("clause", rf"^{CLAUSE}$", n)
    known = split.where(F.col("clause").rlike(rf"^(?:{CLAUSE})$"))
    at = interval(part(1), part(2), part(3), F.col("ecosystem") == NODE)
    return known.select(*rows.columns, "clause", at.alias("i")).select(*rows.columns, "clause", "i.*")


def intersections(files: DataFrame) -> DataFrame:
    """One row per package and marker that has a version clause: its ends, its specs and whether no version is left.

    Requirements under a condition are compared with those under the same one, as others may never hold together.

    An end that does not belong to an interval is weaker or stronger than the same end that does: of two equal lower ends, and of two
    equal upper ends, the one left out counts. Excluded versions matter where a single one is left.
    """
    rows = clauses(requirements(files))
    low = F.max(F.when(F.col("low").isNotNull(), F.struct("low", (~F.col("low_in")).alias("open")))).alias("l")
    high = F.min(F.when(F.col("high").isNotNull(), F.struct("high", F.col("high_in").alias("closed")))).alias("h")
    gaps = F.collect_set(F.when(F.col("out_low").isNotNull(), F.struct("out_low", "out_high"))).alias("gaps")  # different exclusions of a package
    specs = F.array_sort(F.collect_set("spec")).alias("specs")
    found = rows.groupBy("repo", "ecosystem", "name", "marker").agg(low, high, gaps, specs, F.min(F.struct("path", "line")).alias("first"))
    zero = F.struct(version_key(F.lit("0")).alias("low"), F.lit(False).alias("open"))  # no release is below it
    found = found.withColumn("l", F.greatest(F.coalesce("l", zero), zero))
    both = F.col("h").isNotNull()
    same = F.col("l.low") == F.col("h.high")
    left_out = F.exists("gaps", lambda g: (g["out_low"] <= F.col("l.low")) & (g["out_high"] >= F.col("h.high")))
    empty = both & ((F.col("l.low") > F.col("h.high")) | (same & (F.col("l.open") | ~F.col("h.closed"))) | left_out)
    return found.withColumn("conflict", F.coalesce(empty, F.lit(False)))


def conflicting_dependencies(files: DataFrame) -> DataFrame:
    """Packages whose requirements no version meets, as findings at their first place."""
    rows = intersections(files).where("conflict")
    none = F.lit(None)
    return as_findings(
        rows.select(
            "repo", "first.path", F.lit("conflicting-dependency").alias("rule"), F.col("first.line").cast("int").alias("line"),
            F.concat("name", F.lit(": "), F.array_join("specs", " and ")).alias("snippet"), none.cast("string").alias("error"),
        )
    )
