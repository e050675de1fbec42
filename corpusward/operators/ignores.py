"""What the ignore files of a repository really cover.

Every pattern becomes a regular expression for paths below the folder of its ignore file: anchors,
``**``, character classes, escapes, folder patterns and negation. A file is ignored if the first of
its folders, or itself, whose last fitting pattern does not negate is. Patterns of a deeper ignore file
come after those of the folders above it.

A path meets only the ignore files above it, by an equal join on folder, so a repository with many of them costs a file
no more than its depth. All rows are paths and patterns; only ignore files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import paths, text
from corpusward.schema import as_findings

IGNORE_FILE = ".gitignore"
# Stand-ins while a pattern is rewritten; private use characters, dropped from patterns that hold them.
STAR, MARK, OPEN, SLASH, NOT, CLASS, CLASS_END, ANY_FOLDERS, ALL_BELOW = map(chr, range(0xE010, 0xE019))

# --- Fixed values: names of files that hold secrets, and endings of temporary files -------------
SECRET_NAMES = r"^(\.env(\..+)?|.*\.(pem|key|p12|pfx|keystore)|id_(rsa|dsa|ecdsa|ed25519)|\.npmrc|\.pypirc|\.netrc)$"
SECRET_SAMPLES = r"\.(example|sample|template|dist)$"
TEMPORARY = r"(\.(tmp|swp|swo|pyc|pyo|log)$|(^|/)__pycache__/)"


def as_regex(pattern: Column) -> Column:
    """The regular expression of a pattern without its ``!``, final and leading slash.

    Null for a pattern with a class whose range falls, such as ``[z-a]``, which is dropped. Named classes are taken letter by letter.
    """
    p = F.regexp_replace(pattern, f"[{STAR}-{ALL_BELOW}]", "")
    for written, stand_in in ((r"\\\*", STAR), (r"\\\?", MARK), (r"\\\[", OPEN), (r"\\\\", SLASH)):
        p = F.regexp_replace(p, written, stand_in)
    p = F.regexp_replace(p, r"\\(.)", "$1")
    p = F.regexp_replace(p, r"\[[!^]", f"[{NOT}")
    p = F.regexp_replace(p, rf"\[({NOT}?[^\[\]/*?{NOT}]+)\]", f"{CLASS}$1{CLASS_END}")
    ranges = F.flatten(F.transform(F.regexp_extract_all(p, F.lit(f"{CLASS}([^{CLASS_END}]*){CLASS_END}"), F.lit(1)), lambda c: F.regexp_extract_all(c, F.lit(".-."), F.lit(0))))
    impossible = F.exists(ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
    p = F.regexp_replace(p, r"([.+^$(){}|&\[\]#~])", r"\\$1")
    p = F.regexp_replace(p, r"^\*\*/", ANY_FOLDERS)
    p = F.regexp_replace(p, r"/\*\*$", ALL_BELOW)
    p = F.regexp_replace(p, r"/\*\*/", f"/{ANY_FOLDERS}")
    p = F.regexp_replace(F.regexp_replace(p, r"\*+", "[^/]*"), r"\?", "[^/]")
    for stand_in, meant in ((STAR, r"\\*"), (MARK, r"\\?"), (OPEN, r"\\["), (SLASH, r"\\\\"), (NOT, "^"), (CLASS, "["), (CLASS_END, "]"), (ANY_FOLDERS, "(?:.*/)?"), (ALL_BELOW, "/.*")):
        p = F.regexp_replace(p, stand_in, meant)
    return F.when(~impossible, p)


def patterns(files: DataFrame) -> DataFrame:
    """(repo, dir, line, pattern, negated, only_dirs, regex) of every pattern of every ignore file.

    ``regex`` is for paths below ``dir``. Blank lines and remarks are no patterns.
    """
    ignore = files.where(paths.file_name(F.col("path")) == IGNORE_FILE)
    lines = ignore.select("repo", paths.parent_dir(F.col("path")).alias("dir"), F.posexplode(text.lines(F.col("content"))).alias("at", "t"))
    lines = lines.withColumn("pattern", F.regexp_replace("t", r"(?<!\\)[ \t]+$", "")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    negated = F.col("pattern").startswith("!")
    body = F.when(negated, F.expr("substring(pattern, 2)")).otherwise(F.col("pattern"))
    only_dirs = F.col("pattern").endswith("/")
    body = F.regexp_replace(body, "/+$", "")
    anchored = F.contains(body, F.lit("/"))
    free = F.when(anchored, "").otherwise("(?:.*/)?")
    regex = F.concat(F.lit("(?s)^"), free, as_regex(F.regexp_replace(body, "^/", "")), F.lit(r"\z"))
    rows = lines.select("repo", "dir", (F.col("at") + 1).alias("line"), "pattern", negated.alias("negated"), only_dirs.alias("only_dirs"), regex.alias("regex"), body.alias("body"))
    return rows.where("body <> '' AND regex IS NOT NULL").drop("body")


def folders_above() -> Column:
    """All folders above ``path``, the root of the repository as the empty string."""
    return F.expr("transform(sequence(0, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))")


# Of one ignore file: for each folder of the path below it, and the path itself, the last pattern that fits.
ENTRY = "array_join(slice(parts, 1, level), '/')"
BELOW = f"IF(dir = '', {ENTRY}, substring({ENTRY}, length(dir) + 2))"
FITTING = f"try_element_at(filter(rules, r -> (NOT r.only_dirs OR level < size(parts)) AND {BELOW} RLIKE r.regex), -1)"
DECISIONS = (
    "filter(transform(sequence(depth + 1, size(parts)), level -> named_struct('level', level, 'depth', depth, "
    f"'rule', {FITTING})), d -> d.rule IS NOT NULL)"
)


def ignore_coverage(files: DataFrame) -> DataFrame:
    """repo, path, ignored_by (ignore file, line and pattern, null if nothing ignores it) of every file."""
    rules = patterns(files).groupBy("repo", "dir").agg(F.array_sort(F.collect_list(F.struct("line", "pattern", "negated", "only_dirs", "regex"))).alias("rules"))  # one file's lines
    listed = files.select("repo", "path")
    near = listed.select("repo", "path", F.explode(folders_above()).alias("dir")).join(rules, ["repo", "dir"])
    near = near.withColumn("parts", F.split("path", "/")).withColumn("depth", F.expr("IF(dir = '', 0, size(split(dir, '/')))"))
    decided = near.select("repo", "path", "dir", F.inline_outer(F.expr(DECISIONS))).where("rule IS NOT NULL")
    per_level = decided.groupBy("repo", "path", "level").agg(F.max_by(F.struct("dir", "rule"), "depth").alias("d"))
    first = per_level.where("NOT d.rule.negated").groupBy("repo", "path").agg(F.min_by("d", "level").alias("d"))
    where_ = F.concat(F.when(F.col("d.dir") == "", "").otherwise(F.concat("d.dir", F.lit("/"))), F.lit(f"{IGNORE_FILE}:"), F.col("d.rule.line").cast("string"), F.lit(" "), "d.rule.pattern")
    return listed.join(first.select("repo", "path", where_.alias("ignored_by")), ["repo", "path"], "left")


def tracked_risks(files: DataFrame) -> DataFrame:
    """Files with secrets and temporary files that no ignore file covers, as findings. Samples of settings are no secrets."""
    name = F.lower(paths.file_name(F.col("path")))
    secret = name.rlike(SECRET_NAMES) & ~name.rlike(SECRET_SAMPLES)
    rule = F.when(secret, "tracked-secret-file").when(F.col("path").rlike(TEMPORARY), "tracked-temporary-file")
    rows = ignore_coverage(files).where("ignored_by IS NULL").withColumn("rule", rule).where("rule IS NOT NULL")
    none = F.lit(None)
    return as_findings(rows.select("repo", "path", "rule", none.cast("int").alias("line"), none.cast("string").alias("snippet"), none.cast("string").alias("error")))
