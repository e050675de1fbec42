"""Mixing sources to target weights.

Every row gets a hash-random key. The rows of all sources, as (source, key, size), are
sorted by range over the partitions; sums per partition and source give every partition's
place in the running sum of its source. A source whose target is e times its size and r
words more is taken e times whole, and once more up to the row in which the running sum
reaches r: that row gives just the missing words. So what a source gives is its target
rounded down. Only the key of that row, one per source, goes back to the documents, so
texts are never shuffled, and the size of a source does not matter.

Targets share the sum of all sizes by weight and never pass ``most_epochs`` times the size
of the source; what is over is shared again by weight among the others. Weights repeat over
the sources in code point order, a null source comes last.

The table of sources, one narrow row each, is ordered in one task. Null and blank texts have
size 0 and are taken 0 times. Rows equal in ``doc_id`` and ``text`` have the same key; at the cut
they share the missing words evenly, rounded down. Sources without words have target 0.
Extra columns are ignored, or kept by ``mixed``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.llm.common import row_key, word_count
from corpusward.session import written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for rows of (source, size)."""
    listed = F.array(*map(F.lit, weights))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(listed, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * most_epochs)
    )
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = sources.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    # in rising order of most / weight, sources are full until the first that its share does not fill
    full = F.col("most") * F.col("weight_left") <= F.col("weight") * F.col("words_left")
    share = F.max(F.when(~full, F.col("words_left") / F.col("weight_left"))).over(everything)
    return room.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * share).alias("target"))


def source_cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target, epochs, cut_key, cut_words for a written table of (source, key, size).

    Rows with a key before ``cut_key`` are taken once more, those with that key give ``cut_words``.
    """
    sorted_rows = rows.select("source", "key", "size").repartitionByRange("source", "key")
    placed = written(sorted_rows.withColumn("part", F.spark_partition_id()), "keys")
    targets = source_targets(rows, weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    targets = written(targets, "targets")
    in_order = Window.partitionBy("source").orderBy("part")
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("start", F.sum("words").over(in_order) - F.col("words")).withColumnRenamed("source", "of")
    cut_part = targets.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("rest") > F.col("start")) & (F.col("rest") <= F.col("start") + F.col("words")))
    cut_part = cut_part.select("of", F.col("part").alias("cut_part"), "rest", "start")
    by_key = Window.partitionBy("source").orderBy("key")
    near = placed.join(cut_part, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("cut_part")))
    equal = Window.partitionBy("source", "key")
    near = near.select("of", "key", "rest", (F.col("start") + F.sum("size").over(by_key)).alias("end"), F.sum("size").over(equal).alias("words"), F.count("*").over(equal).alias("rows"))
    at_cut = near.where((F.col("rest") <= F.col("end")) & (F.col("rest") > F.col("end") - F.col("words")))
    missing = F.col("rest") - (F.col("end") - F.col("words"))
    cuts = at_cut.groupBy("of").agg(F.min("key").alias("cut_key"), F.min(F.floor(missing / F.col("rows")).cast("long")).alias("cut_words"))
    joined = targets.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("source").alias("of_source"), "source_size", "target", "epochs", "cut_key", "cut_words")


def taken() -> Column:
    """Words taken of a row with key and size, beside the cut of its source."""
    again = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words"))
    return F.col("epochs") * F.col("size") + F.coalesce(again, F.lit(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    rows = written(docs.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("key"), word_count(F.col("text")).alias("size")), "sizes")
    cuts = written(source_cuts(rows, weights, most_epochs), "cuts")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mixed table, with the columns of ``docs``: a row for each time a document is taken.

    The document at a source's cut comes once more with its first words only; ``n_chars``
    then counts what is left. Documents that the mix leaves out have no row.
    """
    held = docs.select(F.struct("*").alias("row"), "source", row_key(F.col("doc_id"), F.col("text")).alias("key"), word_count(F.col("text")).alias("size"))
    cuts = written(source_cuts(written(held.select("source", "key", "size"), "sizes"), weights, most_epochs), "cuts")
    joined = held.join(cuts, F.col("source").eqNullSafe(F.col("of_source"))).where("size > 0")
    whole = F.col("epochs") + F.when(F.col("key") < F.col("cut_key"), 1).otherwise(0)
    part = F.when((F.col("key") == F.col("cut_key")) & (F.col("cut_words") > 0), F.array("cut_words"))
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.coalesce(part, F.array().cast("array<long>")))
    rows = joined.select("row", F.explode(times).alias("words"))
    words = F.regexp_extract_all("row.text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    first = F.array_join(F.slice(words, F.lit(1), F.greatest("words", F.lit(0)).cast("int")), "")
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(first)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length(first)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
