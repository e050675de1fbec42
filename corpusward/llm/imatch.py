"""I-Match document fingerprints, on DataFrame functions alone.

Terms are runs of letters and digits of the lower-cased text. A lexicon holds the terms whose
inverse document frequency ln(N / df), over all documents, lies in a band. A fingerprint has a
part for each of several random subsets of the lexicon: the hash of the text's distinct
terms in that subset, sorted. A text without a term in the band counts all its terms as
lexicon. Subsets keep from all of the terms, which tells copies from texts with little changed, to a
small part, which still match where much has changed. The likeness of two fingerprints
is the share of equal parts among those that are not empty in both. Texts without terms are alike.

Size of the lexicon: a term in the band is in at least N / e^MOST_IDF documents, so there are at most
e^MOST_IDF times as many as a document has distinct terms on average, however many documents
there are. It becomes one constant, a table of ``SLOTS`` short lists, in which a term is found by
its hash without a join; documents are exploded into terms for the count only.

``edited`` pairs every document with the next one, by falling doc_id. The next id is found on a
narrow table: ids are sorted by range, and every partition is told the first id of the one
after it. Texts move once, and the first characters of the next document once more.

Null texts are empty: no terms, an empty fingerprint. Rows that share a doc_id are documents each, all
followed by the same id; the one that stands for that id is the one whose text is least. A null
doc_id counts as the smallest possible id. A lone id is followed by itself. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.session import written

LEAST_IDF = 0.7
MOST_IDF = 5.0
NO_ID = -(1 << 63)
SLOTS = 1 << 14
SUBSETS = ((1, 1), (1, 4), (2, 16), (8, 32), (16, 64), (16, 128), (16, 512))  # so many subsets, each with one in so many terms
KEPT = ["g" if one_in == 1 else f"{4096 // one_in:03x}" for number, one_in in SUBSETS for _ in range(number)]  # bounds of three hexadecimal digits
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text; an empty text has none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), NOT_A_TERM)), "")


def subset_mask(term: Column) -> Column:
    """Bit k is set if subset k keeps the term: the MD5 of "k:term" is below the subset's bound."""
    chance = lambda k: F.substring(F.md5(F.concat(k.cast("string"), F.lit(":"), term)), 1, 3)
    bit = lambda k: F.when(chance(k) < F.element_at(F.array(*map(F.lit, KEPT)), k + 1), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(KEPT) - 1)), F.lit(0).cast("long"), lambda mask, k: mask + bit(k))


def lexicon(texts: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """term, mask of the terms of ``texts`` (text) in the band."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("n"))
    idf = F.log(total.scalar() / F.col("df"))
    return counts.where(idf.between(least_idf, most_idf)).select("term", subset_mask(F.col("term")).alias("mask"))


def slots(words: DataFrame) -> Column:
    """The lexicon as one constant: an array of short lists of (term, mask), by hash of the term."""
    held: list[list[dict]] = [[] for _ in range(SLOTS)]
    for row in words.select(F.pmod(F.xxhash64("term"), F.lit(SLOTS)).alias("slot"), "term", "mask").orderBy("term").collect():  # bounded, see above
        held[row["slot"]].append({"term": row["term"], "mask": row["mask"]})
    return F.from_json(F.lit(json.dumps(held)), "array<array<struct<term:string,mask:bigint>>>")


def in_lexicon(found: Column, table: Column) -> Column:
    """(term, mask) of the terms that the lexicon holds, sorted by term."""

    def entry(term: Column) -> Column:
        here = F.element_at(table, (F.pmod(F.xxhash64(term), F.lit(SLOTS)) + 1).cast("int"))
        return F.filter(here, lambda e: e["term"] == term)

    return F.array_sort(F.flatten(F.transform(found, entry)))


def parts(words: Column) -> Column:
    """A hash per subset of sorted (term, mask); an empty string where the subset keeps none."""

    def part(k: Column) -> Column:
        kept = F.filter(words, lambda w: F.getbit(w["mask"], k) == 1)
        joined = F.array_join(F.transform(kept, lambda w: w["term"]), " ")
        return F.when(joined == "", "").otherwise(F.substring(F.md5(joined), 1, 8))

    return F.array_join(F.transform(F.array(*map(F.lit, range(len(KEPT)))), part), "-")


def with_fingerprint(rows: DataFrame, text: Column, table: Column, name: str) -> DataFrame:
    """``rows`` with the fingerprint of ``text`` as column ``name``, step by step so that each is computed once."""
    own = lambda t: F.struct(t.alias("term"), subset_mask(t).alias("mask"))
    rows = rows.withColumn("_terms", terms(text))
    rows = rows.withColumn("_words", in_lexicon(F.col("_terms"), table))
    rows = rows.withColumn("_words", F.when(F.size("_words") > 0, F.col("_words")).otherwise(F.array_sort(F.transform("_terms", own))))
    return rows.withColumn(name, parts(F.col("_words"))).drop("_terms", "_words")


def likeness(left: Column, right: Column) -> Column:
    pairs = F.arrays_zip(F.split(left, "-").alias("l"), F.split(right, "-").alias("r"))
    filled = F.size(F.filter(pairs, lambda p: (p["l"] != "") | (p["r"] != "")))
    equal = F.size(F.filter(pairs, lambda p: (p["l"] != "") & (p["l"] == p["r"])))
    return F.when(filled == 0, 1.0).otherwise(equal / filled)


def followers(ids: DataFrame) -> DataFrame:
    """id, next_id for every distinct ``id``, falling; after the last comes the first."""
    placed = ids.groupBy("id").agg(F.max("chars").alias("chars")).repartitionByRange(F.desc("id")).withColumn("part", F.spark_partition_id())
    placed = written(placed, "ids")
    edges = placed.groupBy("part").agg(F.max("id").alias("first"))
    order = Window.orderBy("part")
    edges = edges.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    within = Window.partitionBy("part").orderBy(F.desc("id"))
    return placed.withColumn("inner", F.lead("id").over(within)).join(edges, "part").select("id", "chars", F.coalesce("inner", "after").alias("next_id"))


def edited(docs: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = slots(lexicon(own.select("text"), least_idf, most_idf))
    next_of = followers(own.select("id", F.length("text").alias("chars")))
    # what an id has to give: its first characters, to the id before it
    wanted = next_of.select(F.col("next_id").alias("id"), F.col("id").alias("for_id"), F.floor(F.col("chars") / 2).cast("int").alias("wanted"))
    marked = with_fingerprint(own, F.col("text"), table, "fingerprint")
    given = marked.join(wanted, "id").select(F.col("for_id").alias("id"), F.struct(F.substring("text", F.lit(1), F.col("wanted")).alias("start"), F.col("fingerprint").alias("print")).alias("next"))
    given = given.groupBy("id").agg(F.min("next").alias("next"))
    chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next.start", F.lit(1), half))
    changed = marked.join(given, "id").select("id", "fingerprint", F.col("next.print").alias("next_print"), chars.cast("long").alias("n_chars"), text.alias("changed"))
    done = with_fingerprint(changed, F.col("changed"), table, "edited_fingerprint")
    return done.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
