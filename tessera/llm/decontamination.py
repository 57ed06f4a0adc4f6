"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into windows of `span` words (a shorter item is one window).
The words of the test items are counted in the training texts; each window is
looked up from its two rarest words. The index holds the postings (word,
document, position) of all those words, each with the words around it. The
postings of a window's words, less the word's place in the item, are diagonals
of the document; where the lists of both words meet on a diagonal, the window is
compared with the words around the posting. A window with a word that no
document has can't occur and is not looked up.

Only DataFrame functions are used. Words of the test items are broadcast to the
scan of the documents if they are few (counted first); else the words are
shuffled, of which Spark splits the frequent ones.

Defined results: null or empty text has no words; items with null id or no words
are left out; equal items are one; rows that share a doc_id (null too) are judged each
by its own text; rows that repeat both are equal; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: What separates words; upper-case letters are kept until words are compared.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Test words that a broadcast may hold.
FEW = 200_000


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(text: str) -> Column:
    """Words, perhaps with an empty one at either end."""
    return F.split(F.coalesce(F.col(text), F.lit("")), GAP)


def row_key() -> Column:
    """With the doc_id the name of a row: rows that share both have the same text."""
    return F.xxhash64("text").alias("row")


def count_words(words: Column) -> Column:
    n = F.size(words)
    return (n - (F.element_at(words, 1) == "").cast("int") - ((n > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def match_key(word: Column) -> Column:
    """Equal for words that are equal once A-Z are lower-cased."""
    return F.lower(word)


def windows(items: DataFrame, span: int) -> DataFrame:
    """item, item_id, first (the window's place in the item), words (of the window, lower-cased)."""
    one = items.filter(F.col("item_id").isNotNull()).select("item_id", F.filter(F.split(lowered(F.coalesce("text", F.lit(""))), GAP), lambda x: x != "").alias("w"))
    one = one.filter(F.size("w") > 0).distinct().withColumn("item", F.xxhash64("item_id", "w"))
    width = F.least(F.size("w"), F.lit(span))
    return one.select("item", "item_id", "w", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("first")).select("item", "item_id", "first", F.expr("slice(w, first + 1, width)").alias("words"))


def few(words: DataFrame) -> DataFrame:
    """The test words, to be broadcast if there are few."""
    return F.broadcast(words) if words.count() <= FEW else words


def test_words(docs: DataFrame, win: DataFrame, span: int) -> DataFrame:
    """Windows with their two rarest words: term1, at1 and term2, at2 (null: no other place), by frequency in docs."""
    each = win.select("item", "first", "item_id", "words", F.posexplode("words").alias("at", "word")).withColumn("term", match_key(F.col("word")))
    vocabulary = cut(each.select("term").distinct())
    seen = docs.select(F.explode(parts("text")).alias("word")).select(match_key(F.col("word")).alias("term")).join(few(vocabulary), "term")
    counts = seen.groupBy("term").agg(F.count("*").alias("df"))
    ranked = Window.partitionBy("item", "first").orderBy("df", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = each.join(counts, "term").withColumn("order", F.row_number().over(Window.partitionBy("item", "first").orderBy("df", "at"))).withColumn("known", F.count("*").over(ranked))
    pick = lambda c, k: F.max(F.when(F.col("order") == k, F.col(c)))
    found = known.filter(F.col("known") == F.size("words")).groupBy("item", "first").agg(pick("term", 1).alias("term1"), pick("at", 1).alias("at1"), pick("term", 2).alias("term2"), pick("at", 2).alias("at2"))
    return cut(win.join(found, ["item", "first"]))


def postings(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """term, doc_id, row, pos of every occurrence of the terms (term, full); where full, also near (the words
    around it, joined by spaces) and lead (how many of those come before it)."""
    at = docs.select("doc_id", row_key(), parts("text").alias("w")).select("doc_id", "row", "w", F.posexplode("w").alias("pos", "word"))
    hits = at.select("doc_id", "row", "w", "pos", match_key(F.col("word")).alias("term")).join(few(terms), "term")
    lead = F.least(F.col("pos"), F.lit(around))
    return hits.select(
        "term", F.col("doc_id").cast("long").alias("doc_id"), "row", "pos", lead.alias("lead"),
        F.when(F.col("full"), F.array_join(F.slice("w", F.col("pos") - lead + 1, lead + around + 1), " ")).alias("near"),
    )


def build_index(docs: DataFrame, win: DataFrame, span: int, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The windows with their rarest words, and the stored postings of those words."""
    looked = test_words(docs, win, span)
    terms = looked.select(F.col("term1").alias("term"), F.lit(True).alias("full")).union(looked.filter("term2 is not null").select("term2", F.lit(False))).groupBy("term").agg(F.max("full").alias("full"))
    return looked, cut(postings(docs, cut(terms), span - 1 + slop))


def phrase_matches(looked: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, row, start, width, item_id of every window that a document has word for word."""
    places = looked.select("item", F.explode(F.array(F.struct(F.col("term1").alias("term"), (F.col("first") + F.col("at1")).alias("p")), F.struct(F.col("term2").alias("term"), (F.col("first") + F.col("at2")).alias("p")))).alias("x")).select("item", "x.term", "x.p").filter("term is not null").distinct()
    alone = looked.groupBy("item").agg(F.max(F.col("term2").isNull()).alias("alone"))
    on = index.join(places, "term").select("doc_id", "row", "item", (F.col("pos") - F.col("p")).alias("diagonal"), "p", "near", "lead")
    # a diagonal's postings are at most as many as the item's words
    met = on.groupBy("doc_id", "row", "item", "diagonal").agg(F.collect_set("p").alias("ps"), F.collect_set(F.when(F.col("near").isNotNull(), F.struct("p", "near", "lead"))).alias("full"))
    met = met.join(alone, "item").filter((F.size("ps") > 1) | F.col("alone")).select("doc_id", "row", "item", "diagonal", "ps", F.explode("full").alias("x"))
    keyed = looked.select("item", "item_id", "first", "words", (F.col("first") + F.col("at1")).alias("p1"), (F.col("first") + F.col("at2")).alias("p2"))
    both = met.select("doc_id", "row", "item", "diagonal", "ps", F.col("x.p").alias("p1"), F.col("x.near").alias("near"), F.col("x.lead").alias("lead")).join(keyed, ["item", "p1"]).filter(F.col("p2").isNull() | F.array_contains("ps", F.col("p2")))
    begin = F.col("lead") - (F.col("p1") - F.col("first")) + 1
    here = F.when(begin > 0, F.slice(F.split("near", " "), F.when(begin > 0, begin).otherwise(1), F.size("words")))
    return both.filter(lowered(F.array_join(here, " ")) == F.array_join("words", " ")).select("doc_id", "row", (F.col("diagonal") + F.col("first")).alias("start"), F.size("words").alias("width"), "item_id")


def proximity_matches(looked: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """doc_id, row, pos (of the window's rarest word), item_id, first: documents that have all words of a
    window, each as often as it, in any order, within its length and `slop` words more. The index must be built with that slop."""
    on = index.filter(F.col("near").isNotNull()).join(looked, index["term"] == looked["term1"]).withColumn("n", F.split(lowered(F.col("near")), " "))
    on = on.filter(F.size(F.array_except("words", "n")) == 0)
    reach = F.size("words") + slop
    starts = F.sequence(F.greatest(F.lit(1), F.col("lead") + 2 - reach), F.greatest(F.lit(1), F.least(F.col("lead") + 1, F.size("n"))))
    often = lambda words, x: F.size(F.filter(words, lambda y: y == x))
    all_in = lambda part: (F.size(F.array_except("words", part)) == 0) & F.forall(F.array_distinct("words"), lambda x: often(part, x) >= often(F.col("words"), x))
    within = F.exists(starts, lambda i: all_in(F.slice("n", i, reach)))
    return on.filter(within).select("doc_id", "row", "pos", "item_id", "first").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, slop: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (exact phrases) and n_near_items (items of
    which a window's words all stand within its length and `slop` words more, in any order) of every document."""
    looked, index = build_index(docs, windows(items, span), span, slop)
    found = phrase_matches(looked, index).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end"))).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n")),
        lambda acc: acc["n"],
    )
    zero = F.lit(0).cast("long")
    hits = found.select("doc_id", "row", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join(F.array_sort("ids"), ",").alias("ids"), zero.alias("n_near_items"))
    near = proximity_matches(looked, index, slop).select("doc_id", "row", "item_id").distinct().groupBy("doc_id", "row").agg(F.count("*").alias("n_near_items"))
    near = near.select("doc_id", "row", zero.alias("n_hit"), zero.alias("n_items"), F.lit(None).cast("string").alias("ids"), "n_near_items")
    both = hits.union(near).groupBy(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).agg(*(F.max(c).alias(c) for c in ("n_hit", "n_items", "ids", "n_near_items")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), parts("text").alias("w")).select("doc_id", "row", count_words(F.col("w")).alias("n_words"))
    return sized.join(both, (F.col("row") == F.col("hit_row")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near_items", zero).alias("n_near_items")
    )
