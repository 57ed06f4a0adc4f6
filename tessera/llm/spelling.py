"""Spelling variants: words that one letter more, less or other tells apart, by anagram hashing.

A word's integer key is the sum of its letters' code points to the fifth power, so
anagrams share a key and one letter more, less or other changes it by a letter's value
or by the difference of two. Each word meets others under its own key and under each
value that its key has when one of its letters is taken away: an added letter's word
has the other's key there, and of exchanged letters both words have the same value.
Where words meet, the order of their letters decides: what is left of the two, the
letter taken out at its place, must be equal, and for an exchange the place too.

Words of equal rest and place differ in that letter alone, so they are at most as many
as there are letters, and a meeting has at most that for each place of one word more:
Spark gathers these bounded lists and nothing larger, however many words a key has.
From each the number of near words and the best one go back to its members; no pairs
are written.

Defined results: null or empty text has no words; a null doc_id is the text '' for
the slips' hash; repeated rows count each; an empty table gives no rows; only the
columns doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, drop, keep_docs

#: Letters are A-Z, a-z and U+00C0 to U+00FF, which Latin-1 has as single bytes; A-Z in lower case, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
#: Distinct words that a task counts before it passes them on.
HELD = 600_000


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text, in Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def slipped(word: bytes, doc: int, every: int) -> bytes:
    """word, less one letter where `every` divides the hash of the document (doc: that of '<doc_id>:') and the word."""
    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), doc)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word and n of the words of at least `shortest` letters that occur `least` times."""

    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    def run(it):
        n: Counter = Counter()
        for b in batches(it, 4 << 20):
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, k in Counter(runs(text)).items():
                    w = slipped(word, doc, every)
                    if len(w) >= shortest:
                        n[w] += k
                if len(n) > HELD:
                    yield rows(n)
                    n = Counter()
        yield rows(n)

    return keep_docs(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def value(letters: Column) -> Column:
    """The key of the letters of an array: the sum of their code points to the fifth power."""

    def fifth(c: Column) -> Column:
        x = F.ascii(c).cast("long")
        return x * x * x * x * x

    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + fifth(c))


def meetings(words: DataFrame) -> DataFrame:
    """key, rest, place, new, word, order: a word under its own key (place -1) and, for each of its places, under the key that it has without
    the letter there, with what is left; new: no earlier place leaves the same. order: (-n, word), smallest for the best word."""
    letters = words.withColumn("c", F.split("word", "")).withColumn("key", value(F.col("c")))

    def without(i: Column) -> Column:
        c = F.get("c", i)
        rest = F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word")))
        return F.struct((F.col("key") - value(F.array(c))).alias("key"), rest.alias("rest"), i.alias("place"), ((i == 0) | (c != F.get("c", i - 1))).alias("new"))

    own = F.array(F.struct(F.col("key"), F.col("word").alias("rest"), F.lit(-1).alias("place"), F.lit(True).alias("new")))
    places = F.transform(F.sequence(F.lit(0), F.length("word") - 1), without)
    return letters.select("word", "n", F.explode(F.concat(own, places)).alias("m")).select("m.*", "word", F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("order"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near and best (the near word of largest n, ties: the smallest) of all words (word, n)."""
    together = meetings(words).groupBy("key", "rest").agg(F.collect_list(F.struct("place", "new", "order")).alias("all")).filter(F.size("all") > 1)
    each = together.select(F.array_sort("all").alias("all"), F.explode("all").alias("me"))
    # an exchange: another word at the same place; one letter more or less: one of the two is what is left of the other
    whole = F.col("me.place") == -1
    is_near = lambda x: F.when(whole, (x["place"] >= 0) & x["new"]).otherwise((x["place"] == F.col("me.place")) & (x["order"] != F.col("me.order")) | ((x["place"] == -1) & F.col("me.new")))
    near = each.select(F.col("me.order.word").alias("word"), F.filter("all", is_near).alias("near")).filter(F.size("near") > 0)
    found = near.select("word", F.lit(0).cast("long").alias("n"), F.size("near").cast("long").alias("k"), F.array_min(F.transform("near", lambda x: x["order"])).alias("best"))
    every = found.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("k"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best")))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form (word, form): forms are followed two, four, eight, ... at a time. Each has twice the occurrences
    of the word before, so chains have at most 62 steps and rounds are at most six."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        before, now = now, cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        drop(before)


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its form is the near word of most occurrences, if it has `times` the word's."""
    near = cut(near_words(cut(word_counts(docs, shortest, least, every))))
    known = -F.col("best.less") >= times * F.col("n")
    formed = cut(near.select("word", F.when(known, F.col("best.word")).alias("form"), "n", "n_near", F.when(known, -F.col("best.less")).alias("form_n")))
    return formed.join(roots(formed.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
