"""Quality rules with risk-controlled cutoffs.

Each rule is a score of a document that is high for poor text, with a fixed grid
of cutoffs. A path is a set of rules whose cutoffs are lowered together, step by step;
each set of rules is one. Labelled documents are the holdout. At each step of a path the
good documents that any of its rules would reject are counted, per stratum. A step
is admitted if a false rejection rate above `risk` would give so few of them only with a
probability (the exact binomial tail) of at most `error`, divided by the number of
paths and strata (Bonferroni), and if all steps before it are admitted (testing in
a fixed order, which needs no further correction). Of a stratum's admitted steps the
one with the best balance of poor documents rejected and good ones (which weigh
`weight` times) is taken; if none is admitted or worth it, only the base rejects there.
With a probability of at least 1 - error the rules together reject no more than `risk`
of the good documents that the base leaves, in every stratum.

The trials are to be independent, so a text counts once in its stratum, good if any
label says so.

Everything is DataFrame functions. The binomial tail is summed downwards from its
largest term, as long as terms matter; its start comes from the log-gamma series.

Defined results: null or empty text has no words and fails the base; a null
stratum is a stratum of its own; labels of unknown documents, null labels and
null doc_ids are left out of the holdout; repeated rows are judged each; with no
labels only the base rejects.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"

#: Rule -> numerator, denominator (the score is their quotient x 1000) and grid.
RULES = {
    "symbols": ("n_symbols", "word_chars", (5, 10, 20, 30, 50, 75, 100, 150, 200, 300)),
    "dup_lines": ("n_dup_lines", "n_lines", (100, 200, 300, 400, 500, 600, 700, 800, 900)),
    "repeats": ("n_repeat_words", "n_words", (25, 50, 75, 100, 150, 200, 250)),
    "long_words": ("word_chars", "n_words", (5500, 6000, 6500, 7000, 8000, 10000, 15000, 25000)),
}
WINDOW = 8
#: Steps of a path; sets of rules.
STEPS = 10
PATHS = [p for k in range(1, len(RULES) + 1) for p in combinations(RULES, k)]


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    words = named.withColumn("w", F.filter(F.split("text", SPACE), lambda x: x != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # the windows' hashes; their places in order of hash, only where some hash repeats
    h = words.withColumn("h", F.when(F.size("w") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))))
    counted = h.select(
        "doc_id",
        "stratum",
        F.xxhash64("text").alias("text_key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).alias("h"),
    )
    placed = counted.withColumn("s", F.when(F.col("h").isNotNull(), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("s")
    same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j - 1, j) | same(j, j + 1))
    at = placed.withColumn("at", F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - p)).alias("n")),
        lambda acc: acc["n"],
    )
    out = at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("h", "s", "at")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def rule_score(name: str) -> Column:
    top, bottom, _ = RULES[name]
    return F.expr(f"{top} * 1000 div greatest({bottom}, 1)")


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1, by Stirling's series seven further up."""
    z = x + 7
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    below = x
    for k in range(1, 7):
        below = below * (x + k)
    return series - F.ln(below)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p) for k below its mean, else 1."""
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, 50 + 12 * F.sqrt(n)).cast("int")  # the further ones are below the precision of a double
    ratio = lambda i: (k - i + 1) * (1 - p) / ((n - k + i) * p)
    total = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct((acc["t"] * ratio(i)).alias("t"), (acc["sum"] + acc["t"] * ratio(i)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k < n * p, F.exp(first) * total).otherwise(1.0)


def cutoff_at(rule: str, step: int) -> int:
    """The rule's cutoff at a step from 1 to STEPS, the largest first."""
    grid = RULES[rule][2]
    return grid[-(-(STEPS - step + 1) * len(grid) // STEPS) - 1]


def cutoffs(found: DataFrame, labels: DataFrame, risk: float, error: float, weight: int) -> DataFrame:
    """stratum_ and a cutoff per rule (null: the rule rejects nothing there)."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"))
    # the step from which on each rule rejects a text
    first = [(STEPS + 1 - sum((F.when(rule_score(r) >= cutoff_at(r, k), 1).otherwise(0) for k in range(1, STEPS + 1)), F.lit(0))).alias(r) for r in RULES]
    held = found.filter(~F.col("base_failed")).join(known, "doc_id").select("stratum", "text_key", "good", *first)
    once = held.groupBy("stratum", "text_key").agg(F.max("good").alias("good"), *(F.max(r).alias(r) for r in RULES))
    rows = once.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(n).alias("path"), F.least(F.col(p[0]), *(F.col(r) for r in p)).alias("step")) for n, p in enumerate(PATHS)))).alias("x"))
    binned = rows.groupBy("stratum", F.col("x.path").alias("path"), F.col("x.step").alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    strata = cut(binned.select("stratum").distinct())
    bar = error / (len(PATHS) * max(1, strata.count()))
    # every step of every path, also those at which nothing is rejected first
    grid = F.array(*(F.struct(F.lit(n).alias("p"), F.lit(k).alias("k")) for n in range(len(PATHS)) for k in range(1, STEPS + 2)))
    every = strata.select(F.col("stratum").alias("s"), F.explode(grid).alias("g")).select("s", "g.*")
    full = every.join(binned, F.col("s").eqNullSafe(F.col("stratum")) & (F.col("p") == F.col("path")) & (F.col("k") == F.col("step")), "left")
    per = Window.partitionBy("s", "p")
    up_to = per.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    counted = full.select("s", "p", "k", total("good", up_to).alias("lost"), total("bad", up_to).alias("hit"), total("good", per).alias("n")).filter(F.col("k") <= STEPS)
    passed = F.coalesce((F.col("n") > 0) & (binomial_tail(F.col("lost"), F.col("n"), risk) <= bar), F.lit(False))
    admitted = counted.withColumn("passed", F.min(passed).over(up_to)).filter("passed").withColumn("worth", F.col("hit") - weight * F.col("lost")).filter("worth > 0")
    best = admitted.groupBy("s").agg(F.max(F.struct("worth", (-F.col("p")).alias("p"), (-F.col("k")).alias("k"))).alias("x")).select("s", (-F.col("x.p")).alias("p"), (-F.col("x.k")).alias("k"))
    at = lambda r: F.coalesce(*(F.when((F.col("k") == k) & F.col("p").isin([n for n, p in enumerate(PATHS) if r in p]), cutoff_at(r, k)) for k in range(1, STEPS + 1)))
    return best.select(F.col("s").alias("stratum_"), *(at(r).alias(f"cut_{r}") for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, error: float = 0.05, weight: int = 5) -> DataFrame:
    """The features of every document, and kept: neither the base nor a rule at its stratum's cutoff rejects it."""
    found = cut(features(docs, stratum))
    by = cutoffs(found, labels, risk, error, weight)
    rejected = [F.coalesce(rule_score(r) >= F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    judged = found.join(by, F.col("stratum").eqNullSafe(F.col("stratum_")), "left")
    kept = ~F.col("base_failed")
    for r in rejected:
        kept = kept & ~r
    return judged.select(*(c for c in found.columns if c != "text_key"), kept.alias("kept"))
