"""The guarantee of the quality rules' cutoffs, on simulated holdouts."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality_rules as qr


def simulated(spark, rng, strata, good, bad):
    """Features of documents whose symbols decide: a good document is at step k or before with probability 0.012 k, a bad one mostly at 1."""
    rows = []
    for s in range(strata):
        for k in range(good + bad):
            step = 1 + int(rng.random() / 0.012) if k < good else 1 + int(rng.integers(0, 3))
            symbols = qr.cutoff_at("symbols", step) if step <= qr.STEPS else 0
            rows.append((len(rows), f"s{s}", len(rows), 1000, 1000, symbols, 100, 0, 0, False, int(k < good)))
    df = spark.createDataFrame(rows, "doc_id long, stratum string, text_key long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_false_rejections_stay_within_the_risk(spark):
    rng = np.random.default_rng(1)
    found, labels = simulated(spark, rng, 20, 800, 80)
    got = {r.stratum_: r.cut_symbols for r in qr.cutoffs(found, labels, 0.05, 0.05, 1).collect()}
    steps = {qr.cutoff_at("symbols", k): k for k in range(qr.STEPS, 0, -1)}
    true = [0.012 * steps[c] for c in got.values() if c]
    assert len(true) >= 10  # it has power
    assert all(t <= 0.05 for t in true)  # probability of failing: 5 % over all strata together
    # a text counts once, however often its rows and labels are repeated: no power from copies
    few = found.filter(F.col("doc_id") < 60)
    copies = few
    for _ in range(3):
        copies = copies.union(copies)
    assert qr.cutoffs(copies, labels.union(labels), 0.05, 0.05, 1).count() == 0
    again = few.select((F.col("doc_id") + 10_000_000).alias("doc_id"), *few.columns[1:])
    named = labels.union(labels.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "quality"))
    assert qr.cutoffs(few.union(again), named, 0.05, 0.05, 1).count() == 0
