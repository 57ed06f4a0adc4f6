"""Scores against a brute-force model that keeps every n-gram with two occurrences."""

import math
import random
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tessera.llm import blocks
from tessera.llm import lm_scores as lm


def brute(rows):
    toks = {d: [b" ", *lm.tokens(t or "")] for d, t in rows}
    train = [w for d, w in toks.items() if crc32(str(d).encode()) % 7 != 2]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in train:
        c1.update(w[1:])
        c2.update(zip(w, w[1:], strict=False))
        c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    kept2, kept3 = ({g: c for g, c in grams.items() if c > 1} for grams in (c2, c3))
    left2, left3 = Counter(), Counter()
    for g, c in kept2.items():
        left2[g[0]] += c - 0.75
    for g, c in kept3.items():
        left3[g[:2]] += c - 0.75

    def p2(g):
        seen = (kept2[g] - 0.75) / c1[g[0]] if g in kept2 else 0
        return seen + (1 - left2[g[0]] / max(c1[g[0]], 1)) * p1(g[1])

    def p3(g):
        seen = (kept3[g] - 0.75) / c2[g[:2]] if g in kept3 else 0
        return seen + (1 - left3[g[:2]] / max(c2[g[:2]], 1)) * p2(g[1:])

    words = [*c1, b"never seen"]
    for context in [*list(kept2)[:20], (b"x", b"y"), (words[0], b"y")]:  # probabilities add up to one after each context
        assert abs(sum(p3((*context, w)) for w in words) - 1) < 1e-9
    out = {}
    for d, w in toks.items():
        score = math.log10(p2((w[0], w[1]))) + sum(math.log10(p3(g)) for g in zip(w, w[1:], w[2:], strict=False))
        out[d] = (len(w) - 1, sum(x in c1 for x in w[1:]), n, pytest.approx(sum(math.log10(p1(x)) for x in w[1:]), abs=1e-6), pytest.approx(score, abs=1e-6))
    return out


@pytest.mark.parametrize(("n_docs", "length", "block", "answered"), [(60, 60, 300, 50), (120, 2000, 50_000, 20_000), (60, 60, 4_000_000, 2_000_000)])
def test_every_repeated_gram_counts(spark, monkeypatch, n_docs, length, block, answered):
    """The same model however the corpus is cut into blocks and its keys into parts."""
    monkeypatch.setattr(blocks, "BLOCK_CHARS", block)
    monkeypatch.setattr(blocks, "ANSWERED", answered)
    monkeypatch.setattr(blocks, "ROW_KEYS", 2 if answered < 1000 else blocks.ROW_KEYS)
    monkeypatch.setattr(lm, "STRETCH", 7 if answered < 1000 else lm.STRETCH)
    rng = random.Random(5)
    rows = [(k, " ".join("w%d" % (rng.paretovariate(0.7) % 3000) for _ in range(rng.randint(0, length)))) for k in range(n_docs)]
    rows += [(1000, "two words seen twice"), (1001, "and two words seen twice"), (1002, "Two words seen once"), (1003, None)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, data string")
    want = brute(rows)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs).collect()}
    assert got == want


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None), (4, "a b")], "doc_id long, text string")
    got = lm.score(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("4", 3), ("None", 1), ("None", 3), ("None", 3)]
    assert lm.score(docs.limit(0)).collect() == []
    held = [d for d in range(60) if crc32(str(d).encode()) % 7 == 2]
    alone = lm.score(docs.filter("false").union(spark.createDataFrame([(held[0], "x y")], "doc_id long, text string"))).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in alone] == [(True, 0, 0, 0.0)]


def test_blocks_leave_nothing_in_a_worker():
    """Words of blocks gone by aren't held, and a block in work takes a bounded number of bytes for each token."""
    rng = np.random.default_rng(3)
    block = lambda k: [(d, " ".join(f"w{k}_{x}" for x in rng.zipf(1.3, 2000) % 20_000), False) for d in range(20)]
    data = lm.packed(block(0))[0]
    tracemalloc.start()
    for k in range(1, 9):
        lm.packed(block(k))
    assert tracemalloc.get_traced_memory()[0] < 300_000
    x = lm.Block(data)
    assert sum(v.nbytes for v in vars(x).values() if isinstance(v, np.ndarray)) < 60 * len(x.ids)
    tracemalloc.stop()
