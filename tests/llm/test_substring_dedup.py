"""Substring dedup against windows compared word by word, in one block and in many, with narrow sketches, nulls and repeated ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks, token_counts
from tessera.llm import substring_dedup as sd


def brute(rows, width):
    texts = [(float("inf") if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, (d, k)), (d, k))
    out = []
    for (d, w), (doc, _) in zip(texts, rows, strict=True):
        gone = {k + o for k in range(len(w) - width + 1) if (d, k) > first[tuple(w[k : k + width])] for o in range(width)}
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def rows_of(seed):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choices("a b c dé 日本 f g h i j".split(), k=rnd.randrange(5, 60))) for _ in range(12)]
    rows = [(d, rnd.choice(["", "\n", " x "]).join(rnd.choices(passages, k=rnd.randrange(6)) + [" " + str(rnd.random())])) for d in range(60)]
    rnd.shuffle(rows)
    return rows + [(None, passages[0]), (None, passages[0] + " y"), (3, passages[1] + " z " + passages[1]), (3, passages[1]), (70, None), (71, ""), (72, "one"), (73, "again " * 5_000), *[rows[0]] * 3]


def got(docs, width):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in sd.dedup(docs, width).collect()), key=str)


@pytest.mark.parametrize(("chars", "answered", "spare"), [(blocks.BLOCK_CHARS, blocks.ANSWERED, sd.SPARE), (900, 300, 1)])
def test_same_as_brute_force(spark, monkeypatch, chars, answered, spare):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", chars)
    monkeypatch.setattr(blocks, "ANSWERED", answered)
    monkeypatch.setattr(blocks, "ROW_KEYS", 4)
    monkeypatch.setattr(sd, "SPARE", spare)  # so few cells that many windows share one: what passes grows, the result does not change
    rows = rows_of(answered)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, data string, b int").repartition(3)
    for width in (20, 7, 1):
        assert got(docs, width) == brute(rows, width)


def test_empty_table_and_spans(spark):
    schema = "doc_id long, text string"
    assert got(spark.createDataFrame([], schema), 20) == []
    text = " ".join(map(str, range(30)))
    out = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in sd.dedup(spark.createDataFrame([(1, text), (2, f"x {text} y {text}"), (3, "x y z")], schema)).collect()}
    assert out == {1: [], 2: [(1, 31), (32, 62)], 3: []}


def test_estimates_are_never_too_small():
    """A block's windows that occur twice pass, whatever else counts in their cells."""
    rnd = random.Random(1)
    rows = [(d, " ".join(rnd.choices("abcdefg", k=300))) for d in range(5)]
    data, n = sd.packed(rows, 3)
    x = sd.Block(data, 3)
    assert n == len(x.start) == 5 * 298
    for bits in (8, 12, 20):
        answers = {row: [sd.merged([s for _, s in x.sketch(row, bits, 1)])[0][0]] for row in range(sd.ROWS)}
        passed = set(x.passed(answers, bits).tolist())
        _, place, often = np.unique(x.names[0], return_inverse=True, return_counts=True)
        assert set(np.flatnonzero(often[place] > 1).tolist()) <= passed


def test_rows_stay_coarse(spark, monkeypatch):
    """However small blocks are against the corpus, a block asks with at most one row for every ROW_KEYS of its keys."""
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 3_000)
    monkeypatch.setattr(blocks, "ANSWERED", 10)
    monkeypatch.setattr(blocks, "ROW_KEYS", 50)
    rnd = random.Random(2)
    docs = spark.createDataFrame([(d, " ".join(str(rnd.randrange(10**6)) for _ in range(200))) for d in range(100)], "doc_id long, text string").coalesce(1)
    made = token_counts.in_pre_tokens(docs)
    keys, count = made.agg(F.sum("n"), F.count("b")).first()
    parts = blocks.parts_of(keys, count)
    assert count > 20 and 1 < parts <= keys // count // 50 < keys // blocks.ANSWERED
    asked = [sum(1 for _ in blocks.dealt(np.sort(token_counts.hashed(token_counts.strings(*blocks.opened(r["names"])))), parts)) for r in made.collect()]
    assert sum(asked) <= keys / 50
    blocks.forget(made)
    assert blocks.parts_of(10**13, 10**6) == 10**7 // 50
    assert blocks.block_chars(1) == 3_000 and 50 * 3_000 < blocks.block_chars(100 << 40) <= blocks.MOST_CHARS


def test_blocks_stay_in_their_buckets(spark):
    """Answers are moved to the blocks: the table of blocks is read without an exchange."""
    docs = spark.createDataFrame([(d, f"some words {d}") for d in range(50)], "doc_id long, text string").repartition(5)
    made = token_counts.in_pre_tokens(docs)
    answers = spark.createDataFrame([], "kind int, b long, p long, data binary, n long")
    plan = blocks.for_blocks(made, "freqs", [answers], lambda b, got, data: iter(()), "b long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    blocks.forget(made)
