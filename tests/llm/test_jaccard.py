"""The shingle join against brute force, with groups of copies, chains and odd rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import jaccard_join as jj
from tessera.llm.components import connected_components


def brute(rows, width, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if i and den * i >= num * u:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                links[a] += 1
                links[b] += 1
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(50)]
    for base in range(14):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 500]))] + (passage if base % 2 else [])
        for copy in range(rng.choice([1, 2, 12])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5]) if copy else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "One  Two")]


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 3, 90), (2, 5, 80), (3, 3, 90), (4, 2, 50), (5, 3, 100)])
def test_components(spark, seed, width, num, monkeypatch):
    rows = near_copies(seed)
    if seed == 3:  # small limits: split blocks and chunked cells
        for name, value in (("BLOCK_SHINGLES", 900), ("CELL", 3), ("NAMED", 0)):
            monkeypatch.setattr(jj, name, value)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jj.jaccard_join(df, width, num, 100).collect()}
    assert got == brute(rows, width, num, 100)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jj.jaccard_join(df, 3, 90, 100).collect())
    assert got == sorted([("None", 58, "None", 0), ("None", 0, "None", 0), ("7", 58, "3", 2), ("7", 58, "3", 2), ("3", 58, "3", 2)])
    assert jj.jaccard_join(df.limit(0), 3, 90, 100).count() == 0


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(4)
    for n in (5, 80, 700, 6000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cutoff in (0, 1, max(1, n // 40), n // 20):
            b = np.unique(np.concatenate([a[cutoff:], rng.integers(0, 2**63, cutoff).astype(np.uint64)]))
            near = jj.Near([jj.counts(jj.point(x)) for x in (a, b)], np.array([len(a), len(b)]), 90, 100)
            same = len(np.intersect1d(a, b))
            links = 100 * same >= 90 * (len(a) + len(b) - same)
            assert not links or 1 in near.of(0)
            assert len(jj.Overlaps([a, b], 90, 100).linking(0, np.array([1]))) == links


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100), (2, 3)])
def test_linking_sets_share_a_key(num, den):
    rng = np.random.default_rng(num)
    for _ in range(1500):
        n = int(2 ** rng.uniform(0, 11))
        a = rng.choice(2**40, n, replace=False).astype(np.uint64) << np.uint64(24)
        drop, add = int(rng.integers(0, max(1, n // 3) + 1)), int(rng.integers(0, max(1, n // 3) + 1))
        b = np.concatenate([a[: n - drop], rng.choice(2**40, add, replace=False).astype(np.uint64) << np.uint64(24)])
        a, b = np.unique(jj.mix(a)), np.unique(jj.mix(b))
        same = len(np.intersect1d(a, b))
        if len(b) and (drop or add) and den * same >= num * (len(a) + len(b) - same) and same < max(len(a), len(b)):
            assert len(np.intersect1d(jj.keys_of(a, num, den), jj.keys_of(b, num, den)))


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(20)] + [(200, 300 + k) for k in range(30)]
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
