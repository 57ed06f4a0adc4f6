"""Scans, contractions and chains against their one-row-at-a-time forms, with hot keys over many slices."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scans as sc
from tessera.operators import steps, tracks
from tessera.operators import temporal as te
from tessera.operators import chains
from tessera.operators.chains import cheapest_chains


def test_running_and_affine(spark):
    rnd = random.Random(1)
    rows = [("hot" if k % 10 else "b", k, rnd.choice([None, *range(5)]), rnd.choice([0.0, 0.5, 1.0, -0.9])) for k in range(3000)]
    df = spark.createDataFrame(rows, "part string, i long, v int, a double").repartition(5)
    slice_ = F.floor(F.col("i") / 37)
    sums = {r.i: r.s for r in sc.running(df, ["part"], ["i"], "v", slice_, "s").collect()}
    levels = [{r.i: r.y for r in sc.affine(df, ["part"], ["i"], F.col("a"), F.coalesce("v", F.lit(0)), slice_, "y", 2.0, fan, deep).collect()} for fan, deep in ((4096, 1), (3, 3), (7, 0))]
    for part in ("hot", "b"):
        total, y = None, 2.0
        for p, i, v, a in rows:
            if p == part:
                total = v if total is None else total + (v or 0)
                y = a * y + (v or 0)
                assert sums[i] == total
                assert all(x[i] == pytest.approx(y, abs=1e-9) for x in levels)
    empty = df.limit(0)
    assert sc.running(empty, ["part"], ["i"], "v", slice_, "s").count() == sc.affine(empty, ["part"], ["i"], F.col("a"), F.col("v"), slice_, "y").count() == 0


def test_islands_in_slices(spark):
    rnd = random.Random(2)
    rows = [(k % 3 == 0, k, rnd.choice("aab")) for k in range(900)]
    df = spark.createDataFrame(rows, "key boolean, i int, label string")
    plain = te.merge_runs(df, ["key"], ["i"], "label", "i", "i")
    sliced = te.merge_runs(df, ["key"], ["i"], "label", "i", "i", F.floor(F.col("i") / 10))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))
    want, last = 0, None
    for key, _, label in rows:
        if key:
            want, last = want + (label != last), label
    assert plain.filter("key").count() == want


@pytest.mark.parametrize(("labels", "least", "together"), [("ab", 4, 9), ("abc", 3, 12), ("abcde", 6, 40), ("ab", 50, 10)])
def test_contraction_keeps_the_order_of_one_by_one(spark, labels, least, together):
    rnd = random.Random(len(labels) * least)
    rows = []
    for key, n in (("hot", 1500), ("x", 40), ("y", 3), ("z", 1)):
        labelled = []
        while len(labelled) < n:
            labelled += [rnd.choice(labels)] * rnd.choice([1, 1, 1, 2, 3, 7])
        rows += [(key, k, x) for k, x in enumerate(labelled[:n])]
    rows += [("even", k, "ab"[k % 2]) for k in range(60)]  # all runs of one row: each waits for the one before
    df = spark.createDataFrame(rows, "key string, i int, label string").repartition(4)
    got = {(r["key"], r["i"]): r["merged"] for r in te.min_run_merge(df, ["key"], ["i"], "label", least, F.floor(F.col("i") / 100), together).collect()}
    for key in ("hot", "x", "y", "z", "even"):
        own = [x for k, _, x in rows if k == key]
        assert [got[key, i] for i in range(len(own))] == te.absorb_short_runs(own, least), key


def test_a_long_track_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("t").alias("key"), F.col("id").alias("i"), F.chr(97 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("label"))
    labels = [r.label for r in df.orderBy("i").select("label").collect()]
    got = [r.merged for r in te.min_run_merge(df, ["key"], ["i"], "label", 5, F.floor(F.col("i") / 10_000), 5_000).orderBy("i").collect()]
    assert got == te.absorb_short_runs(labels, 5)


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_any_length(spark, seed):
    rnd = random.Random(seed)
    nodes, pieces = [], {f"p{n}": n for n in (1, 2, 3, 7, 8, 21)}
    for piece, n in pieces.items():
        for layer in range(n):
            nodes += [(piece, layer, x, rnd.randrange(3), rnd.randrange(4)) for x in range(rnd.choice([1, 3, 4]))]
    nodes += [("stuck", 0, 0, 0, 0), ("stuck", 1, 0, 0, 99)]

    def step(a, b):
        return None if b == 99 else abs(a - b) % 3

    def brute(piece):
        layers = {}
        for p, layer, x, own, v in nodes:
            if p == piece:
                layers.setdefault(layer, []).append((x, own, v))
        best = [(own, (x,), v) for x, own, v in layers[0]]
        for layer in range(1, len(layers)):
            best = [min((c + own + step(u, v), (*path, x), v) for c, path, u in best if step(u, v) is not None) for x, own, v in layers[layer] if any(step(u, v) is not None for _, _, u in best)]
        return min((c, path) for c, path, _ in best) if best else None

    df = spark.createDataFrame(nodes, "piece string, layer int, node int, own int, v int").repartition(3)
    move = lambda p, n: F.when(F.col(f"{n}v") != 99, F.abs(F.col(f"{p}v") - F.col(f"{n}v")) % 3)
    got: dict = {}
    for r in cheapest_chains(df, ["piece"], "layer", "node", "own", move, ["v"]).collect():
        got.setdefault(r.piece, {})[r.layer] = (r.node, r.cost)
    assert set(got) == set(pieces)
    for piece, n in pieces.items():
        cost, path = brute(piece)
        assert [got[piece][layer] for layer in range(n)] == [(x, cost) for x in path], piece
    assert cheapest_chains(df.limit(0), ["piece"], "layer", "node", "own", move, ["v"]).count() == 0


def written(spark, build):
    """What build gives, and how many steps it writes."""
    seen = []
    cut_ = steps.cut

    def counting(df):
        seen.append(1)
        return cut_(df)

    with pytest.MonkeyPatch.context() as m:
        for module in (chains, sc, tracks):
            m.setattr(module, "cut", counting)
        return build(), len(seen)


@pytest.mark.parametrize("together", [1, 60, 1_000_000])
def test_short_and_long_chains_are_one(spark, together):
    """Pieces worked on whole and in rounds have the same ways; whole ones take no rounds."""
    rnd = random.Random(4)
    nodes = [(piece, layer, f"n{x}", rnd.randrange(3), rnd.randrange(4)) for piece in range(12) for layer in range(piece + 1) for x in range(rnd.choice([1, 2, 4]))]
    df = spark.createDataFrame([*nodes, (None, 0, "n0", 1, 1)], "piece long, layer int, node string, own int, v int").repartition(3)
    move = lambda p, n: F.when(F.col(f"{p}v") + F.col(f"{n}v") != 6, F.abs(F.col(f"{p}v") - F.col(f"{n}v")) % 3)
    got, cuts = written(spark, lambda: cheapest_chains(df, ["piece"], "layer", "node", "own", move, ["v"], together))
    want = chains.long_chains(df, ["piece"], "layer", "node", "own", move, ["v"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert cuts == 1 or together < 1000


def test_tracks_that_fit_take_no_rounds(spark):
    """Many short tracks: merged whole, with the same labels as in rounds."""
    rnd = random.Random(9)
    df = spark.createDataFrame([(key, k, rnd.choice("ab")) for key in range(300) for k in range(rnd.randrange(1, 30))], "key int, i int, label string").repartition(3)
    got, cuts = written(spark, lambda: te.min_run_merge(df, ["key"], ["i"], "label", 3))
    want, rounds = written(spark, lambda: te.min_run_merge(df, ["key"], ["i"], "label", 3, None, 2))
    assert cuts == 1 < rounds and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
