"""Note matching, snapping and trees on small odd tables, against brute force."""

import random

import numpy as np

from tessera.operators import metrics as me
from tessera.operators import sections as se
from tessera.operators import tree as tr


def largest_matching(a, b, tolerance):
    partner = {}

    def augment(i, seen):
        for j, y in enumerate(b):
            if j not in seen and a[i][0] == y[0] and abs(a[i][1] - y[1]) <= tolerance:
                seen.add(j)
                if j not in partner or augment(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in range(len(a)))


def test_note_scores_are_the_largest_matching(spark):
    rng = random.Random(3)
    tracks = {f"t{k}": tuple([(rng.randint(60, 62), rng.randint(0, 120)) for _ in range(rng.randint(0, 25))] for _ in range(2)) for k in range(12)}
    tracks |= {"none": ([], [(60, 5)]), "same": ([(60, 5)] * 3, [(60, 5)] * 2)}
    frame = lambda side: spark.createDataFrame([(t, p, at) for t, x in tracks.items() for p, at in x[side]], "track string, p int, us long")
    got = {r.track: r for r in se.note_scores(frame(0), frame(1), ["track"], "us", "p", 7).collect()}
    for t, (est, ref) in tracks.items():
        if est or ref:
            m = largest_matching(est, ref, 7)
            assert (got[t].n_est, got[t].n_ref, got[t].matched) == (len(est), len(ref), m), t
            assert abs(got[t].f1 - 2 * m / (len(est) + len(ref))) < 1e-12


def test_snapping(spark):
    s = spark.createDataFrame([("a", 0, 90), ("a", 140, 90), ("a", 31, 90), ("a", 62, 90), ("b", 7, 50), ("b", 3, 50)], "track string, t0 long, duration long")
    d = spark.createDataFrame([("a", 2), ("a", 30), ("a", 88), ("b", 6)], "track string, beat long")
    got = sorted((r.track, r.t0, r.end) for r in se.snap_sections(s, d, ["track"], "t0", "duration", "beat", 1000, 5).collect())
    # 31 and 59-ish go to 30 and 88; what is left of the last one is too short; b has one downbeat and stays
    assert got == [("a", 2, 30), ("a", 30, 88), ("b", 3, 7), ("b", 7, 50)]


def test_nothing_is_lost_without_a_parent(spark):
    tree = spark.createDataFrame([("root", None), ("x", "root"), ("y", "gone"), ("z", "x")], "key string, parent string")
    leaf = spark.createDataFrame([("z", 1), ("y", 2), ("unknown", 4), ("z", 8)], "key string, v long")
    got = {(r.key, r.parent): r.v for r in tr.rollup(leaf, tree, "v", 3).collect()}
    assert got == {("z", "x"): 9, ("y", "root"): 2, ("unknown", "root"): 4, ("x", "root"): 9, ("root", None): 15}


def test_percentiles_are_exact(spark):
    rng = random.Random(5)
    rows = [("few", 3.0), ("one", 7.0), ("one", 7.0), ("null", None)] + [("ties", float(rng.choice([1, 2, 2, 2, 9]))) for _ in range(200)] + [("many", rng.lognormvariate(0, 3)) for _ in range(3000)] + [("far", x) for x in (0.0, 1e-9, 2e-9, 1e9)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b, r.c) for r in me.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.995, "c": 0.0}, buckets=64).collect()}
    for k in {k for k, v in rows if v is not None}:
        x = np.array([v for j, v in rows if j == k])
        assert np.allclose(got[k], [np.percentile(x, 50), np.percentile(x, 99.5), x.min()], rtol=1e-12), k
    assert set(got) == {k for k, v in rows if v is not None}
