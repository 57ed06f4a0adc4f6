"""Matched notes, pooled bands, frames of spans and fallbacks against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bands as bd
from tessera.operators import judge as ju
from tessera.operators import metrics as me
from tessera.operators import music as mu
from tessera.operators import repair as rp
from tessera.operators import sections as se
from tessera.operators import temporal as te


def most(links, i, used):
    """The size of a largest matching, by trying everything."""
    if i == len(links):
        return 0
    return max([most(links, i + 1, used), *(1 + most(links, i + 1, used | {j}) for j in links[i] if j not in used)])


def test_largest_matching_of_notes(spark):
    rnd = random.Random(8)
    ref, est = [], []
    for track in range(40):
        for rows in (ref, est):
            rows += [(f"t{track}", rnd.randrange(0, 200), 60 + rnd.randrange(0, 150) / 100) for _ in range(rnd.randrange(3, 8))]
    ref += [("none", 5, 60.0), (None, 5, None)]
    est += [("chain", 5, 60.0)]
    frame = lambda rows: spark.createDataFrame(rows, "track string, t long, pitch double").repartition(3)
    pairs = se.note_pairs(frame(est), frame(ref), ["track"], "t", "pitch", 50, 0.5, 100)
    rows = pairs.collect()
    got = {r.track: r for r in se.scored(pairs, frame(est), frame(ref), ["track"]).collect()}
    greedy = 0
    for track in {t for t, *_ in ref + est if t}:
        a, b = ([(t, p) for x, t, p in rows_ if x == track] for rows_ in (ref, est))
        links = [[j for j, y in enumerate(b) if abs(x[0] - y[0]) <= 50 and abs(x[1] - y[1]) <= 0.5] for x in a]
        own = [(r.ref_t, r.ref_pitch, r.est_t, r.est_pitch) for r in rows if r.track == track]
        assert len(own) == most(links, 0, frozenset()) == got[track].matched, track
        for used, all_ in (([x[:2] for x in own], a), ([x[2:] for x in own], b)):
            left = list(all_)
            for note in used:
                left.remove(note)  # each note once
        assert all(abs(w - y) <= 50 and abs(x - z) <= 0.5 for w, x, y, z in own)
        taken = set()
        for row in links:
            taken |= {next(iter(j for j in row if j not in taken), None)} - {None}
        greedy += len(taken)
    assert greedy < len(rows)  # taking the first partner that is free loses pairs
    assert got["none"].recall == 0 and got["chain"].precision == 0 and got["chain"].n_ref == 0


def test_bands_keep_the_energy(spark):
    rng = np.random.default_rng(5)
    edges = np.cumsum(rng.uniform(0.1, 40, 60)) + 30
    rows = [(f, float(a), float(b), float(e)) for f in range(3) for a, b, e in zip(edges[:-1], edges[1:], rng.uniform(0, 5, 59), strict=True)]
    df = spark.createDataFrame([*rows, (0, 5.0, 5.0, 9.0)], "frame int, low double, high double, energy double")
    for per in (12, 24, 7):
        pooled = bd.pooled(df, ["frame"], "low", "high", "energy", 20.0, per)
        for r in pooled.groupBy("frame").agg(F.sum("energy").alias("e")).collect():
            assert r.e == pytest.approx(sum(e for f, *_, e in rows if f == r.frame))
        one = {r.band: r.energy for r in pooled.filter("frame = 1").collect()}
        for band in one:
            b0, b1 = 20 * 2 ** ((band - 0.5) / per), 20 * 2 ** ((band + 0.5) / per)
            assert one[band] == pytest.approx(sum(e * max(0, min(b, b1) - max(a, b0)) / (b - a) for f, a, b, e in rows if f == 1))
    assert bd.pooled(df.limit(0), ["frame"], "low", "high", "energy", 20.0).count() == 0


def test_chroma_statistics(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (40, 12)) ** 4
    x[7] = 0
    df = spark.createDataFrame([("s", t, p, float(x[t, p])) for t in range(40) for p in range(12) if t != 7], "track string, frame long, pitch_class long, energy double")
    share = x / np.maximum(x.sum(1, keepdims=True), 1e-10)
    steps = sum(0.25 * (share > limit) for limit in bd.THRESHOLDS)
    w = np.hanning(9 + 2)[1:-1]
    smooth = np.stack([np.convolve(steps[:, p], w / w.sum(), mode="same") for p in range(12)], 1)[::5]
    want = smooth / np.maximum(np.sqrt((smooth**2).sum(1, keepdims=True)), 1e-10)
    got = np.zeros_like(want)
    for r in bd.chroma_statistics(df, ["track"], "frame", 4, 5).collect():
        got[r.frame // 5, r.pitch_class] = r.value
    assert np.allclose(got, want)


def test_frames_of_spans_and_middles(spark):
    spans = spark.createDataFrame([("a", 0, 35), ("b", 1, 40), ("c", 5, 44), ("d", 10, 41)], "k string, t0 long, t1 long")
    assert {(r.k, r.frame0, r.frame1) for r in te.frame_spans(spans, "t0", "t1", 10).collect()} == {("a", 0, 4), ("c", 1, 5), ("d", 1, 5)}  # b has three frames
    at, there = te.frame_at(F.col("t"), 10, F.lit(5))
    got = spark.createDataFrame([(-11,), (0,), (1,), (40,), (41,), (None,)], "t long").select(at.alias("k"), there.alias("there")).collect()
    assert [(r.k, r.there) for r in got] == [(0, False), (0, True), (1, True), (4, True), (4, False), (0, False)]
    rows = spark.createDataFrame([("long", t) for t in range(100)] + [("short", t) for t in range(5)], "k string, t long")
    kept = me.middle(rows, ["k"], "t", 20).collect()
    assert sorted(r.t for r in kept if r.k == "long") == list(range(39, 59)) and sum(r.k == "short" for r in kept) == 5
    silent = spark.createDataFrame([(0.0,), (1.0,)], "e double")
    half = F.lit(0.9)
    score, grade = ju.difficulty(half, half, half, half, half, F.col("e"))
    assert [tuple(r) for r in silent.select(score, grade).collect()] == [(0.0, "easy"), (0.9, "very hard")]


def test_a_part_without_notes_falls_gently(spark):
    shares = spark.createDataFrame([("a", 1, 0.75), ("a", 2, 0.25)], "part string, h int, share double")
    got = me.with_fallback(shares, spark.createDataFrame([("a",), ("b",)], "part string"), ["part"], "h").collect()
    assert {(r.h, r.share) for r in got if r.part == "a"} == {(1, 0.75), (2, 0.25)}
    b = sorted((r.h, r.share) for r in got if r.part == "b")
    assert len(b) == 16 and sum(s for _, s in b) == pytest.approx(1) and b[0][1] / b[3][1] == pytest.approx(4**1.2)


def test_series_that_do_not_vary(spark):
    """Two days of one value: no correlation, and no division by zero."""
    rows = [("t", p, d, v) for p, values in (("flat", (2.0, 2.0, 2.0)), ("a", (1.0, 2.0, 4.0)), ("b", (3.0, 2.0, 1.5))) for d, v in enumerate(values)] + [("u", "flat", 0, 1.0), ("u", "a", 0, 5.0)]
    got = {(r.track, r.part): r.likeness for r in me.best_sibling(spark.createDataFrame(rows, "track string, part string, day int, v double"), ["track"], "part", "day", "v").collect()}
    r = round(abs(np.corrcoef([1, 2, 4], [3, 2, 1.5])[0, 1]), 6)
    assert got == {("t", "flat"): 0.0, ("t", "a"): r, ("t", "b"): r, ("u", "flat"): 0.0, ("u", "a"): 0.0}
    profile = spark.createDataFrame([("flat", d, 1.0) for d in range(12)], "part string, degree int, v double")
    assert [x.part for x in mu.detect_key(profile, ["part"], "degree", "v").collect()] == ["flat"]


def test_whole_tracks_match_as_many_as_parted_ones(spark):
    rnd = random.Random(2)
    notes = lambda: spark.createDataFrame([(t, rnd.randrange(0, 3000), 60 + rnd.randrange(0, 300) / 100) for t in range(30) for _ in range(rnd.randrange(0, 40))], "track int, t long, pitch double").repartition(3).localCheckpoint()
    est, ref = notes(), notes()
    count = lambda together: {r.track: r["count"] for r in se.note_pairs(est, ref, ["track"], "t", "pitch", 50, 0.5, 100, together).groupBy("track").count().collect()}
    assert count(1) == count(40) == count(100_000) != {}


def test_fits_and_voices_go_over_their_rows_once(spark):
    """No join of a table with itself, and no more rows in a window than came in."""
    x = spark.createDataFrame([(1, f, p, float(10 * p + f), 99.0, True) for f in range(3) for p in range(4)], "note int, frame int, partial int, v double, parent double, clean boolean")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(rp.harmonic_fit(x, ["note"], ["frame"], "partial", "v", "parent", "clean"))
    chords = spark.createDataFrame([(1, 0, 0, 70, 65, 60, 50), (1, 0, 1, 72, 65, 60, 45)], "piece int, o int, n int, s int, a int, t int, b int")
    done = mu.singability(chords, ["piece"], ["o", "n"])
    text = plan(done)
    assert text.index("Generate") < text.index("Window") and text.count("Window [") == 1
    assert {r.voice: (r.step_pct, r.leap_pct, r.static_pct) for r in done.collect()} == {"s": (100.0, 0.0, 0.0), "a": (0.0, 0.0, 100.0), "t": (0.0, 0.0, 100.0), "b": (100.0 * 0, 0.0, 0.0)}
