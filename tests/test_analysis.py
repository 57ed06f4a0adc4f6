"""The whole analysis of recordings made of known bars and sections."""

import numpy as np
import pytest

from tessera.operators import kernels as k
from tessera.operators import spectral as sp
from tessera.plans import analysis as an
from tessera.plans.analysis import analyze
from tessera.sources import audio as au

SR = 8000


def song(bars=24, bpm=120):
    """Kicks on every fourth beat, ticks on all, and two kinds of sections of eight bars, in C and with other chords and louder."""
    beat = 60 / bpm
    n = int(SR * beat * 4 * bars)
    t, x = np.arange(n) / SR, np.zeros(n)
    kick = 0.9 * np.sin(2 * np.pi * 70 * np.arange(1200) / SR) * np.exp(-np.arange(1200) / 300)
    tick = k.tick(SR, 2000, level=0.5)
    for b in range(bars * 4):
        at = int(b * beat * SR)
        sound = kick if b % 4 == 0 else tick
        x[at : at + len(sound)] += sound[: n - at]
    chords = [(261.63, 329.63, 392.0), (261.63, 349.23, 440.0)]
    for bar in range(bars):
        a, z = int(bar * 4 * beat * SR), int((bar + 1) * 4 * beat * SR)
        loud = 0.25 if (bar // 8) % 2 else 0.08
        x[a:z] += loud * sum(np.sin(2 * np.pi * f * t[a:z]) for f in chords[(bar // 8) % 2])
    return x


def frame(spark, tracks):
    return spark.createDataFrame([(name, "mix", 0, 0, 0.0, SR, [float(v) for v in np.float32(x)]) for name, x in tracks.items()], au.AUDIO)


def test_analysis(spark):
    x = song()
    trained = spark.createDataFrame([("b", [0.0, 0.5, 1.0, 1.5, 2.0], [0.0, 1.5], [(0.0, 9.0, "verse", 1)]), ("a", [1.0], [1.0], [])], "track_id string, beats array<double>, downbeats array<double>, sections array<struct<start: double, end: double, label: string, ordinal: int>>")
    got = {r.track_id: r for r in analyze(frame(spark, {"a": x, "b": x[: SR * 9], "silent": np.zeros(SR * 3)}), trained).collect()}
    a = got["a"]
    assert a.bpm == pytest.approx(120, rel=0.06) and a.beats_per_bar == 4 and a.backend == "own"
    assert (a.key, a.mode) in {(0, "major"), (5, "major"), (9, "minor")}
    near = [min(abs(t % 2.0), 2.0 - t % 2.0) for t in a.downbeats]
    assert np.median(near) < 0.12
    assert a.sections[-1].end == pytest.approx(a.duration, abs=1e-3) and all(s.end - s.start > 1 for s in a.sections)
    assert all(p.end == q.start for p, q in zip(a.sections, a.sections[1:], strict=False))
    b = got["b"]
    assert b.backend == "trained" and b.beats_per_bar == 3 and b.sections[0].label == "verse" and b.downbeats == [0.0, 1.5]
    silent = got["silent"]
    assert (silent.key, silent.mode, silent.key_confidence, silent.beats_per_bar) == (0, "major", 0.0, 4)


def test_moved_tables(spark):
    beats = [0.0, 0.5, 1.02, 1.5, 2.0, 2.5]
    row = ("t", 119.0, 4, 7, "major", 0.9, "9B", 3.0, beats, beats[::4], [(0.0, 1.02, "verse", 1), (1.02, 3.0, "chorus", 1)], "own")
    short = ("s", 100.0, 4, 9, "minor", 0.5, "8A", 1.0, [0.1], [0.1], None, "own")
    schema = "track_id string, bpm double, beats_per_bar int, key int, mode string, key_confidence double, camelot string, duration double, beats array<double>, downbeats array<double>, sections array<struct<start: double, end: double, label: string, ordinal: int>>, backend string"
    df = spark.createDataFrame([row, short], schema)
    up = {r.track_id: (r.key, r.camelot) for r in an.transposed(df, 2).collect()}
    assert up == {"t": (9, "11B"), "s": (11, "10A")}
    knots = an.steady_map(df, 120.0)
    got = {r.track_id: r for r in an.regridded(df, knots).collect()}
    assert got["t"].beats == pytest.approx([0, 0.5, 1.0, 1.5, 2.0, 2.5]) and got["t"].bpm == 120 and got["t"].downbeats == pytest.approx([0, 2.0])
    assert [(s.start, s.end) for s in got["t"].sections] == [(0, pytest.approx(1.0)), (pytest.approx(1.0), 2.5)]  # held at the map's end
    assert got["s"].beats == [0.1] and got["s"].bpm == 100
    report = an.regrid_report(knots).first()
    assert (report.beats_used, report.max_stretch, report.drift_ms) == (6, pytest.approx(1.04), pytest.approx(20.0))
    x = song(4)
    audio = frame(spark, {"t": x, "s": x[:SR]})
    moved = {r.track_id: len(r.samples) for r in sp.moved_beats(audio, an.steady_map(df, 100.0)).collect()}
    assert moved["s"] == SR and moved["t"] > len(x)
    parts = spark.createDataFrame([("t", "keys"), ("t", "bass")], "track_id string, part_key string")
    notes = spark.createDataFrame([("t", "keys", 60)], "track_id string, part_key string, pitch int")
    said = {r.part_key: (r.n_notes, r.warning) for r in an.transcription_report(parts, notes).collect()}
    assert said == {"keys": (1, None), "bass": (0, "no notes in bass")}
