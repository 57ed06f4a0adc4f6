"""Repairs against known truth, and what they must refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.operators import kernels as k
from tessera.operators import restoration as re
from tessera.operators import structure as st
from tessera.sources import exports as ex

SR = 8000


def note(f0, seconds, amps, level=0.3):
    t = np.arange(int(SR * seconds)) / SR
    return level * sum(a * np.sin(2 * np.pi * f0 * (h + 1) * t) for h, a in enumerate(amps))


def test_short_gap_is_filled_and_long_refused():
    x = note(196, 6, [1, 0.6, 0.4, 0.3])
    hurt = x.copy()
    hurt[SR * 2 : SR * 2 + 800] *= 0.02
    got, report = re.fill_short_gaps(hurt, x, SR, n_fft=1024)
    assert report.repaired > 0 and np.mean((got - x) ** 2) < np.mean((hurt - x) ** 2)
    hurt[SR * 3 : SR * 5] *= 0.02
    _, report = re.fill_short_gaps(hurt, x, SR, longest_ms=100, n_fft=1024)
    assert report.refused > 0


def test_clean_part_is_left_alone():
    x = note(196, 3, [1, 0.6, 0.4])
    for got, report in (re.fill_short_gaps(x, x, SR), re.harmonic_restore(x, x, [(0.0, 3.0, 55, 1.0)], SR), re.borrow_from_repeats(x, x, [(0, 1.5, "a"), (1.5, 3, "a")], SR)):
        assert report.repaired == 0 and np.array_equal(got, x)


def test_harmonics_come_back_and_wrong_notes_do_not():
    amps = [1, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3]
    x = note(196, 6, amps)
    hole = note(196 * 3, 6, [0.7])
    hurt = x.copy()
    hurt[SR * 2 : SR * 4] -= hole[SR * 2 : SR * 4]
    got, report = re.harmonic_restore(hurt, x, [(0.0, 6.0, 55, 1.0)], SR, n_fft=2048)
    assert report.repaired > 0
    mag = lambda y: np.abs(k.stft(y, 2048))[round(588 * 2048 / SR), 36:58].mean()
    assert mag(got) > 3 * mag(hurt)
    _, wrong = re.harmonic_restore(hurt, x, [(0.0, 6.0, 61, 1.0)], SR, n_fft=2048)
    assert wrong.repaired <= report.repaired // 10


def test_repeats_lend_only_to_their_like():
    rng = np.random.default_rng(0)
    verse, other = note(196, 3, [1, 0.5, 0.4]) + 0.01 * rng.standard_normal(3 * SR), note(311, 3, [0.2, 1, 0.1]) + 0.01 * rng.standard_normal(3 * SR)
    whole = np.concatenate([verse, other, verse])
    hurt = whole.copy()
    hurt[SR : 2 * SR] *= 0.02
    got, report = re.borrow_from_repeats(hurt, whole, [(0, 3, "v"), (3, 6, "c"), (6, 9, "v")], SR, n_fft=1024)
    assert report.repaired > 0 and np.abs(got[SR : 2 * SR]).mean() > 5 * np.abs(hurt[SR : 2 * SR]).mean()
    same, report = re.borrow_from_repeats(hurt, whole, [(0, 3, "v"), (3, 6, "c")], SR, n_fft=1024)
    assert report.repaired == 0 and report.refused > 0 and np.array_equal(same, hurt)


def test_explain_and_timbre():
    amps = np.array([1, 0.15, 0.7, 0.2, 0.35])
    x = note(220, 3, amps)
    p = re.learn_timbre(x, [(0.2, 2.8, 57, 1.0)], SR, harmonics=5)
    assert np.allclose(p, amps / amps.sum(), atol=0.03)
    y, notes, share = re.explain(x, SR, lambda rest: [(0.0, 3.0, 57, 1.0)])
    assert share > 0.8 and len(notes) == 1
    silent, none, share = re.explain(x, SR, lambda rest: [])
    assert not silent.any() and not none and share == 0


def test_additions_fit_the_mix():
    a, b = note(200, 2, [1]), note(500, 2, [1])
    got, report = re.cap_to_mix({"a": a * 3, "b": b}, {"a": a, "b": b}, a + b, n_fft=1024)
    assert report.repaired > 0 and np.abs(got["a"]).max() < np.abs(a).max() * 1.5
    same, _ = re.cap_to_mix({"a": a, "b": b}, {"a": a, "b": b}, a + b, n_fft=1024)
    assert np.allclose(same["a"], a, atol=1e-9)
    _, reports = re.restore(a, a, SR, notes=[(0.0, 2.0, 55, 1.0)], sections=[(0, 1, "x"), (1, 2, "x")])
    assert set(reports) == {"repeats", "harmonics", "gaps"}


def test_sections_of_known_blocks(spark):
    rng = np.random.default_rng(3)
    kinds = [0] * 24 + [1] * 24 + [0] * 24 + [2] * 24
    f = np.eye(3)[kinds] * 3 + 0.05 * rng.standard_normal((96, 3))
    got = st.segment(f, sections=3)
    cuts = [k for k in range(1, 96) if got[k] != got[k - 1]]
    assert len(cuts) == 3 and all(abs(c - w) <= 4 for c, w in zip(cuts, (24, 48, 72), strict=True))
    df = spark.createDataFrame([("t", i, [float(v) for v in row]) for i, row in enumerate(f)], "track string, beat int, f array<double>")
    assert st.segment_tracks(df, "track", "beat", "f", sections=3).select("cluster").distinct().count() >= 2


def test_arrays_and_files(spark):
    df = spark.createDataFrame([([0.5, -1.0],)], "x array<float>")
    r = df.select(ar.match_length(F.col("x"), F.lit(3)).alias("a"), ar.match_length(F.col("x"), F.lit(1)).alias("b"), ar.peak_db(F.col("x")).alias("p"), ar.mono(F.col("x"), F.col("x")).alias("m"), ar.gain_to(F.lit(-10.0), -4.0).alias("g")).first()
    assert (r.a, r.b, r.p, r.m) == ([0.5, -1.0, 0.0], [0.5], 0.0, [0.5, -1.0]) and r.g == pytest.approx(10 ** (6 / 20))
    midi = ex.midi_bytes([(0.0, 0.5, 60, 0.8), (0.5, 1.0, 62, 0.8)])
    assert midi[:4] == b"MThd" and midi.endswith(b"\xff\x2f\x00")
    assert ex.folder_name("A/B  c", "G", 76.2, {"A_B c [G 76bpm]"}) == "A_B c [G 76bpm] (2)"
    assert '"title": "x"' in ex.session_json("x", {}, []) and "MARKER 1" in ex.project_text("x", 90, [("a", 0.0)], [("t", "t.wav", 1, False)])
