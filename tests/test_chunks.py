"""Signals in chunks of any size: grids, halos, proofs of trees and frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks as ch
from tessera.operators import kernels as k
from tessera.operators import spectral as sp
from tessera.plans.decompose import folded, leaves, multitrack, proof, separate
from tessera.plans.options import SPLITS, Options
from tessera.sources import audio as au

SR = 8000


def chunked(signals, sizes):
    """AUDIO rows of signals, each cut by its own sizes, again and again."""
    out = []
    for key, x in signals.items():
        for c in (0, 1):
            at, n = 0, 0
            while at < len(x):
                step = sizes[key][n % len(sizes[key])]
                out.append(("song", key, c, n, at / SR, SR, [float(v) for v in np.float32(x[at : at + step])]))
                at, n = at + step, n + 1
    return out


@pytest.fixture(scope="module")
def song():
    rng = np.random.default_rng(4)
    n = 150_001
    t = np.arange(n) / SR
    truth = {"vocals": 0.3 * np.sin(2 * np.pi * 440 * t), "drums": 0.2 * rng.standard_normal(n) * (np.sin(2 * np.pi * 2 * t) > 0.9), "bass": 0.3 * np.sin(2 * np.pi * 55 * t)}
    mix = sum(truth.values())
    estimates = {"vocals": truth["vocals"] * 0.9, "instrumental": truth["drums"] + truth["bass"], "drums": truth["drums"] * 0.8, "bass": truth["bass"] * 0.9}
    return mix, estimates


def joined(df, part):
    rows = sorted(df.filter(F.col("part_key") == part).filter("channel = 0").collect(), key=lambda r: r.t0)
    return np.concatenate([r.samples for r in rows])


def test_tree_of_a_chunked_recording(spark, song):
    mix, estimates = song
    sizes = {"mix": [65_536], "vocals": [50_000, 7, 20_001], "instrumental": [10**6], "drums": [65_536], "bass": [30_000]}
    frame = lambda s: spark.createDataFrame(chunked(s, sizes), au.AUDIO)
    whole = frame({"mix": mix})
    for options in (Options(), Options(refine_rounds=1)):
        done = separate(whole, frame(estimates), options)
        error = done.proof.first().error_db
        assert error is None or error < -100
    parts = sp.split_tree(whole.unionByName(frame(estimates)), SPLITS, size=1 << 15)
    want = k.split_tree({"mix": np.float32(mix).astype(float)} | {p: np.float32(x).astype(float) for p, x in estimates.items()}, SPLITS, 2.0, True, 0, 5.0)
    assert parts.select("chunk_no").distinct().count() == 5
    for part in ("vocals", "drums", "pads"):
        assert np.allclose(joined(parts, part), want[part], atol=2e-6), part
    # a part that is missing or too long shows
    without = proof(leaves(parts).filter("part_key <> 'bass'"), whole).first().error_db
    assert -20 < without < 0
    longer = leaves(parts).unionByName(spark.createDataFrame([("song", "extra", 0, 9, 40.0, SR, [0.5] * 100)], au.AUDIO))
    assert -60 < proof(longer, whole).first().error_db < 0
    # verdicts move whole arrays
    verdicts = spark.createDataFrame([("song", "bass", "absent")], "track_id string, part_key string, decision string")
    fold = folded(parts, verdicts, Options())
    assert np.allclose(joined(fold, "pads"), want["pads"] + want["bass"], atol=3e-6) and "bass" not in {r.part_key for r in fold.select("part_key").distinct().collect()}
    error = proof(leaves(fold), whole).first().error_db
    assert error is None or error < -100


def test_folder_longer_than_a_chunk(spark, tmp_path, song):
    folder = tmp_path / "long"
    folder.mkdir()
    for name, x in (("01 Kick", song[0]), ("02 Bass DI", song[0][:70_000] * 0.5), ("03 BGV L", song[0][::-1])):
        (folder / f"{name}.wav").write_bytes(au.encode_wav(x, SR))
    done = multitrack(spark, str(folder))
    error = done.proof.first().error_db
    assert error is None or error < -100
    assert done.parts.select("chunk_no").distinct().count() == 3


def test_halo_reaches_over_several_cells(spark):
    x = np.arange(100.0)
    audio = spark.createDataFrame([("s", "mix", 0, n, a / 10, 10, [float(v) for v in x[a : a + 7]]) for n, a in enumerate(range(0, 100, 7))], au.AUDIO)
    got = {r.cell: (r.lo, r.hi, r.n) for r in ch.on_grid(audio, 10, 25).groupBy("cell").agg(F.min("place").alias("lo"), F.max(F.col("place") + F.size("samples")).alias("hi"), F.sum(F.size("samples")).alias("n")).collect()}
    assert got[0] == (0, 35, 35) and got[5] == (25, 85, 60) and got[9] == (65, 100, 35)
    seen = ch.by_cell(audio, 10, 25, lambda s, sr: {"mix": s["mix"] + 1000 * len(s["mix"])}, "mix", au.AUDIO, sp.COLUMNS)
    assert seen.count() == 10 and np.allclose(np.array(joined(seen, "mix")) % 1000, x)


def test_overlapping_frames_add_up_to_the_signal(spark):
    """Spectra of frames, inverted, windowed and added cell by cell: the signal comes back."""
    rng = np.random.default_rng(2)
    x, n_fft, hop = rng.standard_normal(1000), 64, 16
    w = np.hanning(n_fft + 1)[:-1]
    pieces = []
    for f in range((len(x) - n_fft) // hop + 1):
        y = np.fft.irfft(np.fft.rfft(x[f * hop : f * hop + n_fft] * w)) * w / 1.5
        pieces.append(("s", "mix", 0, f, float(f * hop), 1, [float(v) for v in y]))
    audio = spark.createDataFrame(pieces, au.AUDIO.replace("float", "double"))
    rows = sorted(ch.added(ch.on_grid(audio, 128), ["track_id"], size=128).collect(), key=lambda r: r.cell)
    got = np.concatenate([r.total for r in rows])
    assert np.allclose(got[n_fft : -n_fft], x[n_fft : len(got) - n_fft], atol=1e-12)


@pytest.mark.parametrize("together", [1, 3, 1000])
def test_frames_do_not_depend_on_blocks(spark, together):
    rng = np.random.default_rng(3)
    x = {p: rng.standard_normal(n) for p, n in (("a", 500), ("b", 64), ("c", 63))}
    df = spark.createDataFrame([(p, i, float(v)) for p, s in x.items() for i, v in enumerate(s)], "part string, i long, v double")
    got = {(r.part, r.frame): r.e for r in ch.frames(df, ["part"], "i", "v", 64, 16, lambda f: {"e": np.square(np.abs(np.fft.fft(f, axis=1))).sum(1) / 64}, "e double", together).collect()}
    want = {(p, f): float(np.square(s[f * 16 : f * 16 + 64]).sum()) for p, s in x.items() for f in range((len(s) - 64) // 16 + 1)}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in want)
