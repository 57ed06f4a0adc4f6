"""Signals with known parts: exact sums, round trips, folders of channels, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.operators import restoration as re
from tessera.operators import sections as se
from tessera.operators import spectral as sp
from tessera.plans.decompose import multitrack, separate
from tessera.plans.options import Options
from tessera.sources import audio as au
from tessera.sources import exports as ex
from tessera.streaming import live

SR = 8000


def tone(f, seconds=2.0, level=0.3):
    return level * np.sin(2 * np.pi * f * np.arange(int(SR * seconds)) / SR)


def rows(signals):
    return [("song", key, c, 0, 0.0, SR, [float(v) for v in np.float32(x)]) for key, x in signals.items() for c in (0, 1)]


def test_stft_comes_back():
    x = np.random.default_rng(0).standard_normal(5000)
    assert np.allclose(k.istft(k.stft(x, 512), len(x), 512), x, atol=1e-8)


def test_partition_sums_exactly():
    rng = np.random.default_rng(1)
    a, b = tone(220), tone(660)
    parts = k.partition_exact(a + b, {"a": a * 0.9 + 0.1 * b, "b": b + 0.002 * rng.standard_normal(len(b))})
    rest = a + b - sum(parts.values())
    assert 20 * np.log10(np.sqrt(np.mean(rest**2)) / np.sqrt(np.mean((a + b) ** 2)) + 1e-15) < -100
    assert np.corrcoef(parts["a"], a)[0, 1] > 0.99
    with pytest.raises(ValueError):
        k.partition_exact(a, {})


def test_beats_and_pitch():
    x = np.zeros(SR * 8)
    click = k.tick(SR, 1000)
    for n in range(16):
        x[n * SR // 2 : n * SR // 2 + len(click)] += click
    bpm, times = k.beats(x, SR)
    assert bpm == pytest.approx(120, rel=0.06) and len(times) > 10
    assert len(k.onsets(x, SR)) >= 12
    up = k.pitch_shift(tone(440), SR, 12)
    spec = np.abs(np.fft.rfft(up[2000:-2000] * np.hanning(len(up) - 4000)))
    assert np.argmax(spec) * SR / (len(up) - 4000) == pytest.approx(880, rel=0.02)


def test_chroma_regrid_and_weights():
    assert int(np.argmax(k.chroma(tone(440), SR).sum(1))) == 9
    x = tone(300, 3)
    assert np.array_equal(k.regrid(x, np.array([0.5, 1.0]), np.array([0.5, 1.1]), SR), x)
    y = k.regrid(x, np.array([0.5, 1.0, 1.5, 2.0]), np.array([0.5, 1.1, 1.7, 2.3]), SR)
    assert len(y) > len(x)
    assert np.sqrt(np.mean(k.k_weight(tone(2500), SR) ** 2)) > np.sqrt(np.mean(k.k_weight(tone(30), SR) ** 2))
    assert np.abs(k.synthesize([(0.1, 0.5, 69, 1.0)], lambda n, f: 1 / np.arange(1, n + 1), 1.0, SR)).max() <= 1.0
    assert k.synthesize([], lambda n, f: np.ones(n), 0.5, SR).max() == 0
    assert len(k.pad_tone([220.0], 2, SR)) == 2 * SR


def test_tree_of_parts_sums_to_the_mix(spark):
    truth = {"vocals": tone(440), "drums": tone(90), "bass": tone(55)}
    mix = sum(truth.values())
    estimates = {"vocals": truth["vocals"] * 0.9, "instrumental": truth["drums"] + truth["bass"], "drums": truth["drums"] * 0.8, "bass": truth["bass"] * 0.9}
    frame = lambda s: spark.createDataFrame(rows(s), au.AUDIO)
    done = separate(frame({"mix": mix}), frame(estimates))
    error = done.proof.first().error_db
    assert error is None or error < -100
    assert {r.part_key for r in done.parts.select("part_key").distinct().collect()} == {"vocals", "instrumental", "drums", "bass", "pads"}
    assert done.analysis.count() == 1


def signal(parts, key):
    rows = parts.filter(f"part_key = '{key}' and channel = 0").orderBy("chunk_no").collect()
    return np.concatenate([r.samples for r in rows])


def test_missing_estimates_and_verdicts(spark):
    truth = {"vocals": tone(440), "drums": tone(90), "bass": tone(55)}
    mix = sum(truth.values())
    frame = lambda s: spark.createDataFrame(rows(s), au.AUDIO)
    # what has no estimate is the parent less the others, and no share of its siblings'
    done = separate(frame({"mix": mix}), frame({"vocals": truth["vocals"]}))
    rest = signal(done.parts, "instrumental")
    assert np.corrcoef(rest, truth["drums"] + truth["bass"])[0, 1] > 0.98 and (done.proof.first().error_db or -200) < -100
    raw = separate(frame({"mix": mix}), frame({"vocals": truth["vocals"] * 0.5}), Options(exact=False))
    assert np.allclose(signal(raw.parts, "vocals"), truth["vocals"] * 0.5, atol=1e-6) and np.allclose(signal(raw.parts, "instrumental"), mix - truth["vocals"] * 0.5, atol=1e-5)
    sharp = separate(frame({"mix": mix}), frame({"vocals": truth["vocals"]}), Options(refine_rounds=2))
    assert (sharp.proof.first().error_db or -200) < -100
    # a rejected part's sound stays in its siblings' sum
    estimates = {"vocals": truth["vocals"], "instrumental": truth["drums"] + truth["bass"], "drums": truth["drums"], "bass": truth["bass"], "kick": truth["drums"], "snare": truth["drums"] * 0.1}
    verdicts = spark.createDataFrame([("song", "bass", "absent"), ("song", "vocals", "absent"), ("song", "drums", "uncertain")], "track_id string, part_key string, decision string")
    for options, left in ((Options(), {"vocals", "instrumental", "drums", "kick", "snare", "pads"}), (Options(keep_uncertain=False), {"vocals", "instrumental", "pads"})):
        kept = separate(frame({"mix": mix}), frame(estimates), options, verdicts)
        assert {r.part_key for r in kept.parts.select("part_key").distinct().collect()} == left
        assert (kept.proof.first().error_db or -200) < -100


def test_folder_of_channels(spark, tmp_path):
    folder = tmp_path / "song"
    folder.mkdir()
    for name, f in (("01 Kick", 60), ("02 Bass DI", 110), ("03 Lead Vox", 440), ("04 Click", 1000), ("05 Mystery", 700), ("06 BGV L", 300), ("07 BGV R", 310)):
        (folder / f"{name}.wav").write_bytes(au.encode_wav(tone(f, 1.0), SR))
    (folder / "channels.json").write_text('{"05 Mystery": "keys"}')
    assert {r.part_key for r in multitrack(spark, str(folder)).parts.select("part_key").distinct().collect()} == {"kick", "bass", "lead_vocal", "keys", "bgv"}
    (folder / "channels.json").unlink()
    done = multitrack(spark, str(folder))
    assert {r.part_key for r in done.parts.select("part_key").distinct().collect()} == {"kick", "bass", "lead_vocal", "ch_mystery", "bgv"}
    error = done.proof.first().error_db
    assert error is None or error < -100
    kinds = {r.file: (r.kind, r.part_key, r.seconds) for r in done.report.collect()}
    assert kinds["04 Click.wav"][0] == "click" and kinds["05 Mystery.wav"][:2] == ("unmatched", "ch_mystery") and kinds["01 Kick.wav"] == ("part", "kick", 1.0) and len(kinds) == 7
    click = done.click.filter("channel = 0").collect()
    assert [r.part_key for r in click] == ["click"] and np.allclose(click[0].samples, tone(1000, 1.0), atol=1e-4)
    x, sr = au.decode_wav(au.encode_wav(tone(50), SR, 2))
    assert sr == SR and np.allclose(x[0], tone(50), atol=1e-4)
    out = au.write_wavs(done.parts, str(tmp_path / "out"))
    assert out.count() == 5


def test_frames_keep_energy(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(130)], "part string, i int, v double")
    got = sp.frame_energy(df, "part", "i", "v", 64).collect()
    assert len(got) == 2 and all(r.energy == pytest.approx(r.time_energy) for r in got)


def test_text_exports(tmp_path):
    lines = ex.cue_sheet("Song", "mix.wav", [("Intro", "00:00:00"), ("Verse 1", "00:12:37")])
    assert lines[-1] == "    INDEX 01 00:12:37"
    ex.write_text(lines + ex.chart("Song", "G", 76.0, [("Intro", 4, 0.0)]), str(tmp_path / "x.cue"))
    assert (tmp_path / "x.cue").read_text().endswith("| Intro | 4 | 0:00 |\n")


def test_streams(spark, tmp_path):
    src = tmp_path / "events"
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(str(src))
    for name, f in (("rates", live.rates), ("levels", live.block_levels), ("sessions", live.sessions)):
        q = f(live.event_stream(spark, str(src))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0


def test_patches():
    for name in k.PATCHES:
        y = k.render_part("x", [(0.0, 0.4, 60, 1.0)], 0.6, SR, name)
        assert y.shape == (2, int(0.6 * SR)) and np.abs(y).max() == pytest.approx(10 ** (-14 / 20))
    assert not k.render_part("keys", [], 0.2, SR).any()


def test_shapes_and_rates(spark):
    df = spark.createDataFrame(rows({"x": tone(50, 0.5)})[:1], au.AUDIO)
    got = {r.channel: r.samples for r in au.match_shape(df, 3, 5000).collect()}
    assert sorted(got) == [0, 1, 2] and all(len(x) == 5000 for x in got.values()) and got[2][:100] == got[0][:100] and got[1][4500] == 0
    assert au.match_shape(df.union(df.withColumn("channel", F.lit(1))), 1, 10).select("channel").collect()[0][0] == 0
    half = sp.resampled(df, SR // 2).first()
    assert half.sr == SR // 2 and len(half.samples) == 2000


def test_repairs_of_all_parts(spark):
    a, b = tone(220, 3.0), tone(660, 3.0, 0.1)
    hurt = a.copy()
    hurt[4000:11000] = 0
    notes = spark.createDataFrame([("song", "a", 0.0, 3.0, 57, 1.0)], "track_id string, part_key string, t_start double, t_end double, pitch int, amplitude double")
    spans = spark.createDataFrame([("song", 0.0, 1.5, "verse"), ("song", 1.5, 3.0, "verse")], "track_id string, t_start double, t_end double, label string")
    done = sp.restored(spark.createDataFrame(rows({"mix": a + b, "a": hurt, "b": b}), au.AUDIO), {}, notes, spans)
    assert {(r.part_key, r.channel) for r in done.select("part_key", "channel").collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    mix = np.float32(a + b).astype(float)
    parts = {"a": np.float32(hurt).astype(float), "b": np.float32(b).astype(float)}
    alone = {p: re.restore(x, mix, SR, [(0.0, 3.0, 57, 1.0)] if p == "a" else [], [(0.0, 1.5, "verse"), (1.5, 3.0, "verse")])[0] for p, x in parts.items()}
    want, _ = re.cap_to_mix(alone, parts, mix)
    assert np.allclose(signal(done, "a"), want["a"], atol=1e-4) and np.allclose(signal(done, "b"), want["b"], atol=1e-4)
    assert np.abs(signal(done, "b") - b)[500:-500].max() < 0.05


def test_pads_and_rooms():
    x = tone(220, 1.0)
    assert np.array_equal(k.room(x, SR, wet=0.0), x)
    late = k.room(np.concatenate([x, np.zeros(SR)]), SR)[SR + 100 :]
    assert np.square(late).mean() > 1e-6  # the room goes on
    long = k.tiled(np.ones(1000), 5000, 200)
    assert len(long) == 5000 and long[300:700] == pytest.approx(1.0) and np.abs(long[100:]).max() <= 1.42
    pad = k.ambient_pad([220.0, 277.2], 30.0, SR)
    assert len(pad) == 30 * SR and abs(pad[0]) < 1e-6 and np.square(pad[10 * SR : 20 * SR]).mean() > 1e-6
    steady = [np.sqrt(np.square(pad[s * SR : (s + 1) * SR]).mean()) for s in range(4, 26)]
    assert max(steady) < 3 * min(steady)


def test_notes_survive_a_room_and_human_timing(spark):
    """Known notes, played late or early and heard in a room, are found again by their onsets within the tolerance."""
    rng = np.random.default_rng(11)
    notes = [(0.5 * n, 0.5 * n + 0.4, 57 + n % 5, 1.0) for n in range(16)]
    played = [(max(0.0, a + d), z + d, p, v) for (a, z, p, v), d in zip(notes, rng.normal(0, 0.01, 16), strict=True)]
    x = k.room(k.synthesize(played, lambda n, f: 1 / np.arange(1, n + 1) ** 2, 8.5, SR), SR, 0.4, 0.2) + 1e-4 * rng.standard_normal(int(8.5 * SR))
    frame = lambda times: spark.createDataFrame([("t", 0, int(1e6 * t)) for t in times], "track string, p int, us long")
    got = se.note_scores(frame(k.onsets(x, SR)), frame([a for a, *_ in notes]), ["track"], "us", "p", 100_000).first()
    assert got.recall > 0.8
