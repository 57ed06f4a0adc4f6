"""The WAV data source: byte ranges, pushed filters, pruned samples, and files that a commit makes."""

import io
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import audio as au
from tessera.sources import wav

SR = 8000


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        super().__init__(data)
        self.count = 0

    def read(self, n=-1):
        out = super().read(n)
        self.count += len(out)
        return out


@pytest.fixture
def folder(tmp_path):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (2, 5 * wav.CHUNK + 123))
    where = tmp_path / "song"
    where.mkdir()
    (where / "long.wav").write_bytes(au.encode_wav(x, SR, 2))
    (where / "mono.WAV").write_bytes(au.encode_wav(x[0, :1000], SR))
    (where / "empty.wav").write_bytes(au.encode_wav(x[:, :0], SR))
    (where / "notes.txt").write_text("no audio")
    return where, x


def test_a_long_file_is_read_by_several_tasks(spark, folder):
    where, x = folder
    df = wav.read_wavs(spark, str(where), step=200_000)
    part = df.withColumn("task", F.spark_partition_id()).filter("part_key = 'long.wav'")
    assert part.select("task").distinct().count() == 6
    for c in (0, 1):
        rows = part.filter(F.col("channel") == c).orderBy("chunk_no").collect()
        assert [r.chunk_no for r in rows] == list(range(6)) and [r.t0 for r in rows] == [k * wav.CHUNK / SR for k in range(6)]
        assert np.allclose(np.concatenate([r.samples for r in rows]), x[c], atol=1e-4)
    mono = df.filter("part_key = 'mono.WAV'").collect()
    assert [r.channel for r in mono] == [0, 1] and mono[0].samples == mono[1].samples and {r.track_id for r in mono} == {"song"}
    assert {r.part_key for r in df.select("part_key").distinct().collect()} == {"long.wav", "mono.WAV"}
    assert wav.read_wavs(spark, str(where.parent)).count() == 0 and wav.read_wavs(spark, str(where.parent), recursive=True).count() == 14


def test_any_range_gives_the_same_chunks(folder):
    where, x = folder
    data = (where / "long.wav").read_bytes()
    for step in (1, 50_000, 262_144, 262_145, 10**9):
        reader = wav.WavReader(str(where), ["chunk_no", "channel"], step=max(step, 4096))
        parts = [p for p in reader.partitions() if p.path.endswith("long.wav")]
        got = [k for p in parts for b in reader.read(p) for k in b.column("chunk_no").to_pylist()]
        assert got == [k for k in range(6) for _ in (0, 1)]
        assert sum(p.end - p.begin for p in parts) == len(data)


def test_what_is_not_asked_for_is_not_read(spark, folder):
    where, _ = folder
    span = (2.5 * wav.CHUNK / SR, 3.5 * wav.CHUNK / SR)
    reader = wav.WavReader(str(where), list(wav.TYPES), only={"part_key": ["long.wav"], "channel": [1], "t0": span})
    (only,) = reader.partitions()
    f = Counted((where / "long.wav").read_bytes())
    (batch,) = reader.chunks(f, only, "song", "long.wav")
    assert batch.column("chunk_no").to_pylist() == [3] and batch.column("channel").to_pylist() == [1]
    assert f.count < wav.CHUNK * 4 + 200  # one chunk of the file's six, and its head
    bare = wav.WavReader(str(where), ["part_key", "sr"])
    f = Counted((where / "long.wav").read_bytes())
    assert sum(b.num_rows for b in bare.chunks(f, only, "song", "long.wav")) == 12 and f.count < 200
    df = wav.read_wavs(spark, str(where), tracks=["song"], parts=["long.wav"], channels=[1], times=(span[0], None))
    assert [(r.chunk_no, r.channel) for r in df.orderBy("chunk_no").collect()] == [(3, 1), (4, 1), (5, 1)]
    assert df.filter("chunk_no = 4").count() == 1 and df.count() == 3  # a filter of one query is none of the next
    assert wav.read_wavs(spark, str(where), tracks=["other"]).count() == 0
    assert wav.read_wavs(spark, str(where), columns="part_key string, sr int").distinct().count() == 2


def test_formats(tmp_path):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (2, 100)).astype(np.float32)
    for width, off in ((2, 1e-4), (3, 1e-6)):
        data = au.encode_wav(x, SR, width)
        with wave.open(io.BytesIO(data)) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()) == (2, width, SR, 100)
        assert np.allclose(au.decode_wav(data)[0], x, atol=off)
    plain = x.T.astype("<f4").tobytes()
    listed = b"LIST" + (5).to_bytes(4, "little") + b"abcde\0"
    fmt = b"fmt " + (16).to_bytes(4, "little") + (3).to_bytes(2, "little") + (2).to_bytes(2, "little") + SR.to_bytes(4, "little") + (SR * 8).to_bytes(4, "little") + (8).to_bytes(2, "little") + (32).to_bytes(2, "little")
    data = b"RIFF\0\0\0\0WAVE" + fmt + listed + b"data" + (2**32 - 1).to_bytes(4, "little") + plain  # a size that a stream never filled in
    assert np.array_equal(au.decode_wav(data)[0], x)
    for bad in (b"RIFF\0\0\0\0WAVE", b"no", data.replace(b"\x03\0\x02\0", b"\x55\0\x02\0")):
        with pytest.raises(ValueError):
            au.decode_wav(bad)


def test_written_files_come_back(spark, folder, tmp_path):
    where, x = folder
    out = au.write_wavs(wav.read_wavs(spark, str(where)), str(tmp_path / "out"), 2)
    assert {r.part_key for r in out.collect()} == {"long.wav", "mono.WAV"} and all(-3 < r.peak_db < 0 for r in out.collect())
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert names == ["song/long.wav", "song/mono.WAV.wav"]
    assert np.allclose(au.decode_wav((tmp_path / "out/song/long.wav").read_bytes())[0], x, atol=1e-4)


def test_a_task_that_fails_leaves_each_file_once(spark, tmp_path):
    rows = [("s", "kick", c, k, 0.0, SR, [0.5] * 100) for k in range(3) for c in (0, 1)]
    names = ["track_id", "part_key", "channel", "chunk_no", "sr", "samples", "frames", "channels"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, (t, p, c, k, sr, s, 300, 2), strict=True)) for t, p, c, k, _, sr, s in rows])
    writer = wav.WavWriter(str(tmp_path), 2)

    def breaks():
        yield batch.slice(0, 4)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    twice = [writer.write(iter([batch])), writer.write(iter([batch]))]  # a speculative copy's message never arrives
    assert not list((tmp_path / "s").rglob("*")) if (tmp_path / "s").exists() else True
    writer.commit([twice[1], None])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["s/kick.wav"]
    assert au.decode_wav((tmp_path / "s/kick.wav").read_bytes())[0].shape == (2, 300)
    # a job that fails leaves nothing, and the next one is whole
    audio = spark.createDataFrame(rows, wav.AUDIO)
    bad = audio.withColumn("samples", F.when(F.col("chunk_no") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("samples")).cast("array<float>"))
    with pytest.raises(Exception, match="lost"):
        au.write_wavs(bad, str(tmp_path / "jobs")).count()
    assert not [p for p in (tmp_path / "jobs").rglob("*") if p.is_file()]
    au.write_wavs(audio, str(tmp_path / "jobs"))
    assert [p.name for p in (tmp_path / "jobs").rglob("*") if p.is_file()] == ["kick.wav"]
