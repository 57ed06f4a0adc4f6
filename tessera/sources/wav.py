"""WAV files as a data source of Spark's: read by byte ranges, written with a commit.

Reading: a file larger than a range is read by several tasks, each the chunks that begin
in its range; the tracks, parts, channels and times that a reader is given leave out
files, channels and bytes, and samples are read only where they are asked for. (They are
given to the reader and not taken from filters: a table from a Python source keeps, in
Spark 4.1, the filters of its last query, and a query without any would lose rows.) Writing: a task's files have
names of its own until the job commits, so a task that runs again, or twice, leaves each
file once, and a job that fails leaves none. Paths are those of pyarrow's file systems
(local, hdfs://, s3://, gs://): executors and driver must reach them alike.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

AUDIO = "track_id string, part_key string, channel int, chunk_no int, t0 double, sr int, samples array<float>"
#: Frames of a chunk, and bytes of a file that a task reads.
CHUNK, RANGE = 1 << 16, 8 << 20
TYPES = {"track_id": pa.string(), "part_key": pa.string(), "channel": pa.int32(), "chunk_no": pa.int32(), "t0": pa.float64(), "sr": pa.int32(), "samples": pa.list_(pa.float32())}
# Kinds of samples in a WAV file's format part, and the largest file that its sizes can say.
WHOLE_NUMBERS, FLOATS, EXTENSIBLE, LARGEST = 1, 3, 0xFFFE, 0xFFFFFFFF


def file_system(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else str(Path(path).absolute()))


@dataclass
class Format:
    """Where a file's samples begin, how many frames there are, and how they are written."""

    begin: int
    frames: int
    channels: int
    rate: int
    width: int
    floats: bool

    @property
    def frame(self) -> int:
        return self.channels * self.width

    def decoded(self, raw: bytes) -> np.ndarray:
        """float32 (channel, frame)."""
        if self.floats:
            x = np.frombuffer(raw, {4: "<f4", 8: "<f8"}[self.width]).astype(np.float32)
        elif self.width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)).astype(np.float32)
        else:
            x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[self.width]).astype(np.int64) - (128 if self.width == 1 else 0)
            x = (x / float(1 << (8 * self.width - 1))).astype(np.float32)
        return x.reshape(-1, self.channels).T


def read_format(f, size: int) -> Format:
    """The format of an open file of so many bytes; parts other than format and data are passed over."""
    f.seek(0)
    if f.read(12)[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            head = f.read(min(n, 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[:16])
            kind = (struct.unpack("<H", head[24:26])[0] if code == EXTENSIBLE else code, channels, rate, bits // 8)
            if kind[0] not in (WHOLE_NUMBERS, FLOATS):
                raise ValueError(f"samples of kind {kind[0]} are not read")
        elif name == b"data" and kind:
            code, channels, rate, width = kind
            return Format(at + 8, min(n, size - at - 8) // (channels * width), channels, rate, width, code == FLOATS)
        at += 8 + n + n % 2
    raise ValueError("no samples in this file")


def header(frames: int, channels: int, rate: int, width: int) -> bytes:
    n = frames * channels * width
    if n + 36 > LARGEST:
        raise ValueError("a WAV file holds 4 GB at most")
    fmt = struct.pack("<HHIIHH", WHOLE_NUMBERS, channels, rate, rate * channels * width, channels * width, 8 * width)
    return struct.pack("<4sI4s4sI", b"RIFF", n + n % 2 + 36, b"WAVE", b"fmt ", len(fmt)) + fmt + struct.pack("<4sI", b"data", n)


def encoded(x: np.ndarray, width: int) -> bytes:
    """A (channel, frame) array as interleaved whole numbers, clipped to +-1."""
    top = (1 << (8 * width - 1)) - 1
    v = np.ascontiguousarray(np.round(np.clip(x, -1, 1).T * top).astype("<i4"))
    return v.view(np.uint8).reshape(*v.shape, 4)[:, :, :width].tobytes()


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int


@dataclass
class WavReader(DataSourceReader):
    path: str
    columns: list[str]
    recursive: bool = False
    step: int = RANGE
    only: dict[str, list] = field(default_factory=dict)

    def asked(self, name: str, value) -> bool:
        return self.only.get(name) is None or value in self.only[name]

    def partitions(self) -> list[Range]:
        """The files' byte ranges: only names and sizes are looked at."""
        from pyarrow import fs

        files, top = file_system(self.path)
        info = files.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(top, recursive=self.recursive))
        out = []
        for f in sorted(found, key=lambda x: x.path):
            folder, _, name = f.path.rpartition("/")
            hidden = any(x.startswith(("_", ".")) for x in f.path[len(top) :].split("/"))
            if f.type == fs.FileType.File and name.lower().endswith(".wav") and not hidden and self.asked("part_key", name) and self.asked("track_id", folder.rpartition("/")[2]):
                out += [Range(f.path, f.size, a, min(a + self.step, f.size)) for a in range(0, max(f.size, 1), self.step)]
        return out or [Range("", 0, 0, 0)]

    def in_time(self, t0: float) -> bool:
        """Whether a chunk that begins at t0 is asked for: of a span of time [since, until) those that begin in it."""
        since, until = self.only.get("t0") or (None, None)
        return (since is None or t0 >= since) and (until is None or t0 < until)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        files, _ = file_system(self.path)
        folder, _, name = part.path.rpartition("/")
        with files.open_input_file(part.path) as f:
            yield from self.chunks(f, part, folder.rpartition("/")[2], name)

    def chunks(self, f, part: Range, track: str, name: str) -> Iterator[pa.RecordBatch]:
        """The chunks that begin in a range, as rows of one channel each."""
        form = read_format(f, part.size)
        size = form.frame * CHUNK
        first, last = max(0, -(-(part.begin - form.begin) // size)), min(-(-form.frames // CHUNK), -(-(part.end - form.begin) // size))
        channels = [c for c in range(max(form.channels, 2)) if self.asked("channel", c)]  # one channel becomes two
        for k in range(first, last):
            t0 = k * CHUNK / form.rate
            if not channels or not self.in_time(t0):
                continue
            row = {"track_id": track, "part_key": name, "chunk_no": k, "t0": t0, "sr": form.rate}
            values = {c: [v] * len(channels) for c, v in row.items()} | {"channel": channels}
            if "samples" in self.columns:
                f.seek(form.begin + k * size)
                x = form.decoded(f.read(min(CHUNK, form.frames - k * CHUNK) * form.frame))
                values["samples"] = [x[min(c, form.channels - 1)] for c in channels]
            yield pa.RecordBatch.from_arrays([pa.array(values[c], TYPES[c]) for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Rows in order of track, part, chunk and channel, with each file's frames and channels, to one file for each part."""

    def __init__(self, path: str, width: int):
        self.path, self.width, self.job = path, width, uuid.uuid4().hex

    def temporary(self) -> str:
        return f"{file_system(self.path)[1]}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = file_system(self.path)
        attempt, out, key, chunk, held, done = f"{self.temporary()}/{uuid.uuid4().hex}", None, None, None, {}, []

        def flush() -> None:
            """Write the chunk whose channels have been read."""
            if held:
                n = max(map(len, held.values()))
                x = np.zeros((channels, n), np.float32)
                for c, samples in held.items():
                    x[c, : len(samples)] = samples
                out.write(encoded(x, self.width))
                held.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                if key != (row["track_id"], row["part_key"]):
                    if out is not None:
                        flush()
                        out.close()
                    key, chunk, channels = (row["track_id"], row["part_key"]), None, row["channels"]
                    name = f"{row['track_id']}/{str(row['part_key']).removesuffix('.wav')}.wav"
                    files.create_dir(f"{attempt}/{row['track_id']}", recursive=True)
                    out = files.open_output_stream(f"{attempt}/{name}")
                    out.write(header(row["frames"], channels, row["sr"], self.width))
                    done.append((f"{attempt}/{name}", f"{top}/{name}"))
                if chunk != row["chunk_no"]:
                    flush()
                    chunk = row["chunk_no"]
                held[row["channel"]] = row["samples"]
        if out is not None:
            flush()
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = file_system(self.path)
        for m in messages:
            for made, name in m.files if m else []:
                files.create_dir(name.rpartition("/")[0], recursive=True)
                files.move(made, name)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        files, top = file_system(self.path)
        if files.get_file_info(self.temporary()).type == fs.FileType.Directory:
            files.delete_dir(self.temporary())
        over = files.get_file_info(f"{top}/_temporary").type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(f"{top}/_temporary"))
        if over:
            files.delete_dir(f"{top}/_temporary")


class WavSource(DataSource):
    """Format "wav". Options: path, recursive, range (bytes of a task), only (JSON: lists of track_id, part_key, channel; t0: since and until),
    width (bytes of a written sample). A reader's columns are those of the schema that it is given."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return AUDIO

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], schema.fieldNames(), self.options.get("recursive", "false") == "true", int(self.options.get("range", RANGE)), json.loads(self.options.get("only", "{}")))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], int(self.options.get("width", 3)))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session."""
    spark.dataSource.register(WavSource)
    return spark


def read_wavs(spark: SparkSession, path: str, recursive: bool = False, columns: str = AUDIO, step: int = RANGE, tracks: list | None = None, parts: list | None = None, channels: list | None = None, times: tuple | None = None) -> DataFrame:
    """Every WAV file under path as rows of AUDIO, or of those columns of it; part_key is the file's name.

    Of the tracks, parts, channels and times (from the first, before the second; None: no bound) given nothing else is read."""
    only = json.dumps({"track_id": tracks, "part_key": parts, "channel": channels, "t0": times})
    return register(spark).read.format("wav").schema(columns).option("recursive", str(recursive).lower()).option("range", step).option("only", only).load(path)


def write_wavs(audio: DataFrame, path: str, width: int = 3) -> DataFrame:
    """One WAV file per track and part under path, once all are written; returns what was written: track_id, part_key, path, peak_db."""
    key = ["track_id", "part_key"]
    lengths = audio.groupBy(*key, "channel").agg(F.sum(F.size("samples")).alias("n")).groupBy(*key).agg(F.max("n").alias("frames"), (F.max("channel") + 1).alias("channels"))
    rows = audio.join(lengths, key).select(*key, "channel", "chunk_no", "sr", "samples", "frames", "channels")
    register(audio.sparkSession)
    rows.repartition(*key).sortWithinPartitions(*key, "chunk_no", "channel").write.format("wav").option("width", width).mode("append").save(path)
    peak = F.max(F.array_max(F.transform("samples", F.abs))).cast("double")
    name = F.concat(F.lit(path.rstrip("/") + "/"), F.col("track_id"), F.lit("/"), F.regexp_replace("part_key", r"\.wav$", ""), F.lit(".wav"))
    return audio.groupBy(*key).agg(peak.alias("peak")).select(*key, name.alias("path"), F.when(F.col("peak") > 1e-10, 20 * F.log10("peak")).alias("peak_db"))
