"""Blocks of documents that ask the whole corpus about their distinct keys.

What an operator has to know of every n-gram or pre-token of a corpus is neither
broadcast nor joined row by row. Consecutive documents form a block, which names
each of its distinct keys once; keys are dealt out by their hash, many to a row;
the task that has all of a key's askers works out the answer and sends it back to
the blocks that asked, in the order in which they asked. A key that a third of all
rows have is asked once by each block. Blocks, questions and answers are tables,
so Spark moves, sorts and recomputes them. The blocks' own data is written once, in
buckets of their numbers: afterwards answers alone are moved, to the buckets.

Blocks grow with the square root of the corpus and parts are no more than leave a
block `ROW_KEYS` keys for each on average, so rows stay coarse at every size: at most
one row for every `ROW_KEYS` keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, hadoop_path, shared_folder, tidy_shuffles

#: Characters of a block of a corpus of up to CORPUS bytes of text, and of any block; keys that a task answers at once (each as often as blocks ask for it).
BLOCK_CHARS, CORPUS, MOST_CHARS, ANSWERED = 4_000_000, 10 << 30, 64_000_000, 1_000_000
#: Keys of a block for each part, on average, at least.
ROW_KEYS = 256
#: Bytes of text for each bucket.
BUCKET = 32 << 20


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: of their numbers first all lowest bytes, then all next ones, and so on."""
    import zstandard

    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode(), np.array([len(a)], "<i8").tobytes(), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def opened(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        kind, n = np.dtype(raw[at : at + 3].decode()), int(np.frombuffer(raw, "<i8", 1, at + 3)[0])
        at += 11
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def block_chars(size: int) -> int:
    return min(MOST_CHARS, int(BLOCK_CHARS * max(1, size / CORPUS) ** 0.5))


def in_blocks(docs: DataFrame, pack: Callable[[list[tuple]], tuple], schema: str, names: list[str], part: float = 1.0) -> DataFrame:
    """b (the block's number) and what pack gives for the rows of each block, as a table in buckets of b; the second column of docs is the text. part: of a block's usual size."""
    spark, size = docs.sparkSession, docs.agg(F.coalesce(F.sum(F.octet_length(docs.columns[1])), F.lit(0))).first()[0]
    most = int(block_chars(size) * part)

    def run(it):
        kinds = {"long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        row = lambda rows: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(pack(rows), types, strict=True)], names=names)
        held, chars = [], 0
        for b in batches(it, 4 << 20):
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(x)
                chars += len(x[1])
                if chars >= most:
                    yield row(held)
                    held, chars = [], 0
        if held:
            yield row(held)

    buckets = min(50_000, max(4 * spark.sparkContext.defaultParallelism, size // BUCKET))
    name = f"blocks_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    numbered = docs.mapInArrow(run, schema).withColumn("b", F.monotonically_increasing_id())
    with tidy_shuffles(spark):
        numbered.repartition(buckets, "b").write.bucketBy(buckets, "b").option("path", folder).saveAsTable(name)
    files, path = hadoop_path(spark, folder)
    files.deleteOnExit(path)
    out = spark.table(name)
    out.block_table, out.step_folder = name, folder
    return out


def forget(blocks: DataFrame) -> None:
    """Remove the table of blocks that nothing reads any more."""
    blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {blocks.block_table}")
    files, path = hadoop_path(blocks.sparkSession, blocks.step_folder)
    files.delete(path, True)


def parts_of(keys: int, blocks: int) -> int:
    """Into how many parts the keys of all blocks are dealt."""
    return int(max(1, min(keys // ANSWERED + 1, keys // max(1, blocks) // ROW_KEYS)))


def ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Each part's number and where its keys begin and end; keys are in order."""
    p = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.r_[len(p) > 0, p[1:] != p[:-1]][: len(p)])
    for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(p)][: len(begin)], strict=True):
        yield int(p[a]), a, z


def dealt(keys: np.ndarray, parts: int, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each part's number and its keys with their values; keys are in order."""
    for p, a, z in ranges(keys, parts):
        yield p, squeezed(keys[a:z], *(v[a:z] for v in values))


def gathered(answers: list[bytes]) -> list[np.ndarray]:
    """A block's answers from all parts, in the order of its keys."""
    return [np.concatenate(x) for x in zip(*map(opened, answers), strict=True)]


def runs(it, keys: int):
    """Runs of rows of equal leading columns, from batches in order of them."""
    run: list[tuple] = []
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run and run[-1][:keys] != row[:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def for_blocks(blocks: DataFrame, column: str, answers: list[DataFrame], act: Callable[[int, dict, bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What act(b, answers by kind, the block's column) yields for each block: answers go to the blocks' buckets, blocks stay where they are."""
    own = blocks.select("b", F.col(column).alias("data"))
    if not answers:

        def alone(it):
            for batch in it:
                for k in range(batch.num_rows):  # one block at a time is copied
                    yield from act(batch.column(0)[k].as_py(), {}, batch.column(1)[k].as_py())

        return own.mapInArrow(alone, schema)
    every = answers[0]
    for a in answers[1:]:
        every = every.union(a)

    def run(one: pa.Table, theirs: pa.Table) -> pa.Table:
        got: dict[int, list[bytes]] = {}
        for _, kind, _, data in sorted(zip(*(c.to_pylist() for c in theirs.columns), strict=True), key=lambda r: r[1:3]):
            got.setdefault(kind, []).append(data)
        return pa.Table.from_batches(list(act(one.column("b")[0].as_py(), got, one.column("data")[0].as_py())))

    sent = every.filter("b >= 0").select("b", "kind", "p", "data")
    return own.groupBy("b").cogroup(sent.groupBy("b")).applyInArrow(run, schema)


QUESTIONS = "kind int, p long, b long, data binary"


def questions(b: int, kind: int, parts: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    p, data = list(zip(*parts, strict=True)) or ((), ())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(p), pa.int32()), pa.array(p, pa.int64()), pa.array([b] * len(p), pa.int64()), pa.array(data, pa.binary())], names=["kind", "p", "b", "data"])


def answered(asked: DataFrame, parts: int, by: dict[int, Callable[[list[bytes]], tuple[list[bytes], int]]]) -> DataFrame:
    """kind, b, p, data: by[kind] gives the answers to the questions about a part's keys, and a number to be added up (in the rows of b = -1)."""

    def run(it):
        for rows in runs(it, 2):
            kind, p = rows[0][:2]
            data, n = by[kind]([r[3] for r in rows])
            k = len(data) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * k, pa.int32()), pa.array([*(r[2] for r in rows), -1], pa.int64()), pa.array([p] * k, pa.int64()), pa.array([*data, b""], pa.binary()), pa.array([0] * (k - 1) + [n], pa.int64())],
                names=["kind", "b", "p", "data", "n"],
            )

    return cut(asked.repartition(parts, "kind", "p").sortWithinPartitions("kind", "p", "b").mapInArrow(run, "kind int, b long, p long, data binary, n long"))
