"""Source divergence audit: how the sources of a language differ in the words they use.

Terms become integers. One pass counts, for each language and source, a task's terms
and the documents that have them; Spark adds the counts up and deals them out by
ranges of (language, term). Each range is read in order, in chunks of at most `chunk`
kept terms (those in `least` documents of the language or more): a chunk's kept terms
are a sorted array, a row's term is found in it by searchsorted, and bincount makes
the dense vector of each source. Spark compares strings by their UTF-8 bytes, so ids
are in UTF-8 order: of two terms with equal values the one of smaller id comes first.

The sources of a language are cut into blocks of `BLOCK`; a task compares two blocks
over one chunk, and the sums over chunks are added up by Spark. So no task holds a
language's dictionary, nor a source that a third of all rows has, and the number of
sources may be any. All arithmetic is on integers and exact, up to 9 * 10**15 terms of
a language: p = 1 + floor(10**9 * (count + 2) / (N + 2 V)) is found by long division.

Defined results: null text, lang or source is ''; a document without terms has its
group all the same; repeated rows count each; a language without kept terms gives 0
for each pair and no terms; a lone source has no pairs; an empty table gives no rows;
only the columns text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut

#: What ends a term (ASCII characters but letters) as a space, and A-Z in lower case.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms and (on average) sources of a block that a task compares at once; numbers of a chunk's vectors together; terms that a task counts before it passes them on.
CHUNK, BLOCK, DENSE, HELD = 1 << 14, 64, 1 << 23, 400_000
#: Parts a probability is counted in, and the kinds of a chunk's rows.
UNIT, OWN, WHOLE = 10**9, 0, 1


def terms(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents): of all rows of docs, and a row with term '' for each group."""

    def rows(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            words = [*n, b""]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(words)), pa.repeat(source, len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(df.__getitem__, n), 0], pa.int64())],
                names=["lang", "source", "term", "n", "df"],
            )

    def run(it):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches(it, 4 << 20):
            for text, *group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, df = held.setdefault(tuple(group), (Counter(), Counter()))
                words, before = terms(text), len(n)
                n.update(words)
                df.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    parts = own.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def numbers(a: np.ndarray) -> bytes:
    return a.astype("<i8").tobytes()


def chunks(counts: DataFrame, least: int, chunk: int) -> DataFrame:
    """lang, chunk (its number), kind, source, v (its kept terms), vector (the counts of one source, n their sum; WHOLE: those of the language, with the terms' names).

    The counts are dealt out by ranges of (lang, term), so a term's rows are together, and read in order.
    """

    class Open:
        """The rows of a language since its last chunk."""

        def __init__(self, lang: str):
            self.lang, self.kept, self.terms, self.sources, self.of, self.n = lang, 0, [], {}, [], []

        @property
        def full(self) -> bool:
            return self.kept >= chunk or self.kept * len(self.sources) >= DENSE

        def add(self, term: str, rows: list[tuple]) -> None:
            """A kept term with its rows (source, n)."""
            self.kept += 1
            for source, n in rows:
                self.terms.append(term)
                self.of.append(self.sources.setdefault(source, len(self.sources)))
                self.n.append(n)

        def closed(self, number: int) -> pa.RecordBatch:
            names = np.array(sorted({t.encode() for t in self.terms}), object)  # the chunk's dictionary
            ids = np.searchsorted(names, np.array([t.encode() for t in self.terms], object))
            of, n, v = np.array(self.of), np.array(self.n, np.int64), len(names)
            order = np.argsort(of, kind="stable")
            own = np.split(order, np.searchsorted(of[order], np.arange(1, len(self.sources))))
            vectors = [self.dense(ids[x], n[x], v) for x in own]
            k = len(vectors) + 1
            return pa.RecordBatch.from_arrays(
                [pa.repeat(self.lang, k), pa.repeat(number, k), pa.array([OWN] * (k - 1) + [WHOLE], pa.int32()), pa.array([*self.sources, None]), pa.repeat(v, k),
                 pa.array([int(x.sum()) for x in (*vectors, sum(vectors))]), pa.array([*map(numbers, vectors), numbers(sum(vectors))], pa.binary()), pa.array([None] * (k - 1) + [b"\0".join(names)], pa.binary())],
                names=["lang", "chunk", "kind", "source", "v", "n", "vector", "names"],
            )

        @staticmethod
        def dense(ids: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
            """bincount, in two halves so that its sums in doubles are exact."""
            high, low = np.divmod(n, 1 << 30)
            return (np.bincount(ids, high, v).astype(np.int64) << 30) + np.bincount(ids, low, v).astype(np.int64)

    def run(it):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        now, term, rows, df = None, None, [], 0

        def ended() -> None:
            if df >= least:
                now.add(term, rows)

        for b in it:
            for lang, source, word, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or (lang, word) != (now.lang, term):
                    if now is not None:
                        ended()
                        if now.kept and (now.full or lang != now.lang):
                            yield now.closed(number)
                            number += 1
                            now = None
                    if now is None or lang != now.lang:
                        now = Open(lang)
                    term, rows, df = word, [], 0
                rows.append((source, n))
                df += d
        if now is not None:
            ended()
            if now.kept:
                yield now.closed(number)

    ranged = counts.filter("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ranged.select("lang", "source", "term", "n", "df").mapInArrow(run, "lang string, chunk long, kind int, source string, v long, n long, vector binary, names binary")


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (n + 2 v)) for the counts of groups (rows) with their sums n."""
    below = (n + 2 * v)[:, None]
    whole, rest = np.divmod(counts + 2, below)
    for _ in range(3):  # three digits of base 1000
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def units(made: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of each (lang, chunk, i, j), i <= j: the sources of blocks i and j with their vector there (none: no counts), sums and the language's
    numbers; one chunk of no terms for each language, so that all its pairs come up."""
    whole = made.filter(F.col("kind") == WHOLE)
    langs = counts.filter("term = ''").groupBy("lang").agg(F.floor((F.count("*") - 1) / BLOCK + 1).alias("blocks"))
    langs = langs.join(whole.groupBy("lang").agg(F.sum("v").alias("all_v"), F.sum("n").alias("all_n")), "lang", "left").na.fill(0)
    sums = made.filter(F.col("kind") == OWN).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    own = counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang")
    own = own.select("lang", "source", "n", "all_v", "blocks", F.pmod(F.xxhash64("source"), "blocks").alias("block"))
    groups = cut(own.union(langs.select("lang", F.lit(None).cast("string"), "all_n", "all_v", "blocks", F.lit(-1).cast("long"))))

    # every group meets every chunk of its language, in shares of the chunks: these rows are the vectors, with those that are nothing but zeros
    every = whole.select("lang", "chunk", "v").union(langs.select("lang", F.lit(-1).cast("long"), F.lit(0).cast("long")))
    shares_of = groups.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    meets = shares_of.join(every.withColumn("share", F.pmod("chunk", F.lit(32))), ["lang", "share"]).drop("share")
    there = (F.col("m.lang") == F.col("x.lang")) & (F.col("m.chunk") == F.col("x.chunk")) & F.col("m.source").eqNullSafe(F.col("x.source"))
    dense = meets.alias("m").join(made.alias("x"), there, "left").select("m.*", "x.vector", "x.names")
    # block k stands in the pairs (0, k) ... (k, k) ... (k, last); the language's own row in all (k, k)
    pairs = F.expr("transform(sequence(0L, blocks - 1), o -> IF(block < 0, struct(o AS i, o AS j), struct(least(o, block) AS i, greatest(o, block) AS j)))")
    placed = dense.withColumn("u", F.explode(pairs)).select("lang", "chunk", "u.i", "u.j", "block", "source", "n", "all_v", "v", "vector", "names")
    return placed.repartition("lang", "chunk", "i", "j").sortWithinPartitions("lang", "chunk", "i", "j", "block", "source")


def audit(docs: DataFrame, least: int = 10, top: int = 10, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank, as the audit's report has them."""
    counts = cut(term_counts(docs))
    made = cut(chunks(counts, least, chunk))

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The rows (i, j, block, source, n, all_v, v, vector, names) of one unit."""
        (i, j), (all_v, v) = rows[0][:2], rows[0][5:7]
        vector = lambda r: np.frombuffer(r[7], "<i8") if r[7] is not None else np.zeros(v, np.int64)
        own = [r for r in rows if r[2] >= 0]
        if not own:  # no source has a hash of this block
            return
        p = shares(np.stack([vector(r) for r in own]), np.array([r[4] for r in own]), all_v) if v else np.zeros((len(own), 0), np.int64)
        right = [k for k, r in enumerate(own) if r[2] == j]
        sources, out = [r[3] for r in own], []
        for a in (k for k, r in enumerate(own) if r[2] == i):
            others = [k for k in right if k > a]
            for k, f in zip(others, gaps(p[a], p[others]).sum(axis=1).tolist(), strict=True):
                out += [(sources[a], sources[k], f, -1), (sources[k], sources[a], f, -1)]
        if i == j and v:
            (whole,) = (r for r in rows if r[2] < 0)
            names, q = whole[8].split(b"\0"), shares(vector(whole)[None], np.array([whole[4]]), all_v)[0]
            for a, r in enumerate(own):
                ids = np.flatnonzero((vector(r) > 0) & (p[a] > q))
                f = gaps(p[a, ids], q[ids])
                best = np.lexsort((ids, -f))[:top]
                out += [(sources[a], names[i].decode(), x, 0) for i, x in zip(ids[best].tolist(), f[best].tolist(), strict=True)]
        for at in range(0, len(out), 50_000):
            yield out[at : at + 50_000]

    def run(it):
        def done(key, rows):
            for out in compared(rows):
                source, item, value, kind = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(out)), pa.array(source), pa.array(["pair" if k < 0 else "term" for k in kind]), pa.array(item), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

        key, rows = None, []
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:4] != key:
                    if rows:
                        yield from done(key, rows)
                    key, rows = row[:4], []
                rows.append(row[2:])
        if rows:
            yield from done(key, rows)

    found = cut(units(made, counts).mapInArrow(run, "lang string, source string, part string, item string, value long"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
