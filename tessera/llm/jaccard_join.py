"""Shingle-set Jaccard join by an R-tree over count vectors.

A document's word shingles are hashed into groups; the counts per group are a
point. For two sets, the sum of the coordinate minima of their points is at
least the size of their intersection, so a pair whose sum is too small for the
threshold can't link; an R-tree over the points bounds whole boxes the same way.
Pairs that survive are verified on their sets of 64-bit shingle hashes.

The join over a cluster:

1. One pass over the texts. Documents with equal sets form one class; only
   classes go on.
2. Sets that link differ in few shingles, d at most, and each of those changes one
   group. Of m groups (m depends on the set's size class, and a set near the lower
   end of its class is also dealt out as one of the class below) two such sets
   agree in at least m - d, so they share one of their first d + 1 groups in any
   common order. The fullest groups come first. A key is a group's number and
   content: it stands for several shingles at once, so passages that many documents
   share draw hardly any texts together, and no frequencies need to be known.
   Classes meet under their keys; what meets nobody is done.
3. Classes that keys connect, directly or through others, form a family, which holds
   all links of its members. A family of bounded size is one block: one task joins
   its sets through an R-tree, labels its components and counts its links.
4. Larger families go in rounds of blocks: each class goes once to the block of the
   first key under which classes meet that aren't merged yet. A block's task joins
   its sets through an R-tree and merges what links, comparing only classes that aren't
   merged yet, so a group of copies costs about one comparison per member. Large
   blocks are split, by another hash in each round. Of keys with the same classes,
   which copies give, one is kept. Components so far label the classes. Keys where
   several labels meet give the other pairs, in the same way but with every class of
   these keys, in cells of bounded size (the classes of a key, or of all keys that hang
   together if that takes fewer rows, are dealt into chunks and each pair of chunks is a cell). Every link then lies within a component: each
   component's classes are compared once more, in cells, and their links counted.

Pairs are compared where they meet and are never emitted.

Defined results: null or empty text (no words) has an empty set and links with
nothing; a null doc_id takes no part and has a null component and no links; rows
that repeat a doc_id count as further texts under that name; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, drop, keep_docs
from .components import connected_components

#: Groups of a point: a power of two, about an eighth of the set's size between these.
FEWEST, MOST = 64, 1024
#: Shingles of a block's task or a cell's chunk, classes of a family's block or a chunk, classes that a broadcast may name.
BLOCK_SHINGLES, CELL, NAMED = 1_000_000, 4000, 100_000
#: Rounds of blocks.
ROUNDS = 2
FAN = 32
NO_KEYS = np.empty(0, np.int64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than width are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
    return np.unique(out)


def name_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def point(s: np.ndarray) -> bytes:
    """Counts per group, as bytes if all fit and 32-bit numbers if not."""
    d = FEWEST
    while d < MOST and 8 * d < len(s):
        d *= 2
    c = np.bincount((s >> np.uint64(17)).astype(np.int64) & (d - 1), minlength=d)
    return bytes([int(c.max(initial=0) > 255)]) + c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint32).tobytes()


def counts(encoded: bytes) -> np.ndarray:
    return np.frombuffer(encoded, np.uint32 if encoded[0] else np.uint8, offset=1).astype(np.int32)


def differing(total: int, num: int, den: int) -> int:
    """The most shingles that are in one of two linking sets alone, if they have `total` in all."""
    return (den - num) * total // (den + num)


def keys_of(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of which every two linking, different sets share one.

    Sets of 2^j to 2^(j+1) - 1 shingles are in size class j, and also dealt out as
    members of a class below where they can link with a set of that class.
    """
    n, out = len(s), []
    j = n.bit_length() - 1
    while j >= 0:
        top = 2 ** (j + 1) - 1
        if n > top * den // num:
            break
        d = differing(n + min(top, n * den // num) if n > top else n + n * den // num, num, den)
        if d:
            most = differing(top + top * den // num, num, den)
            m = most + most // 4 + 1
            group = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            size = np.bincount(group, minlength=m)
            ends = np.cumsum(size)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])
            key = mix((sums[ends] - sums[ends - size]) + mix(np.arange(m, dtype=np.uint64) + np.uint64(j << 40)))
            out.append(key[np.lexsort((key, -size))[: d + 1]])
        j -= 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Overlaps:
    """Which of a list of sets link, by marking one set's shingles among those of all."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.n = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.n)
        distinct, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int32)

    def linking(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the places `others` whose sets link with the one at i."""
        n, m = self.n[i], self.n[others]
        others = others[(self.den * m >= self.num * n) & (self.num * m <= self.den * n)]
        if not len(others):
            return others
        own = self.at[self.ends[i] - n : self.ends[i]]
        self.mark[own] = 1
        begin = np.concatenate([[0], np.cumsum(self.n[others])])
        held = np.concatenate([self.at[self.ends[k] - self.n[k] : self.ends[k]] for k in others.tolist()])
        same = np.add.reduceat(self.mark[held], begin[:-1])
        self.mark[own] = 0
        return others[self.den * same >= self.num * (n + self.n[others] - same)]


class CountTree:
    """R-tree over points, packed in order of size and leading counts: leaves of FAN points, boxes over FAN leaves."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = np.lexsort((vectors[:, 1], vectors[:, 0], sizes))
        self.v, self.n = vectors[self.order], sizes[self.order]
        cuts = np.arange(0, len(self.n), FAN)
        self.leaf_top, self.leaf_low, self.leaf_high = np.maximum.reduceat(self.v, cuts), self.n[cuts], np.maximum.reduceat(self.n, cuts)
        tops = np.arange(0, len(cuts), FAN)
        self.box_top, self.box_low, self.box_high = np.maximum.reduceat(self.leaf_top, tops), self.leaf_low[tops], np.maximum.reduceat(self.leaf_high, tops)

    def passes(self, q, n, top, low, high) -> np.ndarray:
        """Whether the summed minima with `top` can reach what sets of n and at least `low` need."""
        fits = (self.den * high >= self.num * n) & (self.num * low <= self.den * n)
        return fits & ((self.num + self.den) * np.minimum(top, q).sum(1) >= self.num * (n + low))

    def near(self, q: np.ndarray, n: int) -> np.ndarray:
        """Places of the points whose pair with (q, n) the bound lets pass."""
        boxes = np.flatnonzero(self.passes(q, n, self.box_top, self.box_low, self.box_high))
        leaves = (boxes[:, None] * FAN + np.arange(FAN)).ravel()
        leaves = leaves[leaves < len(self.leaf_low)]
        leaves = leaves[self.passes(q, n, self.leaf_top[leaves], self.leaf_low[leaves], self.leaf_high[leaves])]
        at = (leaves[:, None] * FAN + np.arange(FAN)).ravel()
        at = at[at < len(self.n)]
        return self.order[at[self.passes(q, n, self.v[at], self.n[at], self.n[at])]]


class Near:
    """Trees over points of one number of groups and the next, which is folded to it."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        self.points, self.sizes, self.trees = points, sizes, {}
        self.wide = np.array([len(p) for p in points])
        for d in np.unique(self.wide).tolist():
            own = np.flatnonzero((self.wide == d) | (self.wide == 2 * d))
            folded = np.stack([points[k].reshape(-1, d).sum(0) for k in own.tolist()])
            self.trees[d] = own, CountTree(folded, sizes[own], num, den)

    def of(self, k: int) -> np.ndarray:
        """Places of the points whose pair with k's the bound lets pass, k's own among them."""
        p, d, n = self.points[k], int(self.wide[k]), int(self.sizes[k])
        own, tree = self.trees[d]
        found = own[tree.near(p, n)]
        if d // 2 in self.trees:
            own, tree = self.trees[d // 2]
            less = own[tree.near(p.reshape(-1, d // 2).sum(0), n)]
            found = np.concatenate([found, less[self.wide[less] < d]])
        return found


def runs_by_size(sizes: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Places in order of size, parted where no pair can link across; parts of one are left out."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    return [r for r in np.split(order, np.flatnonzero(den * n[:-1] < num * n[1:]) + 1) if len(r) > 1]


def merged(sets: list[np.ndarray], labels: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join what links among the sets, one per merge; those of equal labels are merged already."""
    sizes = np.array([len(s) for s in sets])
    out: list[tuple[int, int]] = []
    root = np.unique(labels, return_inverse=True)[1]
    for run in runs_by_size(sizes, num, den):
        if (root[run] == root[run[0]]).all():
            continue
        near = Near([counts(point(sets[k])) for k in run.tolist()], sizes[run], num, den)
        overlaps = Overlaps([sets[k] for k in run.tolist()], num, den)
        for at, i in enumerate(run.tolist()):
            now = root[run]
            if (now == now[0]).all():
                break
            others = near.of(at)
            for j in run[overlaps.linking(at, others[now[others] != now[at]])].tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
    return out


def resolved(sets: list[np.ndarray], copies: np.ndarray, links: bool, num: int, den: int) -> tuple[list[int], list[int]]:
    """For each set the first one of its component, and with links the copies of those that link with it."""
    root, counts = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    if links:
        counts = link_counts(sets, copies, np.zeros(len(sets)), False, num, den, root)
    else:
        for i, j in merged(sets, list(range(len(sets))), num, den):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root.tolist(), counts.tolist()


def link_counts(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, across: bool, num: int, den: int, root: np.ndarray | None = None) -> np.ndarray:
    """For each set the copies of those that link with it; across: only of those on the other side; root: merged on the way."""
    sizes, out = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64)
    for run in runs_by_size(sizes, num, den):
        near = Near([counts(point(sets[k])) for k in run.tolist()], sizes[run], num, den)
        overlaps = Overlaps([sets[k] for k in run.tolist()], num, den)
        for at, i in enumerate(run.tolist()):
            others = near.of(at)
            others = others[others > at]
            if across:
                others = others[side[run[others]] != side[i]]
            j = run[overlaps.linking(at, others)]
            out[i] += copies[j].sum()
            out[j] += copies[i]
            if root is not None and len(j):
                met = np.unique(root[[i, *j]])
                root[np.isin(root, met)] = met[0]
    return out


def groups(it, keys: int):
    """Runs of rows of equal leading columns, from batches in order of them, as lists of rows."""
    run: list[tuple] = []
    for b in batches(it, 8 << 20):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run and run[-1][:keys] != row[:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def longs(rows: list[tuple], names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def signatures(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, cls (name of the set), n, keys (those under which it must be looked for; once for the copies that a task meets)."""

    def run(it):
        hashes, seen = WordHashes(), set()
        for b in batches(it, 4 << 20):
            cls, n, keys = [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(t, width, hashes)
                cls.append(name_of(s))
                n.append(len(s))
                new = len(s) > 0 and doc_id is not None and cls[-1] not in seen
                keys.append(keys_of(s, num, den).view(np.int64) if new else NO_KEYS)
                if new:
                    seen.add(cls[-1])
            if len(seen) > NAMED:
                seen.clear()
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), lists], names=["doc_id", "cls", "n", "keys"])

    return docs.mapInArrow(run, "doc_id long, cls binary, n long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, copies, n, vec (the point) and shingles (the set) of wanted classes (doc_id, id, copies, cls)."""

    def run(it):
        hashes = WordHashes()
        for b in batches(it, 4 << 20):
            rows = []
            for at, copies, cls, text in zip(*(b.column(c).to_pylist() for c in ("id", "copies", "cls", "text")), strict=True):
                s = shingle_set(text, width, hashes)
                if name_of(s) == cls:  # rows may repeat a doc_id with another text
                    rows.append((at, copies, len(s), point(s), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "copies", "n", "vec", "shingles"])

    n = wanted.count()
    known = F.broadcast(wanted) if n <= NAMED else wanted
    out = cut(docs.join(known, "doc_id").select("id", "copies", "cls", "text").mapInArrow(run, "id long, copies long, n long, vec binary, shingles binary"))
    if out.count() == n:
        return out
    once = cut(out.dropDuplicates(["id"]))  # whole rows are repeated
    drop(out)
    return once


def unpacked(shingles: bytes) -> np.ndarray:
    return np.frombuffer(shingles, np.uint64)


def in_cells(rows: DataFrame, group: str, chunks: str) -> DataFrame:
    """rows with cell and side, each once for every pair of chunks that its own is in; a group's rows are dealt into chunks by id."""
    one = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col(chunks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1)))
    return one.withColumn("cell", F.least("mine", "other") * F.col(chunks) + F.greatest("mine", "other")).withColumn("side", (F.col("mine") > F.col("other")).cast("long")).withColumn("across", (F.col("mine") != F.col("other")).cast("long"))


def jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with links, n_links (documents that it links with itself):
    documents link when den * |A and B| >= num * |A or B|, for thresholds from 1/2 to 1."""
    if not 0 < num <= den <= 2 * num:
        raise ValueError(f"threshold {num}/{den} is not from 1/2 to 1: points are compared over two widths")
    docs = keep_docs(docs)
    found = cut(signatures(docs, width, num, den).withColumn("at", F.monotonically_increasing_id()))
    # one row for each class, also where rows are repeated
    first = found.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "at", "n")).alias("x"), F.count("*").alias("copies"))
    classes = cut(first.select("cls", "x.doc_id", F.col("x.at").alias("id"), "x.n", "copies"))
    # keys where classes meet, in one shuffle of them all: neither sets nor their lists of keys are moved
    under, key = found.select(F.xxhash64("cls").alias("c"), F.explode("keys").alias("h")), Window.partitionBy("h")
    met = under.select("h", "c", F.min("c").over(key).alias("lo"), F.max("c").over(key).alias("hi")).filter("lo < hi").select("h", "c").distinct()
    shared = cut(met.join(classes.select(F.xxhash64("cls").alias("c"), "id", "n"), "c").select("h", "id", "n"))
    every_set = sets_of(docs, classes.join(shared.select("id").distinct(), "id").select("doc_id", "id", "copies", "cls"), width)

    # 3: families of bounded size
    star = shared.join(shared.groupBy("h").agg(F.min("id").alias("b")), "h").filter("id > b").select(F.col("id").alias("a"), "b").distinct()
    member = connected_components(star).select(F.col("node").alias("id"), F.col("label").alias("family")).join(every_set.select("id", "n"), "id")
    size = member.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("all"))
    families = cut(member.join(size, "family").select("id", "family", ((F.col("members") <= CELL) & (F.col("all") <= BLOCK_SHINGLES)).alias("bounded")))

    def join_family(it):
        for run in groups(it, 1):
            root, linked = resolved([unpacked(r[3]) for r in run], np.array([r[2] for r in run]), links, num, den)
            yield longs([(r[1], run[k][1], n) for r, k, n in zip(run, root, linked, strict=True)], ["id", "label", "linked"])

    rows = families.filter("bounded").join(every_set.select("id", "copies", "shingles"), "id").select("family", "id", "copies", "shingles")
    small = cut(rows.repartition("family").sortWithinPartitions("family", "id").mapInArrow(join_family, "id long, label long, linked long"))
    large = families.filter("not bounded").select("id")
    if large.isEmpty():
        return finished(found, classes, small, links)
    sets = every_set.join(large, "id", "left_semi")
    before, shared = shared, cut(shared.join(large, "id", "left_semi"))
    drop(before)

    # 4: larger ones, in rounds of one block for each class
    def partnered(it):
        """The rows that have a partner of another label in their cell by the bound."""
        for run in groups(it, 2):
            sizes, names, rows = np.array([r[4] for r in run]), np.array([r[3] for r in run]), []
            for part in runs_by_size(sizes, num, den):
                if (names[part] == names[part[0]]).all():
                    continue
                near = Near([counts(run[k][5]) for k in part.tolist()], sizes[part], num, den)
                rows += [run[k][:4] for at, k in enumerate(part.tolist()) if (names[part[near.of(at)]] != names[k]).any()]
            if rows:
                yield longs(rows, ["block", "part", "id", "label"])

    def join_block(it):
        for run in groups(it, 2):
            if len(run) > 1 and (rows := [(run[i][2], run[j][2]) for i, j in merged([unpacked(r[4]) for r in run], [r[3] for r in run], num, den)]):
                yield longs(rows, ["a", "b"])

    def open_groups(labelled: DataFrame) -> DataFrame:
        """The rows of the keys where several labels meet, of keys of the same classes only one; df: the key's classes."""
        mark = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        mixed = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df"), *mark).filter("lo < hi")
        return cut(labelled.join(mixed.groupBy("df", "x1", "x2").agg(F.min("h").alias("h")).select("h", "df"), "h"))

    label, labels = F.coalesce("label", "id").alias("label"), None

    def now_labelled(rows: DataFrame) -> DataFrame:
        return rows.select("h", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").select("h", "id", "n", label)

    def compared(placed: DataFrame, bound_first: bool) -> DataFrame:
        """Links that merge what links in each (block, part), where a class may be in many, after a pass by the bound alone."""
        near = placed
        if bound_first:
            rows = placed.join(sets.select("id", "n", "vec"), "id").select("block", "part", "id", "label", "n", "vec")
            near = cut(rows.repartition("block", "part").sortWithinPartitions("block", "part", "id").mapInArrow(partnered, "block long, part long, id long, label long"))
        rows = near.join(sets.select("id", "shingles"), "id").select("block", "part", "id", "label", "shingles")
        out = cut(rows.repartition("block", "part").sortWithinPartitions("block", "part", "id").mapInArrow(join_block, "a long, b long"))
        if bound_first:
            drop(near)
        return out

    for turn in range(ROUNDS):
        # a key whose classes are all merged stays so: only the others are kept for what follows
        before, shared = shared, open_groups(shared.select("h", "id", "n", F.col("id").alias("label")) if labels is None else now_labelled(shared))
        drop(before)
        block = shared.groupBy("id").agg(F.min("h").alias("block"), F.max("label").alias("label"), F.max("n").alias("n"))
        all_of = block.groupBy("block").agg(F.sum("n").alias("all"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        placed = block.join(all_of, "block").select("id", "block", "label", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("all") / BLOCK_SHINGLES)).alias("part"))
        found_links = compared(placed, False)
        if labels is not None and found_links.isEmpty():
            break
        labels = cut(connected_components(found_links if labels is None else labels.toDF("a", "b").union(found_links)))

    # what else meets, in cells of bounded size: of each key, or of all classes that open keys connect, whichever takes fewer rows
    opened = open_groups(now_labelled(shared))
    ends = opened.groupBy("h", "df").agg(F.min("id").alias("b"))
    joint = connected_components(opened.join(ends.select("h", "b"), "h").filter("id > b").select(F.col("id").alias("a"), "b").distinct())
    joint = cut(joint.select("node", F.col("label").alias("family")).join(opened.groupBy(F.col("id").alias("node")).agg(F.max("n").alias("n"), F.max("label").alias("label")), "node"))
    parts = lambda count, n: F.greatest(F.ceil(F.col(count) / CELL), F.ceil(F.col(n) / BLOCK_SHINGLES)).cast("long")
    wide = joint.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("all")).withColumn("chunks", parts("members", "all"))
    keys = ends.join(joint.select(F.col("node").alias("b"), "family"), "b").withColumn("key_chunks", F.ceil(F.col("df") / CELL).cast("long"))
    cost = keys.groupBy("family").agg(F.sum(F.col("df") * F.col("key_chunks")).alias("by_key"))
    chosen = wide.join(cost, "family").select("family", "chunks", (F.col("members") * F.col("chunks") <= F.col("by_key")).alias("whole"))
    by_family = joint.join(chosen.filter("whole"), "family").select(F.col("family").alias("h"), F.col("node").alias("id"), "label", "chunks")
    by_key = opened.join(keys.join(chosen.filter("not whole"), "family").select("h", F.col("key_chunks").alias("chunks")), "h").select("h", "id", "label", "chunks")
    cells = in_cells(by_family.union(by_key), "h", "chunks")
    second = compared(cells.select(F.col("h").alias("block"), F.col("cell").alias("part"), "id", "label"), True)
    every = labels if second.isEmpty() else cut(connected_components(labels.toDF("a", "b").union(second)))
    drop(opened, shared)

    reached = every.select(F.col("node").alias("id"), "label")
    if links:
        counted = counted_links(reached.join(classes.select("id", "copies"), "id"), sets, num, den)
        reached = reached.join(counted, "id", "left").select("id", "label", F.coalesce("linked", F.lit(0)).alias("linked"))
    else:
        reached = reached.select("id", "label", F.lit(0).cast("long").alias("linked"))
    return finished(found, classes, small.union(reached), links)


def finished(found: DataFrame, classes: DataFrame, joined: DataFrame, links: bool) -> DataFrame:
    """Each document's component and links from those of the classes that have partners (id, label, linked)."""
    reached = classes.join(joined, "id", "left").select("cls", "doc_id", "copies", F.coalesce("label", "id").alias("label"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    least = reached.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = reached.join(least, "label").select("cls", "component_id", "n_links")
    named = F.col("doc_id").isNotNull()
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id")]
    if links:
        columns.append(F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return found.select("doc_id", "n", "cls").join(of, "cls", "left").select(*columns)


def counted_links(reached: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """id, linked: the copies of the other classes that a class (id, label, copies) links with itself, all within its label."""

    def count(it):
        for run in groups(it, 2):
            got = link_counts([unpacked(r[6]) for r in run], np.array([r[5] for r in run]), np.array([r[3] for r in run]), bool(run[0][4]), num, den)
            if rows := [(r[2], k) for r, k in zip(run, got.tolist(), strict=True) if k]:
                yield longs(rows, ["id", "linked"])

    per = reached.join(sets.select("id", "n"), "id").select("id", "label", "copies", "n")
    whole = per.groupBy("label").agg(F.count("*").alias("classes"), F.sum("copies").alias("whole"), F.sum("n").alias("all")).filter("classes > 1")
    per = cut(per.join(whole, "label"))
    pairs = per.filter("classes = 2").select("id", (F.col("whole") - F.col("copies")).alias("linked"))  # a component of two is a link
    chunks = F.greatest(F.ceil(F.col("classes") / CELL), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("long")
    cells = in_cells(per.filter("classes > 2").withColumn("chunks", chunks), "label", "chunks").join(sets.select("id", "shingles"), "id").select("label", "cell", "id", "side", "across", "copies", "shingles")
    more = cells.repartition("label", "cell").sortWithinPartitions("label", "cell", "id").mapInArrow(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))
    return cut(pairs.union(more))
