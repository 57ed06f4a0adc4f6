"""Substring dedup: words that a window of `width` words seen earlier covers are removed.

A window is a text's `width` consecutive words; it repeats another if the words are the
same. A window's first occurrence is that of the smallest doc_id, there of the smallest
start; every other occurrence loses all the words that it covers. Windows are judged on
the input, so what is removed does not depend on what else is.

Most windows occur once, and a count-min sketch finds nearly all of those: each block of
documents counts its windows in `ROWS` rows of cells by two hashes and sends its sketch
in parts (the cells that it counts in, as steps from one to the next: some 13 bits for a
window and row); parts are merged by adding up, and each block gets back which of its
cells are above one. A window's estimate, the least of its cells, is never too small, so a
window whose estimate is one occurs once. A row has `SPARE` times as many cells as there
are windows in all, at every size, so few others pass.

The second pass groups exactly what passes: a block asks with the 128-bit names of its
windows, and the places of their first occurrences in it, and learns which are first of
all. A passage that all documents have is asked once by each block. Coverage, the words
that are kept and their digest are worked out in the block.

Defined results: null or empty text has no words; repeated rows are judged each: rows
that share a doc_id count as one document, so of equal starts in them all are first; a
null doc_id comes after all others; an empty table gives no rows; only the columns
doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import QUESTIONS, answered, dealt, for_blocks, forget, in_blocks, opened, parts_of, questions, ranges, squeezed
from .common import cut, drop, keep_docs
from .jaccard_join import mix
from .token_counts import strings

#: Rows of the sketch and cells of a row for each window.
ROWS, SPARE = 2, 8
#: Kinds of questions: the sketch's rows (from 0 on), windows by name.
WINDOWS = 9
#: A null doc_id's place in the order of ids.
LAST = np.iinfo(np.int64).max


def packed(rows: list[tuple], width: int) -> tuple:
    """data of a block's rows (doc_id, text): its distinct words, the documents' words as places among them, ids and whether they have one; and its windows."""
    texts = [text.encode().split() for _, text in rows]  # at ASCII white space
    lens = np.array([len(w) for w in texts], np.int64)
    own = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    ids = np.fromiter((own[w] for t in texts for w in t), np.uint32, int(lens.sum()))
    doc = np.array([LAST if d is None else d for d, _ in rows], np.int64)
    named = np.array([d is not None for d, _ in rows], np.uint8)
    size = np.fromiter(map(len, own), np.uint32, len(own))
    data = squeezed(size, np.frombuffer(b"".join(own), np.uint8), ids, lens, doc, named)
    return data, int(np.maximum(lens - width + 1, 0).sum())


class Block:
    """A block's words and windows: start has the windows' first words, at their places in the document, names two hashes of each."""

    def __init__(self, data: bytes, width: int):
        import xxhash

        size, chars, ids, self.lens, self.doc, self.named = opened(data)
        self.words, self.ids, self.width = strings(size, chars), ids.astype(np.int64), width
        self.begin = np.cumsum(self.lens) - self.lens
        n = np.maximum(self.lens - width + 1, 0)
        self.of = np.repeat(np.arange(len(self.lens)), n)
        self.at = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        self.start = self.begin[self.of] + self.at
        keys = (np.fromiter(map(digest, self.words), np.uint64, len(self.words)) for digest in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest))
        self.names = [self.hashed(k) for k in keys]

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        """A hash of each window's words, in order, from hashes of words: runs of 1, 2, 4, ... words are joined to longer ones."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        run, length, out, done = keys[self.ids], 1, None, 0
        while True:
            if self.width & length:
                part = run[self.start + done]
                out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
                done += length
            if done == self.width:
                return out
            run = mix(run * np.uint64(0xBF58476D1CE4E5B9) + np.concatenate([run[length:], run[:length]]) + np.uint64(length))
            length *= 2

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct cells that the windows count in, in a row of the sketch (top bits of 64, in order); each window's place among them; counts."""
        low = np.uint64(64 - bits)
        return np.unique(mix(self.names[row] + np.uint64(row + 1)) >> low << low, return_inverse=True, return_counts=True)

    def sketch(self, row: int, bits: int, parts: int):
        """The block's sketch in parts: cells as steps, and counts up to two."""
        cells, _, n = self.cells(row, bits)
        places, n = cells >> np.uint64(64 - bits), np.minimum(n, 2).astype(np.uint8)
        for p, a, z in ranges(cells, parts):
            steps = np.diff(places[a:z])
            yield p, squeezed(places[a : a + 1], steps.astype(np.uint32 if not len(steps) or steps.max() >> np.uint64(32) == 0 else np.uint64), n[a:z])

    def passed(self, got: dict, bits: int) -> np.ndarray:
        """The windows whose estimate is above one."""
        over = np.ones(len(self.start), bool)
        for row in range(ROWS) if len(over) else ():
            over &= flags(got[row])[self.cells(row, bits)[1]]
        return np.flatnonzero(over)

    def candidates(self, got: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that pass, in order of name, then of (doc_id, start); where names begin; each window's name's number."""
        w = self.passed(got, bits)
        w = w[np.lexsort((self.at[w], self.doc[self.of[w]], self.names[1][w], self.names[0][w]))]
        a, b = self.names[0][w], self.names[1][w]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(w)]
        return w, np.flatnonzero(new), np.cumsum(new) - 1

    def removed(self, got: dict, bits: int) -> np.ndarray:
        """Whether each word of the block goes."""
        w, begin, name = self.candidates(got, bits)
        covered = np.zeros(len(self.ids) + 1, np.int64)
        if len(w):
            first = w[begin[name]]
            stays = flags(got[WINDOWS])[name] & (self.doc[self.of[w]] == self.doc[self.of[first]]) & (self.at[w] == self.at[first])
            np.add.at(covered, self.start[w[~stays]], 1)
            np.add.at(covered, self.start[w[~stays]] + self.width, -1)
        return np.cumsum(covered)[:-1] > 0


def flagged(yes: np.ndarray) -> bytes:
    return squeezed(np.array([len(yes)]), np.packbits(yes))


def flags(answers: list[bytes]) -> np.ndarray:
    """What flagged() had, of all parts."""
    return np.concatenate([np.unpackbits(bits)[: n[0]] for n, bits in map(opened, answers)]).astype(bool)


def merged(data: list[bytes]) -> tuple[list[bytes], int]:
    """Sketches of blocks added up: which of its cells are above one, for each."""
    asked = [(np.cumsum(np.concatenate([first, steps.astype(np.uint64)])), n) for first, steps, n in map(opened, data)]
    cells, n = (np.concatenate(x) for x in zip(*asked, strict=True))
    _, place, total = np.unique(cells, return_inverse=True, return_counts=True)  # as often as blocks have it
    over = (np.bincount(place, n, len(total)) > 1)[place]
    ends = np.cumsum([len(c) for c, _ in asked])
    return [flagged(x) for x in np.split(over, ends[:-1])], int(len(total))


def firsts(data: list[bytes]) -> tuple[list[bytes], int]:
    """Of each asker's windows (name in two halves, doc_id, start), whether they are the first of their name over all askers."""
    asked = [opened(d) for d in data]
    a, b, doc, at = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.lexsort((at, doc, b, a))
    a, b, doc, at = a[order], b[order], doc[order], at[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(a), bool)
    out[order] = (doc == doc[first]) & (at == at[first])
    ends = np.cumsum([len(x[0]) for x in asked])
    return [flagged(x) for x in np.split(out, ends[:-1])], 0


def dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word and the one after the last, from 0, of what goes) and kept (the words that stay, joined by spaces)."""
    blocks = in_blocks(keep_docs(docs), lambda rows: packed(rows, width), "data binary, n long", ["data", "n"])
    total, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts, bits = parts_of(total, count), max(8, (SPARE * total - 1).bit_length())

    def ask_sketch(b: int, got: dict, data: bytes):
        x = Block(data, width)
        for row in range(ROWS):
            yield questions(b, row, x.sketch(row, bits, parts))

    def ask_windows(b: int, got: dict, data: bytes):
        x = Block(data, width)
        w, begin, _ = x.candidates(got, bits)
        w = w[begin]
        yield questions(b, WINDOWS, dealt(x.names[0][w], parts, x.names[1][w], x.doc[x.of[w]], x.at[w].astype(np.uint32)))

    def keep(b: int, got: dict, data: bytes):
        x = Block(data, width)
        gone = x.removed(got, bits)
        kept, spans, n = [], [], []
        for begin, size in zip(x.begin.tolist(), x.lens.tolist(), strict=True):
            mine = gone[begin : begin + size]
            kept.append(b" ".join([x.words[k] for k in x.ids[begin : begin + size][~mine].tolist()]).decode())
            edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            spans.append([{"first": a, "after": z} for a, z in edges.reshape(-1, 2).tolist()])
            n.append(int(mine.sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.doc, mask=x.named == 0), pa.array(x.lens), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "spans", "kept"],
        )

    sketch = answered(for_blocks(blocks, "data", [], ask_sketch, QUESTIONS), parts, dict.fromkeys(range(ROWS), merged))
    exact = answered(for_blocks(blocks, "data", [sketch], ask_windows, QUESTIONS), parts, {WINDOWS: firsts})
    done = cut(for_blocks(blocks, "data", [sketch, exact], keep, "doc_id long, n_words long, n_removed long, spans array<struct<first:long,after:long>>, kept string"))
    drop(sketch, exact)
    forget(blocks)
    return done
