"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-two-fit: a sequence is filled greedily with the longest pieces that fit;
then its smallest piece is exchanged for two unpacked pieces that fill the
widened gap more tightly, as long as that helps.

Lengths are whole numbers up to the sequence length, so the plan is made on
their histogram (at most `size` rows, whatever the corpus holds): each step
finds one filling and repeats it as often as its lengths last. Pieces then take
the plan's places by their rank among the pieces of their length. Ranks are
counted within salted parts of a length class, so that a length which a third
of all pieces have is ranked by many tasks.

Defined results: null or empty text is one piece, the end id alone; a null
doc_id is kept; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, keep_docs

#: Word table of a task: entries, and the longest word kept.
TABLE_ENTRIES, LONGEST_KEPT = 400_000, 64
#: Pieces of one length that one task ranks.
RANKED_TOGETHER = 20_000
SPACES = re.compile("[ \n]+")
# Texts of these characters alone are normalised by lower-casing them, and cut into words by WORDS.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r]+")
# The tokenizer's pattern, of which WORDS is the part for plain texts.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_marks() -> dict[int, str]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


def cuts_as_words(spec: str) -> bool:
    """Whether a tokenizer normalises and cuts plain texts as PLAIN and WORDS say."""
    t = json.loads(spec)
    kinds = [x["type"] for x in (t["normalizer"] or {}).get("normalizers", [])]
    first, *rest = (t["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    byte = bool(rest) and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
    return kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") is True and byte and len(rest) == 1 and t["post_processor"] is None


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers, each word encoded once.

    For tokenizers whose pre-tokenizer drops white space and never crosses it,
    as word_bpe_49k.json does: the ids of a text are those of its words in order.
    A plain text's words are cut here and given to the tokenizer's model; of
    other texts what stands between spaces is given to the whole tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.plain, self.between = cuts_as_words(spec), {}
        self.added = re.compile("|".join(re.escape(x["content"]) for x in json.loads(spec)["added_tokens"]) or "(?!)")
        self.marks = str.maketrans({chr(b): c for b, c in byte_marks().items()})

    def __missing__(self, word: str) -> bytes:
        marks = word if word.isascii() else word.encode().decode("latin-1").translate(self.marks)
        ids = np.array([t.id for t in self.model.tokenize(marks)], "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.plain and PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text.lower())))
        words = SPACES.split(text)
        new = list({w for w in words if w not in self.between})
        got = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}
        out = b"".join(self.between[w] if w in self.between else got[w] for w in words)
        if len(self.between) + len(got) > TABLE_ENTRIES:
            self.between.clear()
        self.between.update((w, x) for w, x in got.items() if len(w) <= LONGEST_KEPT)
        return out


def pieces(docs: DataFrame, spec: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents with their end id, the longer ones cut."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(it):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table, end = WordIds(shared.value), np.asarray([end_id], "<u4").tobytes()
        for b in batches(it, 4 << 20):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = table.of(text) + end
                n = len(ids) // 4
                rows += [(doc, k, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)])) for k, at in enumerate(range(0, n, size))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return keep_docs(docs).mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Fillings (lengths in order) and how many sequences have each; uses every piece once."""
    left, lengths = dict(histogram), sorted(k for k, n in histogram.items() if n > 0)
    out = []
    while lengths:
        fill: dict[int, int] = {lengths[-1]: 1}
        gap = size - lengths[-1]
        at = bisect_right(lengths, gap) - 1
        while at >= 0:  # the longest that fits, as often as it fits
            x = lengths[at]
            n = min(gap // x, left[x] - fill.get(x, 0))
            if n:
                fill[x] = fill.get(x, 0) + n
                gap -= n * x
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        while gap and (two := better_two(lengths, left, fill, gap)):
            s, a, b = two
            gap += s - a - b
            fill[s] -= 1
            fill[a] = fill.get(a, 0) + 1
            fill[b] = fill.get(b, 0) + 1
            fill = {k: n for k, n in fill.items() if n}
        times = min(left[k] // n for k, n in fill.items())
        out.append(([k for k in sorted(fill, reverse=True) for _ in range(fill[k])], times))
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del lengths[bisect_right(lengths, k) - 1]
    return out


def better_two(lengths: list[int], left: dict[int, int], fill: dict[int, int], gap: int) -> tuple[int, int, int] | None:
    """The smallest piece, and the two unpacked lengths that fill its widened gap best, if better than it does."""
    s = min(fill)
    free = lambda k, n: left[k] - fill.get(k, 0) >= n
    lo, hi, best, room = 0, bisect_right(lengths, s + gap) - 1, None, s + gap
    most = s
    while lo <= hi:
        a, b = lengths[lo], lengths[hi]
        if a + b > room or not free(b, 1):
            hi -= 1
        elif not free(a, 1 + (a == b)):
            lo += 1
        else:
            if a + b > most:
                most, best = a + b, (s, a, b)
                if most == room:
                    break
            lo += 1
    return best


def pack(docs: DataFrame, spec: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of docs with its sequence_id and its offset there; offsets have no gaps."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, spec, size, end_id))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    used, sequence = dict.fromkeys(histogram, 0), 0
    for fill, times in plan(histogram, size):
        offset = 0
        for x in fill:
            slots.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    slots.sort()
    arrays = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 4).T.copy())

    salts = spark.createDataFrame([(k, -(-n // RANKED_TOGETHER)) for k, n in sorted(histogram.items())], "length long, salts long")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # an order of all that a row has: rows that tie are alike, so a task that runs again places the same rows
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))

    def place(it):
        x, lo, seq, off = arrays.value
        for b in it:
            c = {n: b.column(n) for n in b.schema.names}
            length, rank = c["length"].to_numpy(), c["rank"].to_numpy()
            at = np.zeros(len(length), np.int64)
            order = np.lexsort((rank, length))
            for k in np.unique(length):  # the places of a length are in order of rank
                mine = order[np.searchsorted(length[order], k) : np.searchsorted(length[order], k, "right")]
                a, z = np.searchsorted(x, k), np.searchsorted(x, k, "right")
                at[mine] = a + np.searchsorted(lo[a:z], rank[mine], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(c[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq[at] + rank - lo[at]), pa.array(off[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(
        place, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumn("piece", F.col("piece").cast("int"))
