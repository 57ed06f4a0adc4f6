"""Token counts without token ids: count the pieces of each distinct pre-token once.

A pre-token is a run of spaces and the characters up to the next space. With a
piece vocabulary in which no piece has a space mark after another character,
no merge crosses a pre-token's start, so a text's count is the sum over its
distinct pre-tokens of frequency x pieces.

One pass over the texts gives each document's pre-token frequencies, in blocks of
documents that name each pre-token once. The blocks' pre-tokens are dealt out by
their hash; the task that gets one counts its pieces, once for the whole corpus, and
sends the count to the blocks that have it; there the counts are joined to the
frequencies and summed. Nothing is broadcast but the model, and no text's ids are
made: a pre-token's pieces are made once, for the corpus, and only counted.
Models whose pieces cross spaces are refused unless `whole` is set: then each whole
text is its own pre-token.

Defined results: null or empty text has 0 tokens and 0 bytes; a null doc_id is
kept; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import QUESTIONS, answered, dealt, for_blocks, forget, gathered, in_blocks, opened, parts_of, questions, squeezed
from .common import cut, keep_docs

SPACE = "▁"  # the pieces' mark of a space
CHUNK = re.compile(" +[^ ]*")
#: The kind of question.
PIECES = 1


def splits_at_spaces(model: bytes) -> bool:
    """Whether the model's counts add up over pre-tokens."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n = m.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    own = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)
    return plain and not own and not any(SPACE in p.piece.lstrip(SPACE) for p in m.pieces)


def pre_tokens(text: str) -> list[str]:
    """Each pre-token less its first space; the text's start counts as a space."""
    text = text.replace(SPACE, " ")
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    return [x[1:] for x in CHUNK.findall(" " + text)]


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def packed(rows: list[tuple], cut: bool) -> tuple:
    """names (the block's distinct pre-tokens in order of their hashes) and freqs (each document's places among them, as steps from one to the next, with how often)."""
    freqs = [Counter(pre_tokens(t) if cut else [t]) if t else Counter() for _, t in rows]
    words = [w.encode() for w in set().union(*freqs)]
    words = [words[k] for k in np.argsort(hashed(words), kind="stable").tolist()]
    place = {w.decode(): k for k, w in enumerate(words)}
    sizes = np.array([len(f) for f in freqs])
    at = np.fromiter((place[w] for f in freqs for w in f), np.int64)
    n = np.fromiter((k for f in freqs for k in f.values()), np.uint32)
    order = np.lexsort((at, np.repeat(np.arange(len(rows)), sizes)))
    at, n = at[order], n[order]
    steps = np.diff(at, prepend=0)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[begin] = at[begin]
    names = squeezed(np.array([len(w) for w in words], np.uint32), np.frombuffer(b"".join(words), np.uint8))
    docs = [sizes, np.array([d or 0 for d, _ in rows], np.int64), np.array([d is not None for d, _ in rows], np.uint8), np.array([len(t.encode()) for _, t in rows])]
    return names, squeezed(steps.astype(np.uint32), n, *docs), len(words)


def places(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What packed() had before it took steps."""
    run = np.cumsum(steps.astype(np.int64))
    begin = np.cumsum(sizes) - sizes
    some = sizes > 0
    return run - np.repeat(run[begin[some]] - steps[begin[some]], sizes[some])


def strings(lens: np.ndarray, chars: np.ndarray) -> list[bytes]:
    ends, raw = np.cumsum(lens).tolist(), chars.tobytes()
    return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def in_pre_tokens(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Blocks of docs (doc_id, text): b, names, freqs and n, the number of names."""
    return in_blocks(docs, lambda rows: packed(rows, not whole), "names binary, freqs binary, n long", ["names", "freqs", "n"])


def piece_counts(blocks: DataFrame, model: bytes, whole: bool = False) -> DataFrame:
    """The pieces of each block's pre-tokens, in order; n adds up to the pre-tokens that were encoded."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    parts = parts_of(*blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())

    def ask(b: int, got: dict, data: bytes):
        lens, chars = opened(data)
        ends = np.concatenate([[0], np.cumsum(lens.astype(np.int64))])
        begin, out = 0, []
        for p, part in dealt(hashed(strings(lens, chars)), parts):
            z = begin + len(opened(part)[0])
            out.append((p, squeezed(lens[begin:z], chars[ends[begin] : ends[z]])))
            begin = z
        yield questions(b, PIECES, iter(out))

    def count(data: list[bytes]) -> tuple[list[bytes], int]:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_proto=shared.value).encode
        asked = [strings(*opened(d)) for d in data]
        distinct = list(set().union(*asked))
        pieces = {}
        for at in range(0, len(distinct), 20_000):
            some = distinct[at : at + 20_000]
            pieces.update(zip(some, map(len, encode([w.decode() for w in some], num_threads=1)), strict=True))
        if not whole:
            pieces[b""] = 1  # a space by itself
        return [squeezed(np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))) for words in asked], len(distinct)

    return answered(for_blocks(blocks, "names", [], ask, QUESTIONS), parts, {PIECES: count})


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; model: a sentencepiece model's bytes."""
    if not whole and not splits_at_spaces(model):
        raise ValueError("this model's pieces cross spaces: its counts do not add up over pre-tokens")
    blocks = in_pre_tokens(keep_docs(docs), whole)

    def add(b: int, got: dict, data: bytes):
        steps, n, sizes, doc, named, n_bytes = opened(data)
        at = places(steps, sizes)
        pieces = gathered(got[PIECES])[0] if PIECES in got else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(pieces[at] * n)]).astype(np.int64)
        ends = np.cumsum(sizes)
        tokens = total[ends] - total[ends - sizes]
        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=named == 0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    done = cut(for_blocks(blocks, "freqs", [piece_counts(blocks, model, whole)], add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
    forget(blocks)
    return done
