"""Token counts and packing against the libraries themselves."""

import random
import struct
import zlib
from collections import defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import blocks, token_counts
from tessera.llm.common import keep_docs
from tessera.llm.packing import WordIds, pack, plan
from tessera.llm.registry import tokenizer_file
from tessera.llm.token_counts import count_tokens, pre_tokens

ODD = [None, "", " ", "  x  y ", "a▁b", "<s>x</s>", "it's 12 <|endoftext|> O'er", "x" * 5000, "Ünïcödé ß Ⅷ ﬁ́", "a\tb\n c\r\n", "word " * 3000, "　\x85é"]
SCHEMA = "doc_id long, text string, n_tokens string, length string, piece string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash", "clash") for k, t in enumerate(ODD)] + [(None, "null id", None, None, None), (1, "", None, None, None), (4, "a▁b", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_equal_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_file("piece_bpe_32k.model")))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, tokenizer_file("piece_bpe_32k.model").read_bytes()).collect())
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.collect())
    assert got == want


def test_each_pre_token_is_encoded_once(spark, monkeypatch):
    """Also where many blocks have it, whose pre-tokens are dealt over many parts."""
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 400)
    monkeypatch.setattr(blocks, "ANSWERED", 20)
    monkeypatch.setattr(blocks, "ROW_KEYS", 2)
    rng = random.Random(7)
    rows = [(k, " ".join("w%d" % (rng.paretovariate(0.8) % 500) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tokenizer_file("piece_bpe_32k.model").read_bytes()
    held = token_counts.in_pre_tokens(keep_docs(docs))
    counts = token_counts.piece_counts(held, model)
    assert held.count() > 10 and counts.select("p").distinct().count() > 10
    assert counts.groupBy().sum("n").first()[0] == len({w for _, t in rows if t for w in pre_tokens(t)})
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = {k: len(sp.encode(t)) for k, t in rows}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, model).collect()} == want
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, model, whole=True).collect()} == want


def test_random_texts_split_exactly():
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_file("piece_bpe_32k.model")))
    tk = Tokenizer.from_file(str(tokenizer_file("word_bpe_49k.json")))
    words = WordIds(tokenizer_file("word_bpe_49k.json").read_text())
    rng = random.Random(5)
    parts = [*"ab  \n\t.'sT▁é́　\x1c\x85ΣσİK中😀ªµ×²~\x7f\x0b", "<|endoftext|>", "<s>", "'ve", "12", "\r\n", "ü", "À", "ß", "<|"]
    for _ in range(4000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert (sum(len(sp.encode(k)) if k else 1 for k in pre_tokens(x)) if x else 0) == len(sp.encode(x)), x
        ids = tk.encode(x, add_special_tokens=False).ids
        assert words.of(x) == struct.pack(f"<{len(ids)}I", *ids), x


def test_pieces_and_places(docs):
    tk = Tokenizer.from_file(str(tokenizer_file("word_bpe_49k.json")))
    rows = pack(docs, tokenizer_file("word_bpe_49k.json").read_text()).collect()
    want = []
    for r in docs.collect():
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(str(r.doc_id), k, a, len(p := ids[a : a + 2048]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == -(-sum(r.length for r in rows) // 2048)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack(none, tokenizer_file("word_bpe_49k.json").read_text()).count() == 0
    assert count_tokens(none, tokenizer_file("piece_bpe_32k.model").read_bytes()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 2048])
    histogram = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    used = defaultdict(int)
    for fill, times in plan(histogram, size):
        assert sum(fill) <= size and times > 0
        for x in fill:
            used[x] += times
    assert dict(used) == histogram


def test_two_pieces_replace_the_smallest():
    # greedily 6 + 3 leaves a gap of 1; 2 + 2 in the place of 3 fills it
    assert plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
