"""The corpus pipeline against a brute-force version, on a small corpus with junk, copies and leaks."""

import random
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm.registry import tokenizer_file

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"


def corpus():
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randint(25, 300))) for k in range(40)]
    for k in range(40, 52):  # near copies of some
        w = rows[k % 5][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    rows += [(60, rows[3][1]), (61, "too short"), (62, None), (63, "again and again it says the same thing twice " * 9), (64, text(40) + " " + ITEM.upper() + ". " + text(9)), (65, text(4000))]
    return rows


def brute(rows):
    good = []
    for d, t in rows:
        w = (t or "").split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else set()
        covered = {i + j for i, x in enumerate(windows) if x in seen for j in range(8)}
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w):
            good.append((d, t))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in good if (w := t.lower().split())}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    item = ITEM.split()
    leaks = [" ".join(item[i : i + 10]) for i in range(len(item) - 9)]
    kept = [(d, t) for d, t in good if find(d) == d and not any(f" {x} " in f" {t.lower().replace('.', '')} " for x in leaks)]
    tk = Tokenizer.from_file(str(tokenizer_file("word_bpe_49k.json")))
    out = set()
    for d, t in kept:
        token_ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(token_ids), 2048)):
            p = token_ids[a : a + 2048]
            out.add((d, k, a, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))))
    return out


def test_pipeline(spark, tmp_path):
    rows = corpus()
    put = lambda name, **cols: pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
    put("documents", doc_id=[d for d, _ in rows], text=[t for _, t in rows], lang=["en"] * len(rows), source=["s"] * len(rows), n_chars=[len(t or "") for _, t in rows])
    put("labels", doc_id=pa.array([0, 1], pa.int64()), quality=pa.array([1, 0], pa.int32()), toxic=pa.array([0, 0], pa.int32()))
    put("benchmark", item_id=pa.array([0], pa.int64()), text=[ITEM])
    got = cp.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == brute(rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
