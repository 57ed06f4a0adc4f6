"""Spelling variants against all pairs compared letter by letter, with nulls, ties, repeated letters and chains of forms."""

import random
import re
from collections import Counter
from zlib import crc32

from tessera.llm import spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(rows, every):
    n = counted(rows, every)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def got(docs, **more):
    return sorted((tuple(r) for r in spelling.variants(docs, **more).collect()), key=str)


def test_same_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 20)
    rnd = random.Random(5)
    words = ["hello", "aaaaa", "aaaab", "banana", "École", "naïve", "straße", "×÷×÷×", "letter"]
    for _ in range(250):  # variants of variants
        w = rnd.choice(words)
        k, c = rnd.randrange(len(w) + 1), rnd.choice("abelnÀÿ×")
        words.append(rnd.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]))
    weights = [1 + 40 * (k < 3) + 1000 // (k + 1) for k in range(len(words))]
    rows = [(d if d % 9 else None, " ".join(rnd.choices(words, weights, k=60)) + rnd.choice(["", "日本", "\x00", "_", "Āhello"])) for d in range(80)]
    rows += [(500, None), (501, ""), (502, "short"), *[rows[3]] * 4]
    docs = spark.createDataFrame([(*r, "clash", 2, "x") for r in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    for every in (97, 3):
        assert got(docs, every=every) == brute(rows, every)


def test_chains_ties_and_empty(spark):
    schema = "doc_id long, text string"
    assert got(spark.createDataFrame([], schema)) == []
    times = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "xbcdefghi": 48, "abcdefghij": 96, "lonely": 5, "aabbcc": 3, "ccbbaa": 9}
    rows = [(1, " ".join(w for w, k in times.items() for _ in range(k)) * 1), (2, "word " * 100_000)]
    docs = spark.createDataFrame(rows, schema)
    assert got(docs, every=10**12) == brute(rows, 10**12)
    roots = {r["word"]: r["root"] for r in spelling.variants(docs, every=10**12).collect()}
    assert roots["abcde"] == "abcdefghij" and roots["aabbcc"] == "aabbcc"


def test_anagrams_share_keys_and_no_more(spark):
    words = spark.createDataFrame([("listen", 3), ("silent", 3), ("tinsel", 9), ("listez", 8)], "word string, n long")
    found = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(words).collect()}
    assert found["listen"] == (1, (-8, "listez")) and found["silent"] == (0, None) and found["tinsel"] == (0, None)
    keys = spelling.meetings(words).filter("place = -1").select("word", "key").distinct().collect()
    assert len({r["key"] for r in keys if r["word"] != "listez"}) == 1 and len({r["key"] for r in keys}) == 2
