"""Source divergence against a brute-force version, in one chunk and in many, with nulls, ties and hot sources."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence as dv


def brute(rows, least, top=10):
    """rows: (text, lang, source)."""
    own, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        own[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in df:
        kept = sorted((w for w, n in df[lang].items() if n >= least), key=str.encode)
        sources = [s for x, s in own if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(own[lang, s])

        def p(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        q = p(whole)
        ps = {s: p(own[lang, s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(ps[s][w], q[w]), w) for w in kept if own[lang, s][w] > 0 and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(seed, langs=("en", "", None, "zu"), sources=70, n=400):
    rnd = random.Random(seed)
    words = ["The", "the", "cat", "Ça", "ça", "né", "zebra", "Ünder", "x", "\U0001d4b3y", "abc-def", "￿q", "日本", "9a9"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(12))) + rnd.choice(["", ".", "\n", "\x00"]), rnd.choice(langs), rnd.choice(["hot"] * 3 + [None, "", *(f"s{k}" for k in range(sources))])) for _ in range(n)]
    return rows + [(None, "en", "only null"), ("", "empty lang", "a"), ("", "empty lang", "b"), ("1 2 3", "lone", "one"), *[rows[0]] * 3]


@pytest.mark.parametrize(("chunk", "block", "held"), [(dv.CHUNK, dv.BLOCK, dv.HELD), (3, 4, 5)])
def test_same_as_brute_force(spark, monkeypatch, chunk, block, held):
    monkeypatch.setattr(dv, "BLOCK", block)
    monkeypatch.setattr(dv, "HELD", held)
    rows = rows_of(chunk)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in dv.audit(docs, least=5, chunk=chunk).collect())
    assert got == brute(rows, 5)


def test_empty_and_long(spark):
    schema = "text string, lang string, source string"
    assert dv.audit(spark.createDataFrame([], schema)).collect() == []
    rows = [("same " * 200_000, "en", "a"), ("other " * 3 + "same", "en", "b")]
    assert sorted(tuple(r) for r in dv.audit(spark.createDataFrame(rows, schema), least=1).collect()) == brute(rows, 1)


def test_shares_are_exact_for_huge_counts():
    import numpy as np

    counts, n, v = np.array([[8 * 10**14, 3, 0]]), np.array([8 * 10**14 + 3]), 3
    assert dv.shares(counts, n, v)[0].tolist() == [1 + 10**9 * (c + 2) // (8 * 10**14 + 3 + 6) for c in counts[0].tolist()]
