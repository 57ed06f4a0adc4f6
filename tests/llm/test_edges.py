"""Very long texts, extra columns with clashing names, and a bound on packed sequences."""

import random

from tessera.llm.chat_format import digests, format_chats
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.license_digests import known_licenses, scan_licenses
from tessera.llm.packing import plan


def test_chats_with_clashing_columns(spark):
    rows = [(1, 0, "user", "hi", "x", 7), (1, 1, "assistant", "</turn> ok", "y", 8), (2, 0, None, None, None, None)]
    plain = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    more = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    assert sorted(map(str, digests(format_chats(more)).collect())) == sorted(map(str, digests(format_chats(plain)).collect()))


def test_licences_and_joins_of_very_long_texts(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)]
    long, near, other = " ".join(words), " ".join([*words[:-20], *["changed"] * 20]), " ".join(reversed(words))
    docs = spark.createDataFrame([(5, long), (3, near), (4, other), (9, long)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs, width=3, num=90, den=100).collect()}
    assert got[5] == got[9] and got[5][1] == got[3][1] == 3 and got[4][1] == 4 and got[5][0] > 199_000
    known = known_licenses(spark)
    text = known.first().text
    found = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame([(1, text), (2, text + " " + long), (3, long)], "doc_id long, text string"), known).collect()}
    assert found[1] and not found[2] and not found[3]


def test_sequences_are_nearly_as_few_as_can_be():
    rnd = random.Random(2)
    for most in (200, 900, 2048):
        histogram: dict[int, int] = {}
        for _ in range(20_000):
            n = min(most, 1 + int(rnd.paretovariate(0.8) * 20))
            histogram[n] = histogram.get(n, 0) + 1
        filled = plan(histogram, 2048)
        total = sum(n * k for n, k in histogram.items())
        count = sum(times for _, times in filled)
        assert sum(sum(fill) * times for fill, times in filled) == total and all(sum(fill) <= 2048 for fill, _ in filled)
        assert -(-total // 2048) <= count <= -(-total // 2048) * 1.002 + 1
