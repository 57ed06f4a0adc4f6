"""Near copies in tables whose rows are repeated."""

import pytest

from tessera.llm import jaccard_join as jj


def test_repeated_rows_of_unrelated_pairs(spark):
    rows = []
    for pair in range(4):
        words = [f"p{pair}w{k}" for k in range(80)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join([*words, "more"]))]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_join(docs, 3, 90, 100).collect())
    assert got == sorted([(d, 78 + d % 2, d - d % 2) for d, _ in rows] * 2)


@pytest.mark.parametrize(("num", "den"), [(49, 100), (0, 1), (3, 2)])
def test_thresholds_that_would_lose_links_are_refused(num, den):
    with pytest.raises(ValueError, match="threshold"):
        jj.jaccard_join(None, 3, num, den)
