"""Rows that repeat ids, or have none, in decontamination, revisits and licence scans."""

from tessera.llm import decontamination as de
from tessera.llm import registry
from tessera.llm.revisits import resolve_revisits

ITEM = "one two three four five six seven eight nine ten eleven"


def test_hits_belong_to_their_row(spark):
    dirty, clean, near = f"x {ITEM} y", "just three words", "ten one two three four odd five six seven eight nine"
    rows = [(None, clean), (None, dirty), (5, dirty), (5, clean), (5, dirty), (7, None), (8, near), (9, ITEM.replace("ten", "one")), (10, f"{dirty} {dirty}")]
    docs = spark.createDataFrame([(d, t, "clash", 0, 0) for d, t in rows], "doc_id long, text string, item_id string, row int, pos int")
    items = spark.createDataFrame([(1, ITEM), (2, "one one two")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated, r.n_near_items) for r in de.decontaminate(docs, items).collect())
    # "one one two" needs two ones close by: the row of doc 9 has them too far apart
    want = [("None", 3, 0, 0, False, 0), ("None", 13, 11, 1, True, 1), ("5", 13, 11, 1, True, 1), ("5", 13, 11, 1, True, 1), ("5", 3, 0, 0, False, 0), ("7", 0, 0, 0, False, 0), ("8", 11, 0, 0, False, 1), ("9", 11, 0, 0, False, 0), ("10", 26, 22, 1, True, 1)]
    assert got == sorted(want)
    assert de.decontaminate(docs, items.limit(0)).filter("contaminated or n_near_items > 0").count() == 0
    assert de.decontaminate(docs.limit(0), items).count() == 0


def test_repeated_record_ids(spark):
    schema = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string, stored string"
    rows = [(1, "http://a.b/", 5, "response", {"etag": "t", "x": x}, "d", "clash") for x in ("1", "3", "2")] + [(2, "http://a.b/", 9, "revisit", {"etag": "t"}, None, None)] * 2
    rows += [(None, "http://a.b/", 9, "revisit", {"etag": "t"}, None, None), (3, None, None, "revisit", None, None, None)]
    got = sorted((str(r.record_id), r.outcome, (r.headers or {}).get("x")) for r in resolve_revisits(spark.createDataFrame(rows, schema)).collect())
    assert got == [("2", "resolved", "3"), ("2", "resolved", "3"), ("3", "unresolved", None), ("None", "unresolved", None)]


def test_the_licence_query_has_rows_that_match(spark):
    rows = registry.op3_licenses(spark, "/root/testdata/sf0.001").filter("doc_id < 0").collect()
    assert len(rows) > 30 and all(r.license for r in rows)
