"""Decontamination, quality rules, licences, revisits, scores, chats and pages on small odd tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as cf
from tessera.llm import decontamination as de
from tessera.llm import lm_scores as lm
from tessera.llm import quality_rules as qr
from tessera.llm.html_text import extract, main_text
from tessera.llm.license_digests import known_licenses, scan_licenses
from tessera.llm.license_texts import KNOWN
from tessera.llm.revisits import canonical_url, resolve_revisits

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"


def test_windows_are_found_whole(spark):
    w = ITEM.split()
    docs = spark.createDataFrame(
        [
            (1, f"x {ITEM.upper()}, y", "clash"), (2, " ".join(w[1:11]), ""), (3, " ".join(w[:9]), ""), (4, None, ""), (5, "", ""), (6, "short one!", ""), (7, " ".join(reversed(w)), ""),
            (8, f"{ITEM} {ITEM}", ""), (None, ITEM, ""), (9, "same same same same same same same same same same same", ""), (1, f"x {ITEM.upper()}, y", "clash"), (10, "é-É ünï", ""),
        ],
        "doc_id long, text string, n_words string",
    )
    items = spark.createDataFrame([(1, ITEM), (2, "Short one"), (3, None), (4, " .. "), (None, "x y"), (5, " ".join(["same"] * 10)), (1, ITEM), (6, "ünï"), (7, "never seen")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in de.decontaminate(docs, items).collect())
    want = [("1", 14, 12, 1, True), ("2", 10, 10, 1, True), ("3", 9, 0, 0, False), ("4", 0, 0, 0, False), ("5", 0, 0, 0, False), ("6", 2, 2, 1, True), ("7", 12, 0, 0, False), ("8", 24, 24, 1, True), ("None", 12, 12, 1, True), ("9", 11, 11, 1, True), ("1", 14, 12, 1, True), ("10", 3, 1, 1, True)]
    assert got == sorted(want)
    assert de.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in de.decontaminate(docs, items.limit(0)).collect()} == {0}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(de, "FEW", 0)
    docs = spark.createDataFrame([(1, ITEM), (2, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in de.decontaminate(docs, items).collect()} == {1: 12, 2: 0}


def test_proximity(spark):
    w = ITEM.split()[:10]
    mixed = [w[1], w[0], "and", *w[2:]]
    docs = spark.createDataFrame([(1, " ".join(mixed)), (2, " ".join([*w[:5], *["far"] * 9, *w[5:]])), (3, " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    looked, index = de.build_index(docs, de.windows(items, 10), 10, slop=2)
    assert {r.doc_id for r in de.proximity_matches(looked, index, 2).collect()} == {1, 3}
    assert {r.doc_id for r in de.phrase_matches(looked, index).collect()} == {3}


def test_features_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\nx\nx\n \n\n x", "#<|>"]) for _ in range(60)] + [None, "", "\n\n", "w " * 40]
    rows = {r.doc_id: r for r in qr.features(spark.createDataFrame([(k, t, "en", 5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_words long")).collect()}
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[k]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(covered), len(lines) - len(set(lines)), sum(map(len, w)))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 500), (3, 400), (19, 1000), (100, 10_000), (1900, 100_000), (5, 5)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", qr.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in df.collect():
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
        assert p == (pytest.approx(exact, rel=1e-9) if k < n * 0.02 else 1.0)


def test_cutoffs_reject_poor_text_and_keep_good(spark):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(700)]
    poor = [" ".join(f"w{rng.randint(0, 9999)}###" for _ in range(60)) for _ in range(80)]
    rows = [(k, t, "en") for k, t in enumerate(good + poor)] + [(5000, poor[0], "xx"), (5001, poor[0], None), (None, good[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 700)) for k in range(780)] + [(None, 1), (1, None), (99999, 0)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in qr.quality_rules(docs, labels).collect()}
    assert all(kept[k] for k in range(700)) and not any(kept[k] for k in range(700, 780))
    assert kept[5000] and kept[5001] and kept[None]  # strata without labels reject nothing more
    assert {r.kept for r in qr.quality_rules(docs.limit(20), labels.limit(0)).collect()} == {True}
    assert qr.quality_rules(docs.limit(0), labels).count() == 0


def test_licences(spark):
    mit = KNOWN["MIT"][0]
    odd = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.replace('"', "'").replace("sublicense", "sub-license").upper()
    docs = spark.createDataFrame([(1, mit, ""), (2, odd, ""), (3, mit + " more", ""), (4, None, ""), (5, "", ""), (6, "(c) 2001 me", ""), (7, KNOWN["Zlib"][0].replace("acknowledgment", "acknowledgement"), "")], "doc_id long, text string, license string")
    got = {r.doc_id: r.license for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "Zlib"}
    assert scan_licenses(docs, known_licenses(spark).limit(0)).filter("license is not null").count() == 0
    assert scan_licenses(docs.limit(0), known_licenses(spark)).count() == 0


def test_canonical_urls(spark):
    urls = ["http://WWW.Site.org:80/a/?utm_source=x&b=2&a=1#top", "https://site.org/a?a=1&b=2", "", None, "https://me@site.org/", "site.org"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "url string").select(canonical_url(F.col("url")).alias("u")).collect()]
    assert got == ["site.org/a?a=1&b=2", "site.org/a?a=1&b=2", None, None, "site.org", "site.org"]


def test_revisits(spark):
    full = {"etag": "W/t1", "content-type": "text/html", "content-length": "9"}
    rows = [
        (1, "http://a.org/x", 10, "response", full, "d1"), (2, "http://a.org/x", 20, "response", full | {"etag": "t2"}, "d2"), (3, "https://www.a.org/x/", 15, "revisit", {"etag": "t1", "content-length": "0", "date": "now"}, None),
        (4, "http://a.org/x", 25, "revisit", {"etag": "t1"}, None), (5, "http://a.org/x", 10, "revisit", {"etag": "t1"}, None), (6, "http://b.org", 99, "revisit", {}, "d1"), (7, "http://a.org/x", 30, "revisit", {}, "d2"),
        (8, None, 30, "revisit", {}, "d2"), (9, "http://a.org/x", None, "revisit", {}, "d2"), (10, "http://a.org/x", 20, "response", full | {"etag": "t3"}, "d3"), (11, "http://a.org/x", 9_000_000, "revisit", {"etag": "t3"}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string")
    got = {r.record_id: (r.outcome, r.refers_to, r.payload_digest) for r in resolve_revisits(records).collect()}
    assert got == {3: ("resolved", 1, "d1"), 4: ("mismatch", 10, None), 5: ("unresolved", None, None), 6: ("unresolved", None, None), 7: ("mismatch", 10, None), 8: ("unresolved", None, None), 9: ("unresolved", None, None), 11: ("resolved", 10, "d3")}
    merged = resolve_revisits(records).filter("record_id = 3").first().headers
    assert merged == {"etag": "t1", "content-type": "text/html", "content-length": "9", "date": "now"}
    assert resolve_revisits(records.limit(0)).count() == 0


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b a b", 1.0), (2, None, 1.0), (3, "", 1.0), (4, "a b new", 1.0), (4, "a b new", 1.0), (None, "A B", 1.0)], "doc_id long, text string, score double")
    rows = lm.score(docs).collect()
    assert len(rows) == 6 and sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "4", "4", "None"])
    empty = next(r for r in rows if r.doc_id == 2)
    assert empty.n_tokens == 1
    assert lm.score(docs.limit(0)).count() == 0


def test_templates():
    render = lambda t, **v: "".join(p[0] for p in cf.compile_template(t)(v) if p)
    assert render("{{ 'a' ~ 1 }}{% if x == 'y' %}1{% elif x %}2{% else %}3{% endif %}", x="z") == "a12"
    assert render("{% for m in ms %}{{ loop.index }}{{ m.k | upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b"}]) == "1A,2B"
    assert render("{% set a = 'q' %}{{ a }}{{ nothing.x }}{{ m['k'] }}", m={"k": "v"}) == "qv"
    assert cf.fold(cf.parse("{% if 1 == 1 %}a{{ 'b' ~ 2 }}{% else %}c{% endif %}")) == [("text", "ab2")]
    for bad in ("{{ x.__class__ }}", "{{ x | evil }}", "{{ f() }}", "{% if x %}", "{% endfor %}", "{{ 1 + }}", "{% include 'x' %}"):
        with pytest.raises(cf.TemplateError):
            cf.compile_template(bad)


def test_chats_come_back(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (3, 0, "a: b", "\\"), (3, 0, "a: b", "\\"), (None, 5, "assistant", "x</turn>\n### user: y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for most in (1, 10**6):  # parts of a turn each, and whole conversations
        parts = cf.format_chats(df, most=most)
        turns = {}
        for p in sorted(parts.collect(), key=lambda p: (str(p.conv_id), p.part)):
            turns.setdefault(p.conv_id, []).extend(cf.read_back(p.text))
        assert turns == {1: [("user", said), ("assistant", said)], 2: [("", "")], 3: [("a: b", "\\")] * 2, None: [("assistant", "x</turn>\n### user: y")]}
        d = {r.conv_id: r for r in cf.digests(parts).collect()}
        assert d[1].loss_chars == len(said) and d[2].loss_chars == 0 and d[None].n_turns == 1
    assert cf.digests(cf.format_chats(df.limit(0))).count() == 0


PAGES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>un<b>closed", "unclosed"), ("<script>var a='<p>no</p>'</script><p>yes</p>", "yes"),
    ("<body><nav><a href=x>menu</a></nav><header>Site</header><article><h1>T</h1><p>One,  two<br>three &amp; &lt;four&gt;.</p><p>Five</article><div class=comments><p>a comment, long, long</p></div><footer>f</footer>", "T One, two three & <four>. Five"),
    ("<div id=sidebar><p>side, side, side</p></div><div class='post content'><p>Main text, with commas, and length.</p><p>More.</p></div><form><p>form</p></form>", "Main text, with commas, and length. More."),
    ("<main><p>a</p><aside><p>b</p></aside><div style='display:none'>c</div><p hidden>d</p></main>", "a"),
    ("<div><p>First part of the text, quite long, with commas.</p></div><div><p>Second part of the text, quite long, with commas.</p></div>", "First part of the text, quite long, with commas. Second part of the text, quite long, with commas."),
    ("<article><ul><li>one<li>two</ul><p>three</p></article><a href='x", "one two three"), ("<!-- <p>no</p> --><p a='>'>ok</p>", "ok"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert main_text(page) == want


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (None, None, None, None), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract(df).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert extract(df.limit(0)).count() == 0
    main_text("<div>" * 3000 + "deep" + "<" * 3000)  # deep and broken markup ends
