"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from .chat_format import END, GAP, TURN
from .license_digests import ANY_SPELLING, BETWEEN, COPYRIGHT_LINE, PLANTED, SPELLINGS
from .license_texts import KNOWN
from .quality_rules import PATHS, RULES, STEPS, cutoff_at
from .revisits import TRACKING

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REVISITS = rf"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest, trim(url) <> '' AS named, md5(coalesce(html, '')) AS tag, sha256(coalesce(html, '')) AS sha, strlen(coalesce(html, '')) AS size FROM pages),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))), '&') AS query FROM u),
p AS (SELECT *, CASE WHEN named THEN regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS page FROM q),
full_ AS (SELECT page, 2 * page_id + 1 AS ts, 3 * page_id + 1 AS record_id, page_id % 3 AS part, tag, sha, size FROM p),
rev AS (SELECT 3 * page_id AS record_id, page, 2 * page_id AS ts, page_id % 3 AS part, tag, sha FROM p UNION ALL SELECT 3 * page_id + 2, page, 2 * page_id + 2001, page_id % 3, tag, sha FROM p),
j AS (SELECT rev.*, f.record_id AS refers_to, f.part AS fpart, f.tag AS stored, f.sha AS fsha, f.size, row_number() OVER (PARTITION BY rev.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS k FROM rev LEFT JOIN full_ f ON f.page = rev.page AND f.ts < rev.ts),
a AS (SELECT *, refers_to IS NOT NULL AND coalesce(CASE part WHEN 0 THEN fpart = 0 AND tag = stored WHEN 1 THEN fpart = 1 AND tag = stored ELSE sha = fsha END, false) AS agree FROM j WHERE k = 1)
SELECT record_id, page, ts, CASE WHEN refers_to IS NULL THEN 'unresolved' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome, refers_to,
  CASE WHEN agree THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || CASE WHEN part = 0 THEN chr(10) || 'etag: ' || tag WHEN fpart = 0 THEN chr(10) || 'etag: W/' || stored ELSE '' END
    || CASE WHEN part = 1 OR fpart = 1 THEN chr(10) || 'last-modified: as of ' || stored ELSE '' END END AS header_lines, CASE WHEN agree THEN fsha END AS payload_digest FROM a"""

DECONTAMINATE = rf"""
WITH i AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS phrase FROM i, LATERAL (SELECT unnest(range(0, len(w) - least(len(w), 10) + 1)) AS k)),
d AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS phrase FROM d, (SELECT DISTINCT n FROM win) s, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - n + 1))) AS k)),
hit AS (SELECT DISTINCT doc_id, item_id, k, win.n AS n FROM dw JOIN win ON win.n = dw.n AND win.phrase = dw.phrase),
pos AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, n)) AS o) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id),
bag AS (SELECT DISTINCT item_id, words, list_reduce(words, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS anchor, len(words) + 2 AS reach FROM (SELECT item_id, w[k + 1 : k + least(len(w), 10)] AS words FROM i, LATERAL (SELECT unnest(range(0, len(w) - least(len(w), 10) + 1)) AS k))),
dp AS (SELECT doc_id, w, p, w[p] AS anchor FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) WHERE w[p] IN (SELECT anchor FROM bag)),
cand AS (SELECT doc_id, item_id, w, p, words, reach FROM dp JOIN bag USING (anchor) WHERE list_has_all(w[greatest(1, p - reach + 1) : p + reach - 1], words)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, item_id, words, w[k : k + reach - 1] AS part FROM cand, LATERAL (SELECT unnest(range(greatest(1, p - reach + 1), p + 1)) AS k))
  WHERE list_has_all(part, words) AND len(list_filter(words, lambda x: len(list_filter(part, lambda y: y = x)) < len(list_filter(words, lambda y: y = x)))) = 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)"""


def canonical(text: str) -> str:
    lines = f"regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    same = "l"
    for old, new in SPELLINGS.items():
        same = f"regexp_replace({same}, '\\b{old}\\b', '{new}', 'g')"
    return f"(SELECT trim(regexp_replace(CASE WHEN regexp_matches(l, {quoted(ANY_SPELLING)}) THEN {same} ELSE l END, {quoted(BETWEEN)}, ' ', 'g')) FROM (SELECT {lines} AS l))"


LICENSES = f"""
WITH v(license, txt, doc_id) AS (VALUES {', '.join(f'({quoted(n)}, {quoted(t)}, {-1 - k})' for k, (n, t) in enumerate(sorted((n, t) for n, ts in KNOWN.items() for t in ts)))}),
k AS (SELECT license, {canonical('txt')} AS c FROM v),
g AS (SELECT sha256(c) AS digest, array_to_string(list_sort(list(DISTINCT license)), ',') AS license FROM k WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, {canonical('text')} AS c FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, {quoted(PLANTED)} || upper(txt) FROM v))
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_canonical, CASE WHEN c <> '' THEN sha256(c) END AS digest, license FROM d LEFT JOIN g ON c <> '' AND g.digest = sha256(c)"""

ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(GAP) + len(END) + 1} + length(replace({ESCAPED.format('role')}, ':', '\\:')) + length({ESCAPED.format('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + least(len(w), 3)], ' ') AS g FROM d, LATERAL (SELECT unnest(range(0, len(w) - least(len(w), 3) + 1)) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(d, l) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.d, e.b FROM r JOIN e ON r.l = e.a)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(l) AS component_id, coalesce(any_value(k.k), 0) AS n_links FROM r LEFT JOIN n ON n.doc_id = d LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) k ON k.a = d GROUP BY d"""


def quality(risk: float = 0.05, error: float = 0.05, weight: int = 5) -> str:
    grid = ", ".join(f"('{r}', {k}, {cutoff_at(r, k)})" for r in RULES for k in range(1, STEPS + 1))
    paths = ", ".join(f"({n}, '{r}')" for n, p in enumerate(PATHS) for r in p)
    score = " ".join(f"WHEN '{r}' THEN {a} * 1000 // greatest({b}, 1)" for r, (a, b, _) in RULES.items())
    rejects = " AND ".join(f"NOT coalesce({a} * 1000 // greatest({b}, 1) >= cut_{r}, false)" for r, (a, b, _) in RULES.items())
    cuts = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '~null') AS lang, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, k, array_to_string(w[k + 1 : k + 8], ' ') AS g FROM d, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - 7))) AS k)),
rep AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), LATERAL (SELECT unnest(range(0, 8)) AS o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT x.doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM x LEFT JOIN rep ON rep.doc_id = x.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT lang, text, bool_or(quality = 1) AS good, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_lines) AS n_lines, any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words
  FROM b JOIN labels l ON l.doc_id = b.doc_id WHERE quality IS NOT NULL AND NOT base_failed GROUP BY lang, text),
r AS (SELECT lang, text, good, rule, {STEPS + 1} - count(*) FILTER (s >= cutoff) AS step FROM (SELECT lang, text, good, rule, cutoff, CASE rule {score} END AS s FROM h, (VALUES {grid}) g(rule, step, cutoff)) GROUP BY ALL),
p AS (SELECT lang, text, good, path, min(step) AS step FROM r JOIN (VALUES {paths}) q(path, rule) USING (rule) GROUP BY lang, text, good, path),
k AS (SELECT lang, path, k, count(*) FILTER (good) AS n, count(*) FILTER (good AND step <= k) AS lost, count(*) FILTER (NOT good AND step <= k) AS hit FROM p, (SELECT unnest(range(1, {STEPS + 1})) AS k) GROUP BY lang, path, k),
t AS (SELECT *, n > 0 AND CASE WHEN lost < n * {risk} THEN list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) ELSE 1.0 END <= {error} / ({len(PATHS)} * (SELECT count(DISTINCT lang) FROM h)) AS passed FROM k),
a AS (SELECT *, bool_and(passed) OVER (PARTITION BY lang, path ORDER BY k) AS admitted, hit - {weight} * lost AS worth FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY worth DESC, path, k) AS o FROM a WHERE admitted AND worth > 0),
c AS (SELECT lang, {cuts} FROM o JOIN (VALUES {paths}) q(path, rule) USING (path) JOIN (VALUES {grid}) g(rule, k, cutoff) USING (rule, k) WHERE o = 1 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rejects} AS kept FROM b LEFT JOIN c USING (lang)"""


CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)"
SCORES = rf"""
WITH d AS (SELECT doc_id, xor({CRC}, 4294967295::BIGINT) % 7 = 2 AS held_out, list_append({WORDS.format(LOWER.format('text'))}, ' ') AS w FROM documents),
t AS (SELECT doc_id, held_out, k AS pos, w[k] AS w, CASE WHEN k > 1 THEN w[k - 1] ELSE ' ' END AS v, CASE WHEN k > 2 THEN w[k - 2] WHEN k = 2 THEN ' ' END AS u FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), z AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
g2 AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w HAVING count(*) >= 2),
b2 AS (SELECT g2.v, 1 - sum(g2.c - 0.75) / any_value(c.c) AS b FROM g2 JOIN c ON c.w = g2.v GROUP BY g2.v),
g3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= 2),
b3 AS (SELECT g3.u, g3.v, 1 - sum(g3.c - 0.75) / any_value(g2.c) AS b FROM g3 JOIN g2 ON g2.v = g3.u AND g2.w = g3.v GROUP BY g3.u, g3.v),
p AS (SELECT t.doc_id, held_out, t.u, t.v, t.w, c.c, (coalesce(c.c, 0) + 1) / (z.n + z.v + 1)::DOUBLE AS p1 FROM t CROSS JOIN z LEFT JOIN c ON c.w = t.w),
s AS (SELECT p.*, coalesce((g2.c - 0.75) / cv.c, 0) + coalesce(b2.b, 1) * p1 AS p2 FROM p LEFT JOIN g2 ON g2.v = p.v AND g2.w = p.w LEFT JOIN c cv ON cv.w = p.v LEFT JOIN b2 ON b2.v = p.v),
q AS (SELECT s.*, coalesce((g3.c - 0.75) / k.c, 0) + coalesce(b3.b, 1) * p2 AS p3 FROM s LEFT JOIN g3 ON g3.u = s.u AND g3.v = s.v AND g3.w = s.w LEFT JOIN g2 k ON k.v = s.u AND k.w = s.v LEFT JOIN b3 ON b3.u = s.u AND b3.v = s.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT n FROM z) AS train_tokens, sum(log10(p1)) AS base_score, sum(log10(p3)) AS score FROM q GROUP BY doc_id, held_out"""


DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n) AS n, count(*) AS df FROM t GROUP BY ALL),
kept AS (SELECT lang, term FROM c GROUP BY lang, term HAVING sum(df) >= 10),
g AS (SELECT DISTINCT lang, source, 0 AS whole FROM d UNION ALL SELECT DISTINCT lang, '', 1 FROM d),
x AS (SELECT g.lang, g.source, whole, kept.term, CAST(coalesce(CASE WHEN whole = 1 THEN a.n ELSE c.n END, 0) AS HUGEINT) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term AND whole = 0
  LEFT JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) a ON a.lang = g.lang AND a.term = kept.term AND whole = 1),
s AS (SELECT lang, source, whole, sum(n) AS total, count(*) AS v FROM x GROUP BY ALL),
p AS (SELECT x.*, 1 + CAST(1000000000 * (n + 2) AS HUGEINT) // CAST(total + 2 * v AS HUGEINT) AS p FROM x JOIN s USING (lang, source, whole)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source WHERE a.whole = 0 AND b.whole = 0 GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source AND a.whole = 0 AND b.whole = 0 LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tm AS (SELECT a.lang, a.source, 'term' AS part, a.term AS item, CAST((a.p - b.p) * (a.p - b.p) // (a.p + b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND b.whole = 1 WHERE a.whole = 0 AND a.n > 0 AND a.p > b.p)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm) QUALIFY part = 'pair' OR rank <= 10"""

SPELLING = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(0, 8), lambda k: k::BIGINT)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17)::BIGINT)), lambda a, c: xor(a // 256, t[xor(a % 256, c) + 1])), 4294967295::BIGINT) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, i, word[: i] || word[i + 2 :] AS rest FROM v, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
c(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL"""


DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, doc_id, k, md5(array_to_string(w[k + 1 : k + 20], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - 19))) AS k)),
gone AS (SELECT DISTINCT r, k + o AS pos FROM (SELECT r, k FROM win QUALIFY rank() OVER (PARTITION BY g ORDER BY doc_id, k) > 1), LATERAL (SELECT unnest(range(0, 20)) AS o)),
x AS (SELECT r, word, pos FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d) ANTI JOIN gone USING (r, pos)),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def all_sql() -> dict[str, str]:
    return {
        "op1_revisits": REVISITS, "op2_decontaminate": DECONTAMINATE, "op3_licenses": LICENSES, "op4_chat_format": CHAT,
        "op8_jaccard_join": JACCARD, "op9_quality_rules": quality(), "op10_lm_scores": SCORES,
        "op11_divergence": DIVERGENCE, "op12_spelling": SPELLING, "op13_substring_dedup": DEDUP,
    }
