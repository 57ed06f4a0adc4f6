"""Queries of snapped sections, downbeats, phrases, settings, peaks, note scores and applied verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import exact
from ..operators import judge as ju
from ..operators import sections as se
from ..operators import tree as tr
from ..sources import exports as ex
from .base import EV, REV, events, query, r6, revenue, table
from .options import PART_TREE
from .time_queries import MINUTE, SEC, sections

LABEL_NAMES = [*tx.LABELS, "refrain"]
DAY = 24 * 60 * MINUTE
LABEL = f"([{', '.join(repr(x) for x in LABEL_NAMES)}])[CAST(seq % {len(LABEL_NAMES)} AS INTEGER) + 1]"


@query(f"""WITH {EV}, {SEC}, d AS (SELECT DISTINCT user_id, us AS beat FROM ev WHERE part = 'view' AND value > 300), e AS (SELECT user_id FROM d GROUP BY 1 HAVING count(*) > 1), z AS (SELECT user_id, max(us) AS duration FROM ev GROUP BY 1),
m AS (SELECT s.user_id, seq, us0, duration, beat, row_number() OVER (PARTITION BY s.user_id, seq ORDER BY abs(us0 - beat), beat) AS k FROM sec s JOIN e USING (user_id) JOIN z USING (user_id) JOIN d USING (user_id)),
f AS (SELECT user_id, seq, duration, beat, row_number() OVER (PARTITION BY user_id, beat ORDER BY us0) AS j FROM m WHERE k = 1),
g AS (SELECT user_id, seq, beat AS us0, coalesce(lead(beat) OVER (PARTITION BY user_id ORDER BY beat), duration) AS us1 FROM f WHERE j = 1),
o AS (SELECT s.user_id, seq, us0, coalesce(lead(us0) OVER (PARTITION BY s.user_id ORDER BY us0), duration) AS us1 FROM sec s JOIN z USING (user_id) WHERE s.user_id NOT IN (SELECT user_id FROM e))
SELECT user_id, seq, us0, us1 FROM g WHERE us1 - us0 > {DAY} UNION ALL SELECT * FROM o""")
def snapped_sections(spark, sf_dir):
    """Sections moved to their nearest downbeats, chained, and the short ones left out."""
    e = events(spark, sf_dir)
    ends = e.groupBy("user_id").agg(F.max("us").alias("duration"))
    s = sections(spark, sf_dir).select("user_id", "seq", "us0").join(ends, "user_id")
    downbeats = e.filter("part = 'view' and value > 300").select("user_id", "us").distinct()
    done = se.snap_sections(s, downbeats, ["user_id"], "us0", "duration", "us", 2 * DAY, DAY)
    return done.select("user_id", "seq", "us0", F.col("end").alias("us1"))


@query(f"""WITH {EV}, b AS (SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM ev WHERE part = 'click'), d AS (SELECT DISTINCT user_id, CAST(round((t + 0.00003) * 10000) AS BIGINT) AS k FROM ev WHERE part = 'click' AND value > 440)
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM d) THEN EXISTS (SELECT 1 FROM d WHERE d.user_id = b.user_id AND d.k = CAST(round(b.t * 10000) AS BIGINT)) ELSE i % 4 = 0 END AS is_down FROM b""")
def downbeat_set(spark, sf_dir):
    """Which beats are downbeats, by times rounded to four decimals, or every fourth where a track has none."""
    beats = events(spark, sf_dir).filter("part = 'click'").select("event_id", "user_id", "t", "value")
    down = beats.filter("value > 440").select("user_id", (F.col("t") + 0.00003).alias("t"))
    return se.downbeat_flags(beats, down, ["user_id"], "t", 4).select("event_id", "is_down")


def spoken(lang: str) -> str:
    words = f"CASE label {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in se.PHRASES[lang].items())} ELSE upper(label[1]) || label[2:] END"
    numbers = f"coalesce(([{', '.join(map(repr, se.NUMBERS[lang]))}])[k], CAST(k AS VARCHAR))"
    return f"{words} || CASE WHEN label IN ('verse', 'chorus', 'bridge') THEN ' ' || {numbers} ELSE '' END"


@query(f"""WITH {EV}, {SEC}, l AS (SELECT user_id, seq, {LABEL} AS label FROM sec), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, label ORDER BY seq) AS INTEGER) AS k FROM l)
SELECT user_id, seq, 'ro' AS lang, {spoken('ro')} AS cue FROM o UNION ALL SELECT user_id, seq, 'en', {spoken('en')} FROM o""")
def cue_phrases(spark, sf_dir):
    """What spoken cues say in both languages."""
    from pyspark.sql import Window

    names = F.array(*map(F.lit, LABEL_NAMES))
    s = sections(spark, sf_dir).select("user_id", "seq", F.get(names, (F.col("seq") % len(LABEL_NAMES)).cast("int")).alias("label"))
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "label").orderBy("seq"))).withColumn("lang", F.explode(F.array(F.lit("ro"), F.lit("en"))))
    return s.select("user_id", "seq", "lang", se.cue_phrase(F.col("label"), F.col("k"), F.col("lang")).alias("cue"))


PARTS = ["lead_vocal", "bgv", "drums", "bass", "electric_guitar", "keys", "pads", "kick", "snare", "toms", "hihat", "cymbals", "ch_flute"]
PART = f"([{', '.join(map(repr, PARTS))}])[CAST({{0}} % {len(PARTS)} AS INTEGER) + 1]"


def setting(k: int) -> str:
    return f"CASE part {' '.join(f'WHEN {p!r} THEN {v[k]}' for p, v in se.TRANSCRIPTION.items())} ELSE {se.OTHERS[k]} END"


@query(f"""WITH p AS (SELECT p_partkey, {PART.format('p_partkey')} AS part, CASE WHEN p_size % 7 = 0 THEN p_size / 100.0 END AS given FROM part)
SELECT p_partkey, part, CAST(coalesce(given, {setting(0)}) AS DOUBLE) AS onset, CAST({setting(1)} AS DOUBLE) AS frame, CAST({setting(2)} AS DOUBLE) AS shortest_ms FROM p""")
def transcription_settings(spark, sf_dir):
    """Thresholds by part; those given come first."""
    name = F.get(F.array(*map(F.lit, PARTS)), (F.col("p_partkey") % len(PARTS)).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("part"), F.when(F.col("p_size") % 7 == 0, F.col("p_size") / 100.0).alias("onset"))
    return se.transcription_settings(p, "part")


@query(f"""WITH {EV}, w AS (SELECT user_id, us, event_id, round(value, 2) AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev), x AS (SELECT *, lag(v) OVER q AS p, lead(v) OVER q AS n, min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lo, min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS hi FROM w WINDOW q AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT user_id, v, 80.0 + us / 1e9 AS f FROM x WHERE v > p AND v >= n AND v - greatest(lo, hi) >= 100), k1 AS (SELECT user_id, v, f FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, f DESC) = 1), r1 AS (SELECT c.* FROM c JOIN k1 USING (user_id) WHERE abs(log2(c.f / k1.f)) > 0.35),
k2 AS (SELECT user_id, v, f FROM r1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, f DESC) = 1), r2 AS (SELECT r1.* FROM r1 JOIN k2 USING (user_id) WHERE abs(log2(r1.f / k2.f)) > 0.35), k3 AS (SELECT user_id, v, f FROM r2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, f DESC) = 1)
SELECT user_id, v, round(f, 6) AS f FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)""")
def formant_peaks(spark, sf_dir):
    """Each track's three highest prominent peaks that are more than 0.35 octaves apart."""
    e = events(spark, sf_dir).select("user_id", "event_id", "us", F.round("value", 2).alias("v"), (80.0 + F.col("us") / 1e9).alias("f"))
    peaks = ex.prominent(e, ["user_id"], ["us", "event_id"], "v", 6, 100.0).select("user_id", "v", "f")
    return se.strongest_apart(peaks, ["user_id"], "f", "v", 0.35, 3).select("user_id", "v", r6(F.col("f")).alias("f"))


LIVE = f"list_filter(acc.o, lambda y: x.o[1] - y <= {DAY // 2})"


@query(f"""WITH {EV}, e AS (SELECT user_id, CAST(floor(value / 50) AS BIGINT) AS pitch, us, CASE part WHEN 'click' THEN 0 ELSE 1 END AS kind FROM ev WHERE part IN ('click', 'view')),
g AS (SELECT user_id, pitch, count(*) FILTER (kind = 0) AS n_ref, count(*) FILTER (kind = 1) AS n_est, list_reduce(list(struct_pack(o := [us], kind := kind, n := 0::BIGINT) ORDER BY us, kind), lambda acc, x: CASE WHEN acc.kind <> x.kind AND len({LIVE}) > 0 THEN struct_pack(o := {LIVE}[2:], kind := acc.kind, n := acc.n + 1)
  WHEN acc.kind = x.kind THEN struct_pack(o := list_concat({LIVE}, x.o), kind := x.kind, n := acc.n) ELSE struct_pack(o := x.o, kind := x.kind, n := acc.n) END).n AS matched FROM e GROUP BY 1, 2),
t AS (SELECT user_id, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_est) AS BIGINT) AS n_est, CAST(sum(matched) AS BIGINT) AS matched FROM g GROUP BY 1)
SELECT *, round(CASE WHEN n_est > 0 THEN matched / n_est ELSE 0 END, 6) AS precision, round(CASE WHEN n_ref > 0 THEN matched / n_ref ELSE 0 END, 6) AS recall, round(2 * matched / (n_ref + n_est), 6) AS f1 FROM t""")
def note_scores(spark, sf_dir):
    """Precision, recall and F1 of views as estimates of clicks of a track: notes of one pitch, half a day of tolerance."""
    e = events(spark, sf_dir).select("user_id", "part", "us", F.floor(F.col("value") / 50).alias("pitch"))
    done = se.note_scores(e.filter("part = 'view'"), e.filter("part = 'click'"), ["user_id"], "us", "pitch", DAY // 2)
    return done.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


CATALOGUE = ", ".join(f"('{p[0]}', {k})" for k, p in enumerate(PART_TREE))


@query(f"""WITH p AS (SELECT DISTINCT {PART.format('p_partkey')} AS key FROM part) SELECT key, coalesce(c.place, 999) AS place, row_number() OVER (ORDER BY coalesce(c.place, 999), key) AS rank FROM p LEFT JOIN (VALUES {CATALOGUE}) c(key, place) USING (key)""")
def catalogue_order(spark, sf_dir):
    """Parts in the catalogue's order, unknown ones last."""
    from pyspark.sql import Window

    name = F.get(F.array(*map(F.lit, PARTS)), (F.col("p_partkey") % len(PARTS)).cast("int"))
    known = spark.createDataFrame([(p[0], k) for k, p in enumerate(PART_TREE)], "key string, place int")
    placed = tr.in_catalogue_order(table(spark, sf_dir, "part").select(name.alias("key")).distinct(), known, "key")
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", "key")))  # one row per part


MEMBERS = ", ".join(f"('{g}', '{p}', {repr(r) if r else 'NULL'})" for g, (ps, r) in ju.SIBLINGS.items() for p in ps)
KIT = ", ".join(f"'{p}'" for p in ju.SIBLINGS["drums"][0])
TRACK = "l_suppkey % 40"


@query(f"""WITH {REV}, p AS (SELECT {TRACK} AS track, {PART.format('(l_partkey + l_suppkey)')} AS part, month, sum(price) AS amount FROM li GROUP BY 1, 2, 3), e AS (SELECT track, part, sum(CAST(amount AS DOUBLE) * CAST(amount AS DOUBLE)) AS e FROM p GROUP BY 1, 2),
v AS (SELECT e.*, g, r, CASE (track * 7 + length(part) * 3 + CAST(ascii(part) AS BIGINT)) % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'uncertain' ELSE 'present' END AS decision FROM e LEFT JOIN (VALUES {MEMBERS}) m(g, part, r) USING (part)),
o AS (SELECT *, decision = 'absent' AND g IS NOT NULL AND part IS DISTINCT FROM r AS o FROM v), c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (NOT o) OVER w AS kept FROM o WINDOW w AS (PARTITION BY track, g)),
x AS (SELECT *, o AND n > 1 AND kept > 0 AS dropped FROM c), y AS (SELECT *, arg_max(part, (e, part)) FILTER (NOT dropped) OVER w AS loudest, max(r) FILTER (part = r) OVER w AS rest, bool_or(part = 'drums' AND dropped) OVER (PARTITION BY track) AS kit FROM x WINDOW w AS (PARTITION BY track, g)),
z AS (SELECT track, part, CASE WHEN dropped THEN coalesce(rest, loudest) ELSE part END AS target FROM y WHERE NOT (kit AND part IN ({KIT})))
SELECT track, target AS part, month, CAST(sum(amount) AS DECIMAL(18,4)) AS amount FROM p JOIN z USING (track, part) GROUP BY 1, 2, 3""")
def inventory_applied(spark, sf_dir):
    """Rejected parts' amounts given to their siblings; a rejected kit's pieces leave with it."""
    name = F.get(F.array(*map(F.lit, PARTS)), ((F.col("l_partkey") + F.col("l_suppkey")) % len(PARTS)).cast("int"))
    p = revenue(spark, sf_dir).groupBy(F.expr(TRACK).alias("track"), name.alias("part"), "month").agg(F.sum("price").alias("amount"))
    score = (F.col("track") * 7 + F.length("part") * 3 + F.ascii("part")) % 5
    verdicts = p.select("track", "part").distinct().withColumn("decision", F.when(score == 0, "absent").when(score == 1, "uncertain").otherwise("present"))
    done = ju.apply_inventory(p, verdicts, "track", "part", ["month"], "amount")
    return done.select("track", "part", "month", exact(F.col("amount")).alias("amount"))
