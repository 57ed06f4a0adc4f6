"""Queries of names, labels, pitches and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch as pi
from ..functions import text as tx
from ..functions.numeric import exact, reasons
from ..operators import judge as ju
from ..operators import metrics as me
from .allocation import ISOLATION, isolation_score
from .base import HOURLY, REV, events, hourly, query, r6, revenue, table


def sql_case(expr: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, '{p}') THEN '{k}'" for p, k in rules) + f" ELSE {otherwise} END"


def sql_map(expr: str, table_: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


SPACED = "trim(regexp_replace(regexp_replace(lower({0}), '[-_]', ' ', 'g'), '\\s+', ' ', 'g'))"
CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, '(?i)\\.(wav|aif|aiff|flac|caf)$', ''), '{tx.NUMBERING.replace('{', '{{').replace('}', '}}')}', ''), '[_-]', ' ', 'g'), '{tx.GLUED.replace('{', '{{').replace('}', '}}')}', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
SIDE = f"substr(regexp_extract(lower(clean), '{tx.SIDE}', 1), 1, 1)"
BASE = f"trim(regexp_replace(lower(clean), '{tx.SIDE}', ''))"
# Names that the queries make of the parts' keys.
KINDS = ["Lead Vocal", "EG1", "kick-drum", "BGV_2", "Hi Hat", "Bass DI", "No_Vocals", "Keyboard", "Pad L", "Synth.R", "Talkback", "floor tom", "Electric-Guitar", "loop", "strange thing", "OH R", "Kick In", "Snare Top", "HiHat", "AG", "Keys L", "Lead Vox", "Click", "Worship Leader", "Tom3", "E.Gtr (R)", "Rhodes left"]
KIND = "list_value(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def channels(spark, sf_dir):
    """p_partkey, raw: recorded channels' names made of the parts' keys."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    number = F.lpad((F.col("p_partkey") % 24 + 1).cast("string"), 2, "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(number, F.lit(" "), F.get(kinds, (F.col("p_partkey") % len(KINDS)).cast("int")), F.when(F.col("p_partkey") % 3 == 0, ".wav").otherwise("")).alias("raw"), "p_size", "p_retailprice")


CH = f"ch AS (SELECT p_partkey, lpad(CAST(p_partkey % 24 + 1 AS VARCHAR), 2, '0') || ' ' || ({KIND})[p_partkey % {len(KINDS)} + 1] || CASE WHEN p_partkey % 3 = 0 THEN '.wav' ELSE '' END AS raw, p_size, p_retailprice FROM part)"


@query(f"""WITH k AS (SELECT p_partkey, ({KIND})[p_partkey % {len(KINDS)} + 1] AS raw FROM part) SELECT p_partkey, coalesce({sql_map(SPACED.format('raw'), tx.ALIASES)}, {sql_map(f"replace({SPACED.format('raw')}, ' ', '_')", tx.ALIASES)}, replace({SPACED.format('raw')}, ' ', '_')) AS key FROM k""")
def alias_normalise(spark, sf_dir):
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return table(spark, sf_dir, "part").select("p_partkey", tx.alias_key(F.get(kinds, (F.col("p_partkey") % len(KINDS)).cast("int"))).alias("key"))


@query(f"""WITH {CH} SELECT 'part' AS origin, p_partkey AS id, {CLEAN.format('raw')} AS clean, coalesce(nullif(trim(regexp_replace(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}_() -]', '_', 'g'), '\\s+', ' ', 'g')), ''), 'Track') AS safe FROM ch
UNION ALL SELECT 'page', page_id, {CLEAN.format('url')}, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[^\\p{{L}}\\p{{N}}_() -]', '_', 'g'), '\\s+', ' ', 'g')), ''), 'Track') FROM pages""")
def name_clean(spark, sf_dir):
    """Channel names without numbering, and file-safe names."""
    both = channels(spark, sf_dir).select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), "raw").union(table(spark, sf_dir, "pages").select(F.lit("page"), "page_id", "url"))
    return both.select("origin", "id", tx.channel_name(F.col("raw")).alias("clean"), tx.safe_name(F.col("raw")).alias("safe"))


OWN = "'ch_' || coalesce(nullif(regexp_replace(lower(clean), '[^a-z0-9]+', '_', 'g'), ''), 'unnamed')"


@query(f"""WITH {CH}, c AS (SELECT p_partkey, {CLEAN.format('raw')} AS clean FROM ch), b AS (SELECT *, {BASE} AS base FROM c) SELECT p_partkey, {sql_case('base', tx.CHANNELS, OWN)} AS part, {SIDE} AS side FROM b""")
def first_match_class(spark, sf_dir):
    """The part a channel records, by the first pattern that matches, and its side."""
    c = channels(spark, sf_dir).select("p_partkey", tx.channel_name(F.col("raw")).alias("clean"))
    return c.select("p_partkey", tx.first_match(tx.channel_base(F.col("clean")), tx.CHANNELS, tx.own_track(F.col("clean"))).alias("part"), tx.channel_side(F.col("clean")).alias("side"))


CLASSED = f"{CH}, c AS (SELECT p_partkey, p_size, p_retailprice, {CLEAN.format('raw')} AS clean FROM ch), k AS (SELECT *, {sql_case(BASE, tx.CHANNELS, OWN)} AS part, {SIDE} AS side FROM c)"


@query(f"""WITH {CLASSED}, o AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'vocals' ELSE part END AS part, side, CAST(p_retailprice AS DECIMAL(18,4)) AS v FROM k),
g AS (SELECT part, sum(CASE WHEN side = 'r' THEN 0 ELSE v END) AS l, sum(CASE WHEN side = 'l' THEN 0 ELSE v END) AS r, count(*) AS n FROM o WHERE part NOT IN ('__click', '__ignore') GROUP BY part), m AS (SELECT greatest(max(l), max(r))::DOUBLE AS peak FROM g)
SELECT part, n AS channels, round(l::DOUBLE * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1.0 END, 6) AS left_sum, round(r::DOUBLE * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1.0 END, 6) AS right_sum FROM g, m""")
def channel_group(spark, sf_dir):
    """Channels classified (overrides first), panned, summed by part, and scaled together under the ceiling."""
    c = channels(spark, sf_dir).select("p_partkey", exact(F.col("p_retailprice")).alias("v"), tx.channel_name(F.col("raw")).alias("clean"))
    ruled = c.select("p_partkey", "v", tx.first_match(tx.channel_base(F.col("clean")), tx.CHANNELS, tx.own_track(F.col("clean"))).alias("rule"), tx.channel_side(F.col("clean")).alias("side"))
    override = table(spark, sf_dir, "part").filter("p_partkey % 17 = 0").select("p_partkey", F.lit("vocals").alias("given"))
    keyed = ruled.join(override, "p_partkey", "left").withColumn("part", F.coalesce("given", "rule"))
    ear = lambda other: F.sum(F.when(F.col("side") == other, F.lit(0)).otherwise(F.col("v"))).cast("double")
    g = keyed.filter(~F.col("part").isin(tx.CLICK, tx.IGNORED)).groupBy("part").agg(F.count("*").alias("channels"), ear("r").alias("l"), ear("l").alias("r"))
    peak = g.agg(F.greatest(F.max("l"), F.max("r")).alias("peak"))
    gain = F.when(F.col("peak") > 0.99, 0.99 / F.col("peak")).otherwise(1.0)
    return g.join(F.broadcast(peak)).select("part", "channels", r6(F.col("l") * gain).alias("left_sum"), r6(F.col("r") * gain).alias("right_sum"))  # one row is broadcast


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 88 + 21 AS midi, CAST(o_custkey % 12 AS INTEGER) AS shift FROM orders), n AS (SELECT *, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'] AS names FROM o)
SELECT o_orderkey, midi, round(440.0 * pow(2.0, (midi - 69) / 12.0), 6) AS hz, names[midi % 12 + 1] || CAST(midi // 12 - 1 AS VARCHAR) AS name, CAST((midi + shift) % 12 AS BIGINT) AS moved,
CAST(CASE WHEN (shift - midi % 12 + 12) % 12 <= 6 THEN (shift - midi % 12 + 12) % 12 ELSE (shift - midi % 12 + 12) % 12 - 12 END AS BIGINT) AS shortest,
CAST(((((midi + shift) % 12) * 7 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 9 END) % 12 + 7) % 12 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'A' END AS camelot FROM n""")
def pitch_math(spark, sf_dir):
    """Frequencies, names, transposition, the shortest move and the wheel of keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 88 + 21).alias("midi"), (F.col("o_custkey") % 12).alias("shift"))
    o = o.withColumn("moved", pi.transposed(F.col("midi"), F.col("shift"))).withColumn("mode_", F.when(F.col("o_orderkey") % 2 == 0, "major").otherwise("minor"))
    c = pi.camelot_table(spark)
    j = o.join(F.broadcast(c), (o["moved"] == c["pitch"]) & (o["mode_"] == c["mode"]))  # 24 rows
    return j.select("o_orderkey", "midi", r6(pi.hertz(F.col("midi"))).alias("hz"), pi.note_name(F.col("midi")).alias("name"), "moved", pi.shortest_move(F.col("midi") % 12, F.col("shift")).alias("shortest"), "camelot")


@query("""SELECT s_suppkey, concat_ws('; ', CASE WHEN s_acctbal < 0 THEN 'in debt' END, CASE WHEN s_acctbal < 1000 THEN 'low balance' END, CASE WHEN s_nationkey < 5 THEN 'near' END, CASE WHEN s_acctbal >= 1000 AND s_nationkey >= 5 THEN 'ordinary' END) AS reasons, round(greatest(0.0, least(1.0, (s_acctbal + 1000) / 10000.0)), 6) AS score FROM supplier""")
def reason_list(spark, sf_dir):
    """The messages of the rules that hold, and a clipped ramp."""
    from ..functions.numeric import ramp

    why = reasons((F.col("s_acctbal") < 0, "in debt"), (F.col("s_acctbal") < 1000, "low balance"), (F.col("s_nationkey") < 5, "near"), default="ordinary")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(why, "; ").alias("reasons"), r6(ramp(F.col("s_acctbal"), -1000.0, 10000.0)).alias("score"))


QSQL = "CASE q " + " ".join(f"WHEN '{q}' THEN {s}" for q, s in tx.QUALITIES.items()) + " END"


@query(f"""WITH s AS (SELECT p_partkey, (['C', 'D', 'E', 'F', 'G', 'A', 'B'])[p_partkey % 7 + 1] || (['', '#', 'b'])[p_partkey % 3 + 1] || (['', 'm', '7', 'm7', 'maj7', 'sus4', 'sus2', 'dim', 'aug', 'add9'])[p_partkey % 10 + 1] AS symbol FROM part),
r AS (SELECT *, ((CASE substr(symbol, 1, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END) + CASE WHEN regexp_matches(symbol, '^[A-G]#') THEN 1 WHEN regexp_matches(symbol, '^[A-G]b') THEN -1 ELSE 0 END + 12) % 12 AS root, regexp_extract(symbol, '^[A-G][#b]?(.*)$', 1) AS q FROM s)
SELECT p_partkey, symbol, root, q AS quality, array_to_string(list_sort(list_transform({QSQL}, lambda x: (x + root) % 12)), ',') AS classes FROM r""")
def chord_parse(spark, sf_dir):
    """Root, quality and pitch classes of chord symbols; no classes for an unknown quality."""
    pick = lambda xs, n: F.get(F.array(*(F.lit(x) for x in xs)), (F.col("p_partkey") % n).cast("int"))
    symbol = F.concat(pick("CDEFGAB", 7), pick(["", "#", "b"], 3), pick(["", "m", "7", "m7", "maj7", "sus4", "sus2", "dim", "aug", "add9"], 10))
    s = table(spark, sf_dir, "part").select("p_partkey", symbol.alias("symbol"))
    return s.select("p_partkey", "symbol", tx.chord_root(F.col("symbol")).alias("root"), tx.chord_quality(F.col("symbol")).alias("quality"), F.array_join(F.transform(tx.chord_classes(F.col("symbol")), lambda x: x.cast("string")), ",").alias("classes"))


@query(f"""WITH {HOURLY} SELECT part, CAST(sum(amount) AS DECIMAL(18,4)) AS amount FROM hp WHERE part NOT IN ('click', 'error') AND part NOT LIKE '\\_\\_%' ESCAPE '\\' GROUP BY part""")
def pitched_filter(spark, sf_dir):
    """Parts outside a fixed set and without a private prefix."""
    out = spark.createDataFrame([("click",), ("error",)], "part string")
    return hourly(spark, sf_dir).join(out, "part", "left_anti").filter(~F.col("part").startswith("__")).groupBy("part").agg(exact(F.sum("amount")).alias("amount"))


EVIDENCE = f"""{HOURLY}, mix AS (SELECT hour, CAST(sum(amount) AS DOUBLE) AS m FROM hp GROUP BY hour), lv AS (SELECT part, 20 * log10(sqrt(avg(CAST(amount AS DOUBLE) * CAST(amount AS DOUBLE))) / sqrt(avg(m * m))) AS energy_db FROM hp JOIN mix USING (hour) GROUP BY part),
bd AS (SELECT part, CAST(coalesce(sum(amount) FILTER (hour % 24 >= 6 AND hour % 24 < 18), 0) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS band FROM hp GROUP BY part),
fl AS (SELECT part, value - lag(value) OVER (PARTITION BY part ORDER BY us, event_id) >= 100 AS up FROM ev), os AS (SELECT part, least(1.0, count(*) FILTER (up) / 1000.0) AS onset, avg(CASE WHEN up THEN 0.0 ELSE 1.0 END) AS harmonic FROM fl GROUP BY part),
ds AS (SELECT part, 1 - max(r) AS distinct_ FROM (SELECT a.part, b.part AS o, round(abs(corr(CAST(a.amount AS DOUBLE), CAST(b.amount AS DOUBLE))), 6) AS r FROM hp a JOIN hp b ON a.hour = b.hour AND a.part <> b.part GROUP BY 1, 2) GROUP BY part),
x AS (SELECT part, energy_db, band, onset, harmonic, distinct_ AS d, part IN ('click', 'error') AS percussive, greatest(0.0, least(1.0, (energy_db + 42) / 27)) AS e FROM lv JOIN bd USING (part) JOIN os USING (part) JOIN ds USING (part)),
raw AS (SELECT *, CASE WHEN percussive THEN 0.2 * e + 0.15 * band + 0.15 * onset + 0.0 * harmonic + 0.5 * d ELSE 0.2 * e + 0.15 * band + 0.15 * onset + 0.15 * harmonic + 0.35 * d END AS r FROM x),
cf AS (SELECT *, round(greatest(0.0, least(1.0, least(CASE WHEN d < 0.15 THEN least(r, 0.3) ELSE r END, 0.2 + 0.8 * greatest(0.0, least(1.0, (energy_db + 50) / 20))))), 6) AS confidence FROM raw)"""


@query(f"""WITH {EVIDENCE} SELECT part, confidence, CASE WHEN confidence >= 0.62 THEN 'present' WHEN confidence < 0.34 THEN 'absent' ELSE 'uncertain' END AS decision,
coalesce(nullif(concat_ws('; ', CASE WHEN energy_db < -35 THEN 'very quiet' END, CASE WHEN band < 0.3 THEN 'outside its band' END, CASE WHEN d < 0.15 THEN 'copies a sibling' END, CASE WHEN onset < 0.2 THEN 'few onsets' END), ''), 'supported') AS why,
round(0.65 * confidence + 0.35 * band, 6) AS second, CASE WHEN round(0.65 * confidence + 0.35 * band, 6) >= 0.62 THEN 'present' WHEN round(0.65 * confidence + 0.35 * band, 6) < 0.34 THEN 'absent' ELSE 'uncertain' END AS second_decision FROM cf""")
def presence_verdict(spark, sf_dir):
    """Confidence in each part from five kinds of evidence with vetoes, and a second opinion."""
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    mix = h.groupBy("hour").agg(F.sum("amount").cast("double").alias("m"))
    level = h.join(mix, "hour").groupBy("part").agg((20 * F.log10(F.sqrt(F.avg(F.col("v") * F.col("v"))) / F.sqrt(F.avg(F.col("m") * F.col("m"))))).alias("energy_db"))
    inside = (F.col("hour") % 24 >= 6) & (F.col("hour") % 24 < 18)
    band = h.groupBy("part").agg((F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).cast("double") / F.sum("amount").cast("double")).alias("band"))
    onset = me.onset_rate(events(spark, sf_dir), ["part"], ["us", "event_id"], "t", "value", 100, F.expr("hour div 24"))
    n = h.select("part").distinct()  # keeps the part's row without events
    size = events(spark, sf_dir).groupBy("part").agg(F.count("*").alias("size"))
    shape = onset.join(size, "part").select("part", F.least(F.lit(1.0), F.col("onsets") / 1000.0).alias("onset"), (1 - F.col("onsets") / F.col("size")).alias("harmonic"))
    like = me.best_sibling(h.withColumn("root", F.lit(1)), ["root"], "part", "hour", "v").select("part", (1 - F.col("likeness")).alias("distinct"))
    x = n.join(level, "part").join(band, "part").join(shape, "part").join(like, "part").withColumn("percussive", F.col("part").isin("click", "error"))
    second, decision = ju.blended(F.col("confidence"), F.col("band"))
    return ju.presence(x).select("part", "confidence", "decision", "why", second.alias("second"), decision.alias("second_decision"))


@query(f"""WITH {HOURLY}, {ISOLATION}, mix AS (SELECT hour, CAST(sum(amount) AS DOUBLE) AS m FROM hp GROUP BY hour), p AS (SELECT a.part, max(round(r, 6)) AS bleed FROM (SELECT a.part, b.part AS o, abs(corr(CAST(a.amount AS DOUBLE), CAST(b.amount AS DOUBLE))) AS r FROM hp a JOIN hp b ON a.hour = b.hour AND a.part <> b.part GROUP BY 1, 2) a GROUP BY 1),
fu AS (SELECT part, avg(CAST(amount AS DOUBLE) * CAST(amount AS DOUBLE)) / avg(m * m) AS full_, any_value(isolation) AS art FROM hp JOIN mix USING (hour) JOIN iso USING (part) GROUP BY part)
SELECT part, bleed, art AS artifact, round(full_, 6) AS fullness, CASE WHEN bleed < 0.35 AND art < 0.35 AND full_ > 0.02 THEN 'good' WHEN bleed < 0.65 AND art < 0.6 THEN 'usable' ELSE 'rough' END AS verdict,
coalesce(nullif(concat_ws('; ', CASE WHEN bleed >= 0.35 THEN 'bleeds into a sibling' END, CASE WHEN art >= 0.35 THEN 'isolated cells' END, CASE WHEN full_ <= 0.02 THEN 'thin' END), ''), 'clean') AS notes FROM p JOIN fu USING (part)""")
def quality_verdict(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    mix = h.groupBy("hour").agg(F.sum("amount").cast("double").alias("m"))
    v, m = F.col("v"), F.col("m")
    full = h.join(mix, "hour").groupBy("part").agg((F.avg(v * v) / F.avg(m * m)).alias("full")).join(isolation_score(spark, sf_dir).withColumnRenamed("isolation", "art"), "part")
    bleed = me.best_sibling(h.withColumn("root", F.lit(1)), ["root"], "part", "hour", "v").select("part", F.col("likeness").alias("bleed"))
    verdict, notes = ju.quality(F.col("bleed"), F.col("art"), F.col("full"))
    return full.join(bleed, "part").select("part", "bleed", F.col("art").alias("artifact"), r6(F.col("full")).alias("fullness"), verdict.alias("verdict"), notes.alias("notes"))


@query(f"""WITH {REV}, c AS (SELECT s_nationkey AS nation, month, l_linenumber, l_quantity, price, l_extendedprice, l_discount FROM li JOIN supplier ON s_suppkey = l_suppkey), m AS (SELECT nation, max(price) AS peak FROM c GROUP BY 1),
lr AS (SELECT nation, month, CAST(coalesce(sum(price) FILTER (l_linenumber % 2 = 0), 0) AS DOUBLE) AS l, CAST(coalesce(sum(price) FILTER (l_linenumber % 2 = 1), 0) AS DOUBLE) AS r FROM c GROUP BY 1, 2), wd AS (SELECT nation, sqrt(avg(pow((l - r) / 2, 2))) / (sqrt(avg(pow((l + r) / 2, 2))) + 1e-10) AS wide FROM lr GROUP BY 1),
g AS (SELECT c.nation, avg(CASE WHEN price > 0.02 * peak THEN 1.0 ELSE 0.0 END) AS occ, quantile_cont(l_extendedprice, 0.995) / quantile_cont(l_extendedprice, 0.5) AS cr, greatest(CAST(coalesce(sum(price) FILTER (l_quantity < 11), 0) AS DOUBLE), CAST(coalesce(sum(price) FILTER (l_quantity >= 11 AND l_quantity < 21), 0) AS DOUBLE), CAST(coalesce(sum(price) FILTER (l_quantity >= 21), 0) AS DOUBLE)) / CAST(sum(price) AS DOUBLE) AS crowd, CAST(sum(CAST(round(l_discount * 100) AS INTEGER)) AS DOUBLE) / count(*) / 10 AS dull FROM c JOIN m USING (nation) GROUP BY 1),
s AS (SELECT nation, greatest(0.0, least(1.0, (occ - 0.5) / 0.5)) AS a, greatest(0.0, least(1.0, (12 - 20 * log10(cr)) / 12)) AS b, greatest(0.0, least(1.0, (crowd - 0.3) / 0.6)) AS c, greatest(0.0, least(1.0, dull)) AS d, greatest(0.0, least(1.0, (0.25 - wide) / 0.25)) AS w FROM g JOIN wd USING (nation)),
t AS (SELECT *, round(0.3 * a + 0.25 * b + 0.2 * c + 0.15 * w + 0.1 * d, 6) AS score FROM s)
SELECT nation, score, CASE WHEN score < 0.28 THEN 'easy' WHEN score < 0.48 THEN 'moderate' WHEN score < 0.68 THEN 'hard' ELSE 'very hard' END AS grade, coalesce(nullif(concat_ws('; ', CASE WHEN a > 0.6 THEN 'expect shared cells' END, CASE WHEN b > 0.6 THEN 'limited dynamics' END, CASE WHEN c > 0.5 THEN 'one register dominates' END), ''), 'no special care') AS advice FROM t""")
def difficulty_score(spark, sf_dir):
    """A weighted forecast of how hard each nation's items are to take apart."""
    from ..functions.numeric import ramp

    c = revenue(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).withColumnRenamed("s_nationkey", "nation")
    occ = me.occupied(c, ["nation"], "price").select("nation", "occupied")
    band = lambda test: F.coalesce(F.sum(F.when(test, F.col("price"))), F.lit(0)).cast("double")
    q = F.col("l_quantity")
    g = c.groupBy("nation").agg(
        (F.greatest(band(q < 11), band((q >= 11) & (q < 21)), band(q >= 21)) / F.sum("price").cast("double")).alias("crowd"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("int")).cast("double") / F.count("*") / 10).alias("dull"),
    ).join(occ, "nation")
    side = lambda k: band(F.col("l_linenumber") % 2 == k)
    both = c.groupBy("nation", "month").agg(side(0).alias("l"), side(1).alias("r"))
    size = lambda x: F.sqrt(F.avg(F.pow(x / 2, F.lit(2.0))))
    wide = both.groupBy("nation").agg((size(F.col("l") - F.col("r")) / (size(F.col("l") + F.col("r")) + 1e-10)).alias("wide"))
    tops = me.percentiles(c, ["nation"], "l_extendedprice", {"high": 0.995, "mid": 0.5}).select("nation", (F.col("high") / F.col("mid")).alias("cr"))
    g = g.join(wide, "nation").join(tops, "nation")
    a, b, k, d = ramp(F.col("occupied"), 0.5, 0.5), ramp(12 - 20 * F.log10("cr"), 0.0, 12.0), ramp(F.col("crowd"), 0.3, 0.6), ramp(F.col("dull"), 0.0, 1.0)
    s = g.select("nation", a.alias("a"), b.alias("b"), k.alias("c"), d.alias("d"), ramp(0.25 - F.col("wide"), 0.0, 0.25).alias("w"))
    score, grade = ju.difficulty(F.col("a"), F.col("b"), F.col("c"), F.col("w"), F.col("d"))
    return s.select("nation", score.alias("score"), grade.alias("grade"), ju.advice(F.col("a"), F.col("b"), F.col("c")).alias("advice"))



