"""Queries of voices, chords, envelopes and spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import music as mu
from ..operators import spectral as sp
from ..operators import temporal as te
from .base import EV, HOURLY, REV, events, hourly, query, r6, revenue, table


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def voices(spark, sf_dir):
    """piece, s, a, t, b and what orders a piece: four voices made of line items."""
    s = 62 + F.col("l_quantity").cast("long") % 20
    a = s - 2 - F.col("l_partkey") % 12
    t = a - 2 - F.col("l_linenumber") * 2
    b = t - 3 - F.col("l_orderkey") % 20
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("piece"), *ORDER, s.alias("s"), a.alias("a"), t.alias("t"), b.alias("b"))


def chords(spark, sf_dir):
    """piece, idx, s, a, t, b: the voices, numbered."""
    idx = F.row_number().over(Window.partitionBy("piece").orderBy(*ORDER))
    return voices(spark, sf_dir).select("piece", idx.cast("long").alias("idx"), "s", "a", "t", "b")


CHORDS = """c0 AS (SELECT l_suppkey AS piece, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS idx, 62 + CAST(l_quantity AS BIGINT) % 20 AS s, l_partkey % 12 AS da, l_linenumber AS dt, l_orderkey % 20 AS db FROM lineitem),
ch AS (SELECT piece, idx, s, s - 2 - da AS a, s - 4 - da - dt * 2 AS t, s - 7 - da - dt * 2 - db AS b FROM c0)"""


def rules_sql() -> str:
    out = []
    for v in mu.VOICES:
        low, high = mu.RANGES[v]
        out += [f"SELECT piece, idx, 'range' AS rule, '{v}' AS voices FROM n WHERE {v} < {low} OR {v} > {high}", f"SELECT piece, idx, 'leap', '{v}' FROM n WHERE abs({v}_ - {v}) > {mu.LEAPS[v]}"]
    for (x, y), most in mu.SPACING.items():
        out += [f"SELECT piece, idx, 'spacing', '{x}{y}' FROM n WHERE {x} - {y} > {most}", f"SELECT piece, idx, 'crossing', '{x}{y}' FROM n WHERE {x} < {y}"]
    for x, y in mu.PAIRS:
        for interval, rule in ((7, "fifths"), (0, "octaves")):
            out.append(f"SELECT piece, idx, '{rule}', '{x}{y}' FROM n WHERE ({x}_ - {x}) * ({y}_ - {y}) > 0 AND (({x} - {y}) % 12 + 12) % 12 = {interval} AND (({x}_ - {y}_) % 12 + 12) % 12 = {interval}")
    return " UNION ALL ".join(out)


@query(f"""WITH {CHORDS}, n AS (SELECT *, {', '.join(f'lead({v}) OVER (PARTITION BY piece ORDER BY idx) AS {v}_' for v in mu.VOICES)} FROM ch) SELECT piece, rule, voices, count(*) AS broken FROM ({rules_sql()}) GROUP BY 1, 2, 3""")
def satb_rules(spark, sf_dir):
    """How often each piece breaks each rule of voice leading."""
    return mu.violations(chords(spark, sf_dir), ["piece"], "idx").groupBy("piece", "rule", "voices").agg(F.count("*").alias("broken"))


@query(f"""WITH {EV}, o AS (SELECT DISTINCT user_id, us FROM ev WHERE part <> 'error'), n AS (SELECT user_id, part, us AS lo, us + 7200000000 AS hi, CAST(floor(value) AS BIGINT) AS p FROM ev WHERE part <> 'error'),
j AS (SELECT o.user_id, o.us, n.part, n.p, row_number() OVER (PARTITION BY o.user_id, o.us, n.part ORDER BY lo DESC, p DESC) AS k FROM o JOIN n ON n.user_id = o.user_id AND o.us >= lo AND o.us < hi)
SELECT user_id, us, max(p) FILTER (part = 'click') AS s, max(p) FILTER (part = 'view') AS a, max(p) FILTER (part = 'purchase') AS t, max(p) FILTER (part = 'signup') AS b FROM j WHERE k = 1 GROUP BY 1, 2""")
def satb_sampling(spark, sf_dir):
    """At each onset of a track the note that sounds in each voice, the latest begun."""
    e = events(spark, sf_dir).filter("part <> 'error'")
    onsets = e.select("user_id", "us").distinct()
    notes = e.select("user_id", "part", F.col("us").alias("lo"), (F.col("us") + 7_200_000_000).alias("hi"), F.floor("value").alias("p"))
    j = te.range_join(onsets, notes, "us", "lo", "hi", 7_200_000_000, ["user_id"])
    of = lambda part: F.max(F.when(F.col("part") == part, F.struct("lo", "p")))["p"]
    return j.groupBy("user_id", "us").agg(of("click").alias("s"), of("view").alias("a"), of("purchase").alias("t"), of("signup").alias("b"))


RANGE = {v: f"(SELECT unnest(range({lo}, {hi + 1})) AS {v})" for v, (lo, hi) in mu.RANGES.items()}


TONES = " AND ".join(f"{v} % 12 IN (root, (root + 4) % 12, (root + 7) % 12)" for v in mu.VOICES)
THIRDS = " + ".join(f"CASE WHEN {v} % 12 = (root + 4) % 12 THEN 1 ELSE 0 END" for v in mu.VOICES)


@query(f"""WITH c AS (SELECT CAST(l_partkey % 12 AS INTEGER) AS root, count(*) AS n FROM lineitem GROUP BY 1) SELECT root, n, CAST(s AS BIGINT) AS s, CAST(a AS BIGINT) AS a, CAST(t AS BIGINT) AS t, CAST(b AS BIGINT) AS b FROM c, {RANGE['s']} s, {RANGE['a']} a, {RANGE['t']} t, {RANGE['b']} b
WHERE {TONES} AND a <= s AND t <= a AND b <= t AND s - a <= 12 AND a - t <= 12 AND t - b <= 24 AND root IN (s % 12, a % 12, t % 12, b % 12) AND {THIRDS} <= 1""")
def satb_voicings(spark, sf_dir):
    """All placements in four voices of each major chord that the line items have, and how many of them have it."""
    chord = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 12).cast("int").alias("root")).agg(F.count("*").alias("n"))
    every = None
    for root in range(12):
        one = mu.voicings(spark, [root, (root + 4) % 12, (root + 7) % 12], root, (root + 4) % 12).withColumn("root", F.lit(root))
        every = one if every is None else every.unionByName(one)
    return chord.join(every, "root").select("root", "n", *(F.col(v).cast("long").alias(v) for v in mu.VOICES))


#: A progression: classes, root and third of each chord, and its melody note: G, D, Em, C.
PROGRESSION = [([7, 11, 2], 7, 11, 71), ([2, 6, 9], 2, 6, 69), ([4, 7, 11], 4, 7, 67), ([0, 4, 7], 0, 4, 64)]


def move_sql() -> tuple[str, str]:
    """Whether a move from voicing p to n is legal, and its cost."""
    legal = [f"abs(n.{v} - p.{v}) <= {mu.LEAPS[v]}" for v in mu.VOICES]
    for x, y in mu.PAIRS:
        both = f"n.{x} <> p.{x} AND n.{y} <> p.{y} AND sign(n.{x} - p.{x}) = sign(n.{y} - p.{y})"
        legal += [f"NOT ({both} AND (p.{x} - p.{y} + 120) % 12 = {i} AND (n.{x} - n.{y} + 120) % 12 = {i})" for i in (7, 0)]
    moves = " + ".join(f"{mu.MOVES[v]} * abs(n.{v} - p.{v})" for v in mu.VOICES) + " - 0.5 * (" + " + ".join(f"CASE WHEN n.{v} = p.{v} THEN 1 ELSE 0 END" for v in mu.VOICES) + ")"
    return " AND ".join(legal), moves


def chain_sql(own: str = "0.0") -> str:
    """The cheapest path through the progression's voicings; own: what a voicing costs by itself."""
    layers = []
    for k, (classes, root, third, melody) in enumerate(PROGRESSION):
        tones = " AND ".join(f"{v} % 12 IN ({', '.join(map(str, classes))})" for v in mu.VOICES)
        spaced = " AND ".join(f"{x} - {y} BETWEEN 0 AND {most}" for (x, y), most in mu.SPACING.items())
        thirds = " + ".join(f"CASE WHEN {v} % 12 = {third} THEN 1 ELSE 0 END" for v in mu.VOICES)
        ranges = ", ".join(f"{RANGE[v]} {v}_" for v in mu.VOICES)
        layers.append(f"l{k} AS (SELECT s, a, t, b, round({own}, 6) AS own, concat_ws(',', s, a, t, b) AS txt FROM {ranges} WHERE s = {melody} AND {tones} AND {spaced} AND {root} IN (s % 12, a % 12, t % 12, b % 12) AND {thirds} <= 1)")
    legal, moves = move_sql()
    steps = ["c0 AS (SELECT s, a, t, b, own AS cost, txt AS path FROM l0)"]
    for k in range(1, len(PROGRESSION)):
        steps.append(f"c{k} AS (SELECT s, a, t, b, m.cost AS cost, m.path AS path FROM (SELECT n.s, n.a, n.t, n.b, min(struct_pack(cost := round(CAST(p.cost + {moves} + n.own AS DOUBLE), 6), path := p.path || ' ' || n.txt)) AS m FROM c{k - 1} p, l{k} n WHERE {legal} GROUP BY 1, 2, 3, 4))")
    return f"WITH {', '.join(layers)}, {', '.join(steps)}, f AS (SELECT min(struct_pack(cost := CAST(cost AS DOUBLE), path := path)) AS m FROM c{len(PROGRESSION) - 1}) SELECT m.cost AS cost, m.path AS path FROM f WHERE m IS NOT NULL"


def progression(spark):
    """The voicings of each chord of the progression, by k."""
    layers = None
    for k, (classes, root, third, melody) in enumerate(PROGRESSION):
        one = mu.voicings(spark, classes, root, third, melody).withColumn("k", F.lit(k))
        layers = one if layers is None else layers.unionByName(one)
    return layers


@query(chain_sql())
def satb_viterbi(spark, sf_dir):
    """The cheapest legal path through G, D, Em, C under a given melody."""
    return mu.cheapest_chain(progression(spark), "k", list(mu.VOICES), len(PROGRESSION), mu.transition, ("s", mu.LEAPS["s"]))


@query(f"""WITH {CHORDS} SELECT piece, round(avg(s), 6) AS mean_s, round(avg(s - a), 6) AS mean_sa, round(avg(a - t), 6) AS mean_at, round(avg(t - b), 6) AS mean_tb, round(stddev_pop(s), 6) AS sd_s, round(stddev_pop(s - a), 6) AS sd_sa, round(stddev_pop(a - t), 6) AS sd_at, round(stddev_pop(t - b), 6) AS sd_tb,
round(avg(CASE WHEN s = a OR a = t OR t = b THEN 1.0 ELSE 0.0 END) * 100, 6) AS unison_pct FROM ch GROUP BY 1""")
def style_profile(spark, sf_dir):
    done = mu.style(chords(spark, sf_dir), ["piece"])
    return done.select("piece", *(r6(F.col(c)).alias(c) for c in done.columns if c != "piece"))


@query(f"""WITH {CHORDS}, l AS ({' UNION ALL '.join(f"SELECT piece, idx, '{v}' AS voice, {v} AS p, {mu.RANGES[v][0]} AS lo, {mu.RANGES[v][1]} AS hi FROM ch" for v in mu.VOICES)}), d AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY piece, voice ORDER BY idx)) AS d FROM l)
SELECT piece, voice, round(100 * coalesce(avg(CASE WHEN d > 0 THEN (d <= 2)::INT::DOUBLE END), 0), 6) AS step_pct, round(100 * coalesce(avg(CASE WHEN d > 0 THEN (d > 5)::INT::DOUBLE END), 0), 6) AS leap_pct,
round(100 * avg((p <= lo + 0.15 * (hi - lo) OR p >= hi - 0.15 * (hi - lo))::INT::DOUBLE), 6) AS edge_pct, round(100 * coalesce(avg(CASE WHEN d IS NOT NULL THEN (d = 0)::INT::DOUBLE END), 0), 6) AS static_pct FROM d GROUP BY 1, 2""")
def singability(spark, sf_dir):
    return mu.singability(voices(spark, sf_dir), ["piece"], ORDER)


@query(f"""WITH {REV}, o AS (SELECT l_returnflag AS part, CAST(l_quantity AS INTEGER) AS q, avg(CAST(price AS DOUBLE)) AS v FROM li GROUP BY 1, 2), l AS (SELECT part, q / 10.0 AS x, log10(v) - avg(log10(v)) OVER (PARTITION BY part) AS a FROM o),
g AS (SELECT unnest(range(0, 96)) AS k), r AS (SELECT part, k, sum(exp(-pow((k * 5.0 / 95 - x) / 0.16, 2) / 2) * a) / greatest(sum(exp(-pow((k * 5.0 / 95 - x) / 0.16, 2) / 2)), 1e-10) AS e FROM l, g GROUP BY 1, 2)
SELECT part, k, round(pow(10, e - max(e) OVER (PARTITION BY part)), 6) AS envelope FROM r""")
def kernel_envelope(spark, sf_dir):
    """Gaussian regression of centred log amplitudes on a 96-point grid of octaves, scaled to a peak of 1."""
    o = revenue(spark, sf_dir).groupBy(F.col("l_returnflag").alias("part"), F.col("l_quantity").cast("int").alias("q")).agg(F.avg(F.col("price").cast("double")).alias("v"))
    per = Window.partitionBy("part")
    line = o.select("part", (F.col("q") / 10.0).alias("x"), (F.log10("v") - F.avg(F.log10("v")).over(per)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(95))).alias("k"))
    w = F.exp(-F.pow((F.col("k") * 5.0 / 95 - F.col("x")) / 0.16, F.lit(2.0)) / 2)
    r = line.groupBy("part", "k").agg((F.sum(w * F.col("a")) / F.greatest(F.sum(w), F.lit(1e-10))).alias("e"))
    return r.select("part", "k", r6(F.pow(F.lit(10.0), F.col("e") - F.max("e").over(per))).alias("envelope"))


@query(f"""WITH {HOURLY}, n AS (SELECT part, CAST(amount AS DOUBLE) AS v, (row_number() OVER (PARTITION BY part ORDER BY hour) - 1) // 64 AS frame FROM hp) SELECT part, frame, round(sum(v * v), 4) AS energy, round(sum(v * v), 4) AS time_energy FROM n GROUP BY 1, 2 HAVING count(*) = 64""")
def stft_energy(spark, sf_dir):
    """FFT energy of each part's frames; it equals that of the samples."""
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    return sp.frame_energy(h, "part", "hour", "v", 64)
