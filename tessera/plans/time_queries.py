"""Queries of joins over time, runs, repairs and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pitch as pi
from ..functions import text as tx
from ..operators import metrics as me
from ..operators import music as mu
from ..operators import repair as rp
from ..operators import temporal as te
from ..sources import exports as ex
from .base import EV, HOUR, HOURLY, REV, events, hourly, query, r6, revenue, table

MINUTE = 60_000_000


def sections(spark, sf_dir):
    """user_id, seq, us0, us1, label: spans between a track's purchases, named by what began them."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    p = events(spark, sf_dir).filter("part = 'purchase'")
    return p.select("user_id", (F.row_number().over(w) - 1).alias("seq"), F.col("us").alias("us0"), F.lead("us").over(w).alias("us1"), F.concat(F.lit("s"), F.expr("cast(floor(value / 100) as string)")).alias("label")).filter("us1 is not null")


SEC = "sec AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS seq, us AS us0, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS us1, 's' || CAST(floor(value / 100) AS BIGINT) AS label FROM ev WHERE part = 'purchase' QUALIFY us1 IS NOT NULL)"


DISPLAY = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LABELS.items()) + " ELSE upper(label[1]) || label[2:] END"


@query(f"""WITH {EV} SELECT a.event_id AS point_id, b.event_id AS span_id FROM ev a JOIN ev b ON a.us >= b.us AND a.us < b.us + 1800000000 WHERE b.part = 'signup' AND a.part = 'click'""")
def interval_join(spark, sf_dir):
    """Clicks in the half hour from each signup on, by a bucketed range join."""
    e = events(spark, sf_dir)
    spans = e.filter("part = 'signup'").select(F.col("event_id").alias("span_id"), F.col("us").alias("lo"), (F.col("us") + 30 * MINUTE).alias("hi"))
    points = e.filter("part = 'click'").select(F.col("event_id").alias("point_id"), "us")
    return te.range_join(points, spans, "us", "lo", "hi", 30 * MINUTE).select("point_id", "span_id")


@query(f"""WITH {EV}, g AS (SELECT DISTINCT user_id, us FROM ev WHERE part = 'purchase'), c AS (SELECT e.event_id, e.us, g.us AS s, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.us - g.us), g.us) AS k FROM ev e LEFT JOIN g USING (user_id) WHERE e.part = 'click') SELECT event_id, us, s AS nearest FROM c WHERE k = 1""")
def nearest_snap(spark, sf_dir):
    """Each click's nearest purchase of its track, the earlier of a tie."""
    e = events(spark, sf_dir)
    done = te.nearest(e.filter("part = 'click'").select("event_id", "user_id", "us"), e.filter("part = 'purchase'"), "us", "us", ["user_id"], 48 * 60 * MINUTE)
    return done.select("event_id", "us", "nearest")


@query(f"""WITH {EV}, k AS (SELECT user_id, us AS x, (row_number() OVER (PARTITION BY user_id ORDER BY us) - 1) * 3600000000 AS y FROM (SELECT DISTINCT user_id, us FROM ev WHERE part = 'purchase')),
g AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS x1, lead(y) OVER (PARTITION BY user_id ORDER BY x) AS y1 FROM k), b AS (SELECT user_id, min(x) AS a, max(x) AS z, max(y) AS yz FROM k GROUP BY 1),
h AS (SELECT e.event_id, e.us, g.y + (e.us - x) * ((y1 - y) / CAST(x1 - x AS DOUBLE)) AS line, a, z, yz FROM ev e LEFT JOIN g ON g.user_id = e.user_id AND e.us >= x AND e.us < x1 LEFT JOIN b ON b.user_id = e.user_id WHERE e.part = 'click')
SELECT event_id, round(CASE WHEN line IS NOT NULL THEN line WHEN us = z THEN yz END / 1e6, 3) AS inside, round(CASE WHEN line IS NOT NULL THEN line WHEN us >= z THEN yz WHEN us < a THEN 0 END / 1e6, 3) AS held FROM h""")
def interp_warp(spark, sf_dir):
    """Clicks carried through a piecewise linear map (purchases to whole hours): null outside, and held."""
    e = events(spark, sf_dir)
    knots = e.filter("part = 'purchase'").select("user_id", "us").distinct().select("user_id", F.col("us").alias("x"), ((F.row_number().over(Window.partitionBy("user_id").orderBy("us")) - 1).cast("long") * 3_600_000_000).alias("y"))
    points = e.filter("part = 'click'").select("event_id", "user_id", "us")
    open_ = te.warp(points, knots, "us", "x", "y", ["user_id"], 48 * 60 * MINUTE).select("event_id", F.round(F.col("warped") / 1e6, 3).alias("inside"))
    held = te.warp(points, knots, "us", "x", "y", ["user_id"], 48 * 60 * MINUTE, clamp=True).select("event_id", F.round(F.col("warped") / 1e6, 3).alias("held"))
    return open_.join(held, "event_id")


@query(f"""WITH {EV}, {SEC}, d AS (SELECT user_id, us FROM ev WHERE part = 'view'), i AS (SELECT s.user_id, s.seq, d.us AS edge FROM sec s JOIN d ON d.user_id = s.user_id AND d.us >= s.us0 - 1 AND d.us < s.us1 - 1)
SELECT user_id, seq, edge, row_number() OVER (PARTITION BY user_id, seq ORDER BY edge) - 1 AS k FROM (SELECT * FROM i UNION SELECT user_id, seq, us1 FROM sec UNION SELECT user_id, seq, us0 FROM sec s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = s.user_id AND i.seq = s.seq))""")
def section_bars(spark, sf_dir):
    """The bar edges of each section: its downbeats (views) and its end; its start too where it has none."""
    s = sections(spark, sf_dir)
    d = events(spark, sf_dir).filter("part = 'view'").select("user_id", "us")
    early = s.select("user_id", "seq", (F.col("us0") - 1).alias("lo"), (F.col("us1") - 1).alias("hi"))  # a downbeat that rounding put before the start counts
    inside = te.range_join(d, early, "us", "lo", "hi", 48 * 60 * MINUTE, ["user_id"]).select("user_id", "seq", F.col("us").alias("edge"))
    bare = s.join(inside.select("user_id", "seq").distinct(), ["user_id", "seq"], "left_anti").select("user_id", "seq", F.col("us0").alias("edge"))
    edges = inside.unionByName(s.select("user_id", "seq", F.col("us1").alias("edge"))).unionByName(bare).distinct()
    return edges.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "seq").orderBy("edge")) - 1)


@query(f"""WITH {EV}, {SEC}, g AS (SELECT *, count(*) OVER (PARTITION BY user_id, label) AS n FROM sec) SELECT a.user_id, a.label, a.seq AS host, b.seq AS donor FROM g a JOIN g b ON a.user_id = b.user_id AND a.label = b.label AND a.seq <> b.seq WHERE a.n >= 2 AND a.label IN ('s0', 's1')""")
def repeat_pairs(spark, sf_dir):
    """Ordered pairs of sections of the same repeatable label."""
    s = sections(spark, sf_dir).filter("label in ('s0', 's1')")
    a, b = s.select("user_id", "label", F.col("seq").alias("host")), s.select("user_id", "label", F.col("seq").alias("donor"))
    return a.join(b, ["user_id", "label"]).filter("host <> donor").select("user_id", "label", "host", "donor")


@query(f"""WITH {EV} SELECT event_id, user_id, us // 3600000000 AS slot FROM ev e WHERE part = 'click' AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.part = 'view' AND o.user_id = e.user_id AND o.us // 3600000000 = e.us // 3600000000)""")
def dedupe_rounded(spark, sf_dir):
    """Clicks without a view of the same track and rounded time."""
    key = F.expr("us div 3600000000").alias("slot")
    e = events(spark, sf_dir)
    return e.filter("part = 'click'").select("event_id", "user_id", key).join(e.filter("part = 'view'").select("user_id", key).distinct(), ["user_id", "slot"], "left_anti").select("event_id", "user_id", "slot")


@query("""WITH p AS (SELECT p_partkey, 440.0 * pow(2.0, (p_size - 20) / 12.0) AS f0 FROM part), h AS (SELECT p_partkey, k AS harmonic, k * f0 AS f FROM p, (SELECT unnest(range(1, 15)) AS k)) SELECT p_partkey, harmonic, CAST(round(f * 4096 / 44100, 0) AS BIGINT) AS bin FROM h WHERE f < 0.92 * 22050 AND round(f * 4096 / 44100, 0) > 0 AND round(f * 4096 / 44100, 0) < 2048""")
def harmonic_explode(spark, sf_dir):
    """The spectral bins of each note's partials below the limit."""
    f0 = 440.0 * F.pow(F.lit(2.0), (F.col("p_size") - 20) / 12.0)
    h = table(spark, sf_dir, "part").select("p_partkey", f0.alias("f0"), F.explode(F.sequence(F.lit(1), F.lit(14))).alias("harmonic")).withColumn("f", F.col("harmonic") * F.col("f0"))
    return h.filter(F.col("f") < 0.92 * 22050).withColumn("bin", F.round(F.col("f") * 4096 / 44100).cast("long")).filter("bin > 0 and bin < 2048").select("p_partkey", "harmonic", "bin")


@query(f"""WITH {EV}, c AS (SELECT *, CASE WHEN lag(part) OVER (PARTITION BY user_id ORDER BY us, event_id) = part THEN 0 ELSE 1 END AS c FROM ev), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT user_id, run, part, min(us) AS us0, max(us) AS us1, count(*) AS size FROM r GROUP BY 1, 2, 3) SELECT user_id, CAST(run AS BIGINT) AS run, part, us0, us1, size, row_number() OVER (PARTITION BY user_id, part ORDER BY run) AS ordinal FROM g""")
def runs_islands(spark, sf_dir):
    """Runs of equal parts on each track, numbered by part."""
    e = events(spark, sf_dir).withColumn("us0", F.col("us")).withColumn("us1", F.col("us"))
    return te.merge_runs(e, ["user_id"], ["us", "event_id"], "part", "us0", "us1", F.expr(f"us div {24 * HOUR}")).select("user_id", "run", "part", "us0", "us1", "size", "ordinal")


MERGED = "CASE WHEN k > 1 AND k < z AND r[k - 1].label = r[k + 1].label THEN list_concat(list_append(r[1:k - 2], struct_pack(label := r[k - 1].label, n := r[k - 1].n + r[k].n + r[k + 1].n)), r[k + 2:]) WHEN k > 1 AND (k = z OR r[k - 1].n >= r[k + 1].n) THEN list_concat(list_append(r[1:k - 2], struct_pack(label := r[k - 1].label, n := r[k - 1].n + r[k].n)), r[k + 1:]) ELSE list_concat(list_append(r[1:k - 1], struct_pack(label := r[k + 1].label, n := r[k + 1].n + r[k].n)), r[k + 2:]) END"


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, us, event_id, part, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev), c AS (SELECT *, CASE WHEN lag(part) OVER (PARTITION BY user_id ORDER BY i) = part THEN 0 ELSE 1 END AS c FROM e), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c),
s AS (SELECT user_id, list(struct_pack(label := part, n := n) ORDER BY run) AS r FROM (SELECT user_id, run, any_value(part) AS part, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
m(user_id, it, r) AS (SELECT user_id, 0, r FROM s UNION ALL SELECT user_id, it + 1, {MERGED} FROM (SELECT user_id, it, r, len(r) AS z, list_position(list_transform(r, lambda x: x.n), list_min(list_transform(r, lambda x: x.n))) AS k FROM m) WHERE z > 1 AND r[k].n < 3),
l AS (SELECT user_id, arg_max(r, it) AS r FROM m GROUP BY 1), u AS (SELECT user_id, unnest(r) AS x, unnest(range(1, len(r) + 1)) AS j FROM l), w AS (SELECT user_id, x.label AS label, x.n AS n, sum(x.n) OVER (PARTITION BY user_id ORDER BY j) AS hi FROM u)
SELECT e.user_id, us, event_id, label AS merged FROM e JOIN w ON w.user_id = e.user_id AND e.i <= hi AND e.i > hi - n""")
def min_run_merge(spark, sf_dir):
    """Labels after the shortest runs under three are absorbed, again and again."""
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "part")
    return te.min_run_merge(e, ["user_id"], ["us", "event_id"], "part", 3, F.expr(f"us div {24 * HOUR}"))


CELLS = f"{HOURLY}, mx AS (SELECT hour, CAST(sum(amount) AS DOUBLE) AS m FROM hp GROUP BY hour), cl AS (SELECT part, hour, CAST(amount AS DOUBLE) AS v, m FROM hp JOIN mx USING (hour)), dm AS (SELECT *, v > 0.001 * max(v) OVER (PARTITION BY part) AND v / greatest(m, 1e-10) > 0.12 AS alive, m > 0.001 * max(m) OVER (PARTITION BY part) AND v / greatest(m, 1e-10) <= 0.12 AS lost FROM cl)"


def cells(spark, sf_dir):
    """part, hour, v, m (the hour's mix), alive, lost."""
    h = hourly(spark, sf_dir)
    m = h.groupBy("hour").agg(F.sum("amount").cast("double").alias("m"))
    return rp.damage(h.join(m, "hour").select("part", "hour", F.col("amount").cast("double").alias("v"), "m"), ["part"], "v", "m", -60.0, 0.12)


@query(f"""WITH {CELLS}, e AS (SELECT *, last_value(CASE WHEN alive THEN hour END IGNORE NULLS) OVER b AS a, last_value(CASE WHEN alive THEN v END IGNORE NULLS) OVER b AS va, first_value(CASE WHEN alive THEN hour END IGNORE NULLS) OVER f AS z, first_value(CASE WHEN alive THEN v END IGNORE NULLS) OVER f AS vz FROM dm
WINDOW b AS (PARTITION BY part ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY part ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, CASE WHEN NOT lost OR alive THEN 'kept' WHEN a IS NULL OR z IS NULL THEN 'outside' WHEN z - a - 1 <= 2 THEN 'repaired' ELSE 'refused' END AS status FROM e)
SELECT part, hour, status, round(CASE WHEN status = 'repaired' THEN greatest(v, least(exp(ln(greatest(va, 1e-10)) * (1 - (hour - a) / CAST(z - a AS DOUBLE)) + ln(greatest(vz, 1e-10)) * ((hour - a) / CAST(z - a AS DOUBLE))), m)) ELSE v END, 6) AS filled FROM s""")
def gap_fill(spark, sf_dir):
    """Short lost runs filled between alive cells under the mix; long ones refused."""
    done = rp.fill_gaps(cells(spark, sf_dir), ["part"], "hour", "v", "m", 2)
    return done.select("part", "hour", "status", r6(F.col("filled")).alias("filled"))


@query(f"""WITH {CELLS} SELECT part, hour, last_value(CASE WHEN alive THEN hour END IGNORE NULLS) OVER (PARTITION BY part ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_clean FROM dm""")
def last_clean(spark, sf_dir):
    return rp.last_clean(cells(spark, sf_dir), ["part"], "hour", "alive").select("part", "hour", "last_clean")


@query(f"""WITH {HOURLY} SELECT part, hour, amount, CAST(amount AS DOUBLE) >= 0.85 * CAST(max(amount) OVER (PARTITION BY part ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) AS is_peak FROM hp""")
def local_peaks(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    return rp.local_peaks(h, ["part"], "hour", "v").select("part", "hour", "amount", "is_peak")


@query(f"""WITH {HOURLY}, t AS (SELECT part, hour, CAST(amount AS DOUBLE) AS v, least(1.0, 400.0 / greatest(abs(CAST(amount AS DOUBLE)), 1e-10)) AS t FROM hp), m AS (SELECT *, min(t) OVER w AS m FROM t WINDOW w AS (PARTITION BY part ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT *, avg(m) OVER w AS s FROM m WINDOW w AS (PARTITION BY part ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), u AS (SELECT *, avg(s) OVER w AS u FROM s WINDOW w AS (PARTITION BY part ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT part, hour, round(least(u, t), 6) AS gain, round(v * least(u, t), 6) AS limited FROM u""")
def limiter_gain(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    return rp.limiter(h, ["part"], "hour", "v", 400.0).select("part", "hour", r6(F.col("gain")).alias("gain"), r6(F.col("limited")).alias("limited"))


@query(f"""WITH {CELLS}, x AS (SELECT part, hour // 24 AS day, hour % 24 AS hod, v, m, NOT lost AS clean FROM dm), p AS (SELECT h.part, h.day AS host, d.day AS donor, h.hod, h.v AS hv, d.v AS dv, h.clean AS hc FROM x h JOIN x d ON h.part = d.part AND h.hod = d.hod AND h.day <> d.day AND d.clean),
a AS (SELECT part, host, donor FROM p WHERE hc GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND round(corr(ln(greatest(hv, 1e-10)), ln(greatest(dv, 1e-10))), 6) >= 0.3),
b AS (SELECT part, host AS day, hod, quantile_cont(dv, 0.5) AS b, count(*) AS donors FROM p JOIN a USING (part, host, donor) WHERE NOT hc GROUP BY 1, 2, 3)
SELECT part, day, hod, coalesce(NOT clean AND least(b, m) > v, false) AS borrowed, round(CASE WHEN coalesce(NOT clean AND least(b, m) > v, false) THEN least(b, m) ELSE v END, 6) AS restored, coalesce(donors, 0) AS donors FROM x LEFT JOIN b USING (part, day, hod)""")
def borrow_repeat(spark, sf_dir):
    """Lost hours of a day borrow the median of agreeing days, under the mix."""
    x = cells(spark, sf_dir).select("part", F.expr("hour div 24").alias("day"), (F.col("hour") % 24).alias("hod"), "v", "m", (~F.col("lost")).alias("clean"))
    done = rp.borrow(x, ["part"], "day", "hod", "v", "m", "clean", 10, 0.3)
    return done.select("part", "day", "hod", "borrowed", r6(F.col("restored")).alias("restored"), "donors")


@query(f"""WITH {REV}, c AS (SELECT l_suppkey AS note, month AS frame, l_linenumber AS partial, CAST(sum(price) AS DOUBLE) AS v FROM li GROUP BY 1, 2, 3), x AS (SELECT *, max(v) OVER (PARTITION BY note, frame) * 1.2 AS parent, v >= 20000 AS clean FROM c),
q AS (SELECT note, partial, quantile_cont(v, 0.5) AS q FROM x WHERE clean GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT * FROM x JOIN q USING (note, partial)),
f AS (SELECT note, frame, round(sum(v * q) FILTER (clean) / sum(q * q) FILTER (clean), 9) AS level, count(*) FILTER (clean) AS sib FROM b GROUP BY 1, 2), e AS (SELECT note, frame, sum(abs(v - level * q)) / greatest(sum(v), 1e-10) AS error FROM b JOIN f USING (note, frame) WHERE clean GROUP BY 1, 2),
u AS (SELECT *, NOT clean AND sib >= 3 AND round(error, 6) <= 0.45 AND least(level * q, parent) > v AS raised FROM b JOIN f USING (note, frame) JOIN e USING (note, frame)) SELECT note, frame, partial, raised, round(CASE WHEN raised THEN least(level * q, parent) ELSE v END, 4) AS restored FROM u""")
def harmonic_lsq(spark, sf_dir):
    """Damaged partials raised to the level that fits the clean ones, under their parent."""
    li = revenue(spark, sf_dir).select(F.col("l_suppkey").alias("note"), F.col("month").alias("frame"), F.col("l_linenumber").alias("partial"), "price").repartition("note", "frame")
    c = li.groupBy("note", "frame", "partial").agg(F.sum("price").cast("double").alias("v"))
    x = c.withColumn("parent", F.max("v").over(Window.partitionBy("note", "frame")) * 1.2).withColumn("clean", F.col("v") >= 20000)
    return rp.harmonic_fit(x, ["note"], ["frame"], "partial", "v", "parent", "clean").select("note", "frame", "partial", "raised", F.round("restored", 4).alias("restored"))


@query(f"""WITH {CELLS}, t AS (SELECT part, hour % 24 AS hod, avg(v) AS tv FROM dm WHERE NOT lost GROUP BY 1, 2), x AS (SELECT dm.*, coalesce(tv, 0) AS tv FROM dm LEFT JOIN t ON t.part = dm.part AND t.hod = dm.hour % 24) SELECT part, hour, lost AND tv > 1.5 * v AS taken, round(CASE WHEN lost AND tv > 1.5 * v THEN greatest(v, least(tv, m)) ELSE v END, 6) AS restored FROM x""")
def template_fill(spark, sf_dir):
    """Lost cells take the hour's usual value where it exceeds them clearly, under the mix."""
    c = cells(spark, sf_dir).withColumn("hod", F.col("hour") % 24)
    t = c.filter(~F.col("lost")).groupBy("part", "hod").agg(F.avg("v").alias("tv"))
    x = c.join(t, ["part", "hod"], "left").withColumn("tv", F.coalesce("tv", F.lit(0.0)))
    return rp.fill_from_template(x, "v", "m", "tv", "lost").select("part", "hour", "taken", r6(F.col("restored")).alias("restored"))


@query(f"""WITH {EV}, n AS (SELECT user_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM ev), p AS (SELECT user_id, b AS beats, i % b AS phase, avg(v) AS m FROM n, (VALUES (4), (3)) t(b) GROUP BY 1, 2, 3),
s AS (SELECT *, round(max(m) OVER (PARTITION BY user_id, beats) - avg(m) OVER (PARTITION BY user_id, beats), 9) AS contrast, row_number() OVER (PARTITION BY user_id, beats ORDER BY m DESC, phase) AS r FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY contrast DESC, beats DESC) AS b FROM s WHERE r = 1) SELECT user_id, beats, CAST(phase AS BIGINT) AS phase, contrast FROM t WHERE b = 1""")
def meter_phase(spark, sf_dir):
    done = mu.meter(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "value")
    return done.select("user_id", "beats", F.col("phase").cast("long").alias("phase"), "contrast")


@query(f"""WITH {EV}, n AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM ev WHERE part = 'view'),
b AS (SELECT user_id, quantile_cont(d, 0.5) AS period, min(t) AS first, max(t) AS last, count(*) AS beats FROM n GROUP BY 1 HAVING count(*) >= 4), o AS (SELECT user_id, max(abs(t - (first + i * period))) * 1000 AS drift FROM n JOIN b USING (user_id) GROUP BY 1)
SELECT b.user_id, CAST(k AS BIGINT) AS k, round(first + k * period, 3) AS t, k % 4 = 0 AS is_downbeat, round(drift, 0) AS drift_ms FROM b JOIN o USING (user_id), LATERAL (SELECT unnest(range(0, CAST(floor((last - first) / period) AS BIGINT) + 1)) AS k)""")
def steady_grid(spark, sf_dir):
    """A constant grid at each track's median step, and how far the views leave it."""
    d = mu.drift(events(spark, sf_dir).filter("part = 'view'"), ["user_id"], ["us", "event_id"], "t")
    return mu.grid(d, 4).select("user_id", "k", F.round("t", 3).alias("t"), "is_downbeat", F.round("drift_ms", 0).alias("drift_ms"))


KEYS_SQL = "kt AS (SELECT key, mode, d AS degree, CASE mode WHEN 'major' THEN ([{0}])[(d - key + 12) % 12 + 1] ELSE ([{1}])[(d - key + 12) % 12 + 1] END AS weight FROM (SELECT unnest(range(0, 12)) AS key), (VALUES ('major'), ('minor')) m(mode), (SELECT unnest(range(0, 12)) AS d))".format(
    ", ".join(f"{x}::DOUBLE" for x in pi.MAJOR), ", ".join(f"{x}::DOUBLE" for x in pi.MINOR)
)


@query(f"""WITH {REV}, {KEYS_SQL}, p AS (SELECT l_returnflag || l_linestatus AS part, month % 12 AS degree, CAST(sum(price) AS DOUBLE) AS v FROM li GROUP BY 1, 2), r AS (SELECT part, key, mode, round(corr(v, weight), 6) AS r FROM p JOIN kt USING (degree) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY r DESC, key DESC, mode DESC) AS n FROM r), t AS (SELECT part, max(key) FILTER (n = 1) AS key, max(mode) FILTER (n = 1) AS mode, max(r) FILTER (n = 1) AS r1, max(r) FILTER (n = 2) AS r2 FROM k GROUP BY 1)
SELECT part, CAST(key AS INTEGER) AS key, mode, r1 AS r, round(greatest(0.0, least(1.0, (r1 - r2) * 4 + r1)), 6) AS confidence FROM t""")
def key_profile(spark, sf_dir):
    """The key whose template fits each part's monthly profile best."""
    p = revenue(spark, sf_dir).groupBy(F.concat("l_returnflag", "l_linestatus").alias("part"), (F.col("month") % 12).alias("deg")).agg(F.sum("price").cast("double").alias("v"))
    done = mu.detect_key(p, ["part"], "deg", "v")
    return done.select("part", F.col("key1").alias("key"), F.col("mode1").alias("mode"), F.col("r1").alias("r"), "confidence")


@query(f"""WITH {EV}, {SEC}, s AS (SELECT user_id, label, count(*) AS n, round(avg(CAST(us1 - us0 AS DOUBLE)), 6) AS e, sum(us1 - us0) AS span FROM sec GROUP BY 1, 2), m AS (SELECT *, max(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS many FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN many = 0 OR n >= 2 THEN 1 ELSE 0 END DESC, n DESC, e DESC, label DESC) AS c FROM m), v AS (SELECT *, CASE WHEN c > 1 THEN row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN c > 1 THEN 0 ELSE 1 END, n DESC, span DESC, label DESC) END AS v FROM c),
p AS (SELECT q.user_id, q.seq, q.label, q.us0, row_number() OVER (PARTITION BY q.user_id ORDER BY us0) AS i, count(*) OVER (PARTITION BY q.user_id) AS size, n, c, v FROM sec q JOIN v ON v.user_id = q.user_id AND v.label = q.label),
l AS (SELECT user_id, seq, CASE WHEN c = 1 THEN 'chorus' WHEN i = 1 AND NOT coalesce(v = 1, false) THEN 'intro' WHEN i = size AND NOT coalesce(v = 1, false) THEN 'outro' WHEN n = 1 AND coalesce(v, 0) <> 1 THEN 'bridge' ELSE 'verse' END AS label FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY seq) AS k FROM l) SELECT user_id, seq, label, {DISPLAY} || CASE WHEN label IN ('verse', 'chorus', 'bridge') THEN ' ' || k ELSE '' END AS display FROM o""")
def segment_label(spark, sf_dir):
    """Sections named chorus, verse, intro, outro or bridge, and numbered."""
    s = sections(spark, sf_dir).withColumnRenamed("label", "cluster").withColumn("energy", (F.col("us1") - F.col("us0")).cast("double"))
    named = mu.label_segments(s, ["user_id"], "cluster", "energy", "us0", "us1")
    k = F.row_number().over(Window.partitionBy("user_id", "label").orderBy("seq"))
    return named.withColumn("k", k).select("user_id", "seq", "label", tx.display_label(F.col("label"), F.col("k")).alias("display"))


@query(f"""WITH {EV}, n AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS step, (event_id % 4) = 0 AS down FROM ev WHERE part = 'view'),
s AS (SELECT user_id, min(t) AS f, quantile_cont(step, 0.5) AS p FROM n GROUP BY 1), e AS (SELECT user_id, t AS at_, CASE WHEN down THEN 'accent' ELSE 'normal' END AS kind FROM n UNION ALL SELECT user_id, f - p * (8 - k), CASE WHEN k % 4 = 0 THEN 'count_in_accent' ELSE 'count_in' END FROM s, (SELECT unnest(range(0, 8)) AS k) WHERE p IS NOT NULL),
x AS (SELECT * FROM e UNION ALL SELECT n.user_id, t + p * 0.5, 'sub' FROM n JOIN s USING (user_id) WHERE p IS NOT NULL), o AS (SELECT user_id, greatest(0.0, -(min(at_) - 0.15)) AS offs FROM x GROUP BY 1) SELECT user_id, round(at_ + offs, 3) AS t, kind, round(offs, 3) AS offset_s FROM x JOIN o USING (user_id)""")
def click_events(spark, sf_dir):
    """Accents, beats and half beats of each track with a count-in of two bars."""
    v = events(spark, sf_dir).filter("part = 'view'")
    done = mu.click_events(v, ["user_id"], "t", F.col("event_id") % 4 == 0, 2, 4, 2)
    return done.select("user_id", F.round("at", 3).alias("t"), "kind", F.round("offset", 3).alias("offset_s"))


@query(f"""WITH {EV}, {SEC} SELECT user_id, seq, label || ',' || CAST((us0 + 2000000 + 500) // 1000 // 1000 AS VARCHAR) || '.' || lpad(CAST((us0 + 2000000 + 500) // 1000 % 1000 AS VARCHAR), 3, '0') || ',' || CAST((us1 + 2000000 + 500) // 1000 // 1000 AS VARCHAR) || '.' || lpad(CAST((us1 + 2000000 + 500) // 1000 % 1000 AS VARCHAR), 3, '0') || ',' || CAST((us1 - us0 + 500) // 1000 // 1000 AS VARCHAR) || '.' || lpad(CAST((us1 - us0 + 500) // 1000 % 1000 AS VARCHAR), 3, '0') || ',section' AS marker,
printf('%02d:%02d:%02d', CAST((us0 // 1000000 + 2) // 60 AS INTEGER), CAST((us0 // 1000000 + 2) % 60 AS INTEGER), CAST(least(74, (us0 % 1000000) * 75 // 1000000) AS INTEGER)) AS cue, greatest(1, CAST(round_even((us1 - us0) / 1e6 / 3600, 0) AS BIGINT)) AS bars FROM sec""")
def marker_export(spark, sf_dir):
    """Section markers, cue times at 75 frames a second, and bars of an hour (halves to even)."""
    s = sections(spark, sf_dir)
    return s.select("user_id", "seq", ex.marker_line(F.col("label"), F.col("us0"), F.col("us1"), 2_000_000).alias("marker"), ex.cue_time(F.col("us0") + 2_000_000).alias("cue"), ex.bars((F.col("us1") - F.col("us0")) / 1e6, 3600.0).alias("bars"))


@query(f"""WITH {EV}, {SEC}, e AS (SELECT user_id, seq, us0, us1, CAST(1800000000 AS BIGINT) AS lead, row_number() OVER (PARTITION BY user_id ORDER BY us0) AS i FROM sec) SELECT user_id, seq, round((CASE WHEN i = 1 THEN greatest(0, us0 - lead // 2) ELSE us0 - lead * 3 END) / 1e6, 3) AS cue_at FROM e""")
def cue_align(spark, sf_dir):
    """Cues end a lead of three steps before their section; the first one half a step."""
    s = sections(spark, sf_dir)
    return ex.cue_times(s, ["user_id"], "us0", 1_800_000_000).select("user_id", "seq", F.round(F.col("cue_us") / 1e6, 3).alias("cue_at"))


@query(f"""WITH {EV}, n AS (SELECT user_id, us, t, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM ev), d AS (SELECT user_id, us, t, 240.0 / nullif(lead(t) OVER (PARTITION BY user_id ORDER BY t) - t, 0) AS bpm FROM n WHERE i % 16 = 0), m AS (SELECT user_id, us, t, coalesce(bpm, lag(bpm) OVER (PARTITION BY user_id ORDER BY t)) AS bpm FROM d)
SELECT user_id, '[' || string_agg('{{"time":' || CAST((us + 500) // 1000 // 1000 AS VARCHAR) || '.' || lpad(CAST((us + 500) // 1000 % 1000 AS VARCHAR), 3, '0') || ',"bpm":' || printf('%.6f', bpm) || '}}', ',' ORDER BY t) || ']' AS tempo FROM m WHERE bpm IS NOT NULL GROUP BY user_id""")
def tempo_map_json(spark, sf_dir):
    """Each track's tempo map as one JSON text."""
    n = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1).filter("i % 16 = 0")
    m = me.tempo_map(n, ["user_id"], "t", 4).filter("bpm is not null")
    row = F.concat(F.lit('{"time":'), ex.seconds_text(F.col("us")), F.format_string(',"bpm":%.6f}', F.col("bpm")))
    return m.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", row.alias("row")))).alias("rows")).select("user_id", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias("tempo"))


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 600000000 THEN 0 ELSE 1 END AS c FROM ev), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n, min(us) AS us0, max(us) AS us1 FROM s GROUP BY 1, 2""")
def session_rate(spark, sf_dir):
    """Sessions of a track: events no more than ten minutes apart."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("c", F.when(F.col("us") - F.lag("us").over(w) <= 10 * MINUTE, 0).otherwise(1)).withColumn("session", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("us0"), F.max("us").alias("us1"))


@query(f"""WITH {EV}, w AS (SELECT user_id, us, event_id, round(value, 2) AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev), x AS (SELECT *, lag(v) OVER q AS p, lead(v) OVER q AS n, min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lo, min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS hi FROM w WINDOW q AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, event_id, v FROM x WHERE v > p AND v >= n AND v - greatest(lo, hi) >= 100""")
def peak_pick(spark, sf_dir):
    """Local maxima that stand out from the lowest on both sides."""
    e = events(spark, sf_dir).select("user_id", "event_id", "us", F.round("value", 2).alias("v"))
    return ex.prominent(e, ["user_id"], ["us", "event_id"], "v", 6, 100.0).select("user_id", "event_id", "v")


@query(f"""WITH {EV}, r AS (SELECT event_id, user_id, us, CAST(floor(value) AS BIGINT) AS p FROM ev WHERE part = 'click'), e AS (SELECT event_id, user_id, us, CAST(floor(value) AS BIGINT) AS p FROM ev WHERE part = 'view'), m AS (SELECT e.event_id AS est, r.event_id AS ref_, abs(e.us - r.us) AS d, e.p AS ep, r.p AS rp FROM e JOIN r ON e.user_id = r.user_id AND abs(e.us - r.us) <= 7200000000),
b AS (SELECT est, ref_, row_number() OVER (PARTITION BY est ORDER BY d, ref_) AS k, row_number() OVER (PARTITION BY ref_ ORDER BY d, est) AS j FROM m WHERE abs(ep - rp) <= 30), o AS (SELECT DISTINCT est FROM m WHERE ep <> rp AND (ep - rp) % 12 = 0)
SELECT (SELECT count(*) FROM r) AS reference, (SELECT count(*) FROM e) AS estimated, (SELECT count(*) FROM b WHERE k = 1 AND j = 1) AS matched, (SELECT count(*) FROM o) AS octave_errors""")
def note_match(spark, sf_dir):
    """Estimated notes that match a reference in time and pitch, each other's closest, and octave errors."""
    e = events(spark, sf_dir).withColumn("p", F.floor("value"))
    ref = e.filter("part = 'click'").select(F.col("event_id").alias("ref"), "user_id", F.col("us").alias("rus"), F.col("p").alias("rp"))
    est = e.filter("part = 'view'").select(F.col("event_id").alias("est"), "user_id", "us", F.col("p").alias("ep"))
    return ex.match_notes(est, ref, ["user_id"], 7_200_000_000, 30)
