"""Queries of allocation, trees and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import exact, ratio_db, rms
from ..operators import allocate as al
from ..operators import metrics as me
from ..operators import tree as tr
from .base import EV, HOURLY, NODES, REV, events, hourly, nodes, query, r6, revenue, table

# The band of each part, for bands over the hour of the day.
BANDS = {"click": (100.0, 400.0), "error": (300.0, 500.0), "purchase": (150.0, 300.0), "signup": (600.0, 900.0)}


@query(f"""WITH {HOURLY}, x AS (SELECT hour, part, amount, sum(amount) OVER (PARTITION BY hour) AS parent, pow(CAST(amount AS DOUBLE), 2) AS w FROM hp),
y AS (SELECT *, CAST(w / sum(w) OVER (PARTITION BY hour) * CAST(parent AS DOUBLE) AS DECIMAL(18,4)) AS y, row_number() OVER (PARTITION BY hour ORDER BY amount DESC, part) AS k FROM x)
SELECT hour, part, CAST(parent AS DECIMAL(18,4)) AS parent, CAST(y + CASE WHEN k = 1 THEN parent - sum(y) OVER (PARTITION BY hour) ELSE 0 END AS DECIMAL(18,4)) AS allocated FROM y""")
def alloc_exact(spark, sf_dir):
    """Each hour's total over its parts by the square of their amounts; children sum to the parent."""
    h = hourly(spark, sf_dir)
    mix = h.groupBy("hour").agg(exact(F.sum("amount")).alias("parent"))
    return al.allocate(h.join(mix, "hour"), ["hour"], "part", "amount", "parent").select("hour", "part", "parent", "allocated")


@query(f"""WITH {HOURLY}, m AS (SELECT hour, sum(amount) AS parent, sum(amount) FILTER (part <> 'view') AS others FROM hp GROUP BY hour)
SELECT hour, part, amount AS allocated FROM hp WHERE part <> 'view' UNION ALL SELECT hour, 'view', CAST(parent - coalesce(others, 0) AS DECIMAL(18,4)) FROM m""")
def alloc_residual(spark, sf_dir):
    """Parts keep their amounts; the residual part gets what they leave."""
    h = hourly(spark, sf_dir)
    mix = h.groupBy("hour").agg(F.sum("amount").alias("parent"))
    return al.residual(h.join(mix, "hour"), ["hour"], "part", "amount", "parent", "view")


@query(f"""WITH {HOURLY}, b(part, lo, hi) AS (VALUES ('click', 100.0::DOUBLE, 400.0::DOUBLE), ('error', 300.0, 500.0), ('purchase', 150.0, 300.0), ('signup', 600.0, 900.0)),
x AS (SELECT hour, hp.part, amount, sum(amount) OVER (PARTITION BY hour) AS parent, CAST(100 * (1 + hour % 24) AS DOUBLE) AS f, lo, least(6 * hi, 2500.0::DOUBLE) AS hi FROM hp LEFT JOIN b ON hp.part = b.part),
w AS (SELECT *, CASE WHEN lo IS NULL THEN 1.0 WHEN f < lo THEN 0.25 + 0.75 * pow(f / lo, 2) WHEN f > hi THEN 0.25 + 0.75 * pow(1 - (f - hi) / greatest(2500.0 - hi, 1e-10), 2) ELSE 1.0 END AS band FROM x),
a AS (SELECT *, pow(CAST(amount AS DOUBLE), 3.5) * band AS w1 FROM w), c AS (SELECT *, w1 / sum(w1) OVER (PARTITION BY hour) * CAST(parent AS DOUBLE) AS c1 FROM a),
d AS (SELECT *, pow(c1, 5.0) * band AS w2 FROM c),
e AS (SELECT *, CASE WHEN sum(w2) OVER (PARTITION BY hour) < 1e-10 THEN 1.0 / count(*) OVER (PARTITION BY hour) ELSE w2 / sum(w2) OVER (PARTITION BY hour) END AS share FROM d)
SELECT hour, part, round(share, 6) AS share FROM e""")
def alloc_sharpen(spark, sf_dir):
    """Two rounds of rising power with band weights."""
    h = hourly(spark, sf_dir)
    mix = h.groupBy("hour").agg(F.sum("amount").alias("parent"))
    bands = spark.createDataFrame([(k, a, z) for k, (a, z) in BANDS.items()], "part string, lo double, hi double")
    x = h.join(mix, "hour").join(bands, "part", "left")
    freq = (100 * (1 + F.col("hour") % 24)).cast("double")
    done = al.sharpen(x, ["hour"], "part", "amount", "parent", al.band_weight(freq, F.col("lo"), F.col("hi"), 2500.0))
    return done.select("hour", "part", r6(F.col("share")).alias("share"))


@query(f"""WITH {HOURLY}, day AS (SELECT hour // 24 AS day, part, sum(amount) AS amount FROM hp GROUP BY 1, 2), e AS (SELECT part, sum(CAST(amount AS DOUBLE) * CAST(amount AS DOUBLE)) AS e FROM day GROUP BY part),
s AS (SELECT *, e / sum(e) OVER () < 0.19 AS gone FROM e), k AS (SELECT part FROM s WHERE NOT gone ORDER BY e DESC, part LIMIT 1)
SELECT day, CASE WHEN gone AND (SELECT part FROM k) IS NOT NULL THEN (SELECT part FROM k) ELSE part END AS part, CAST(sum(amount) AS DECIMAL(18,4)) AS amount FROM day JOIN s USING (part) GROUP BY 1, 2""")
def alloc_fold(spark, sf_dir):
    """Parts under a share of the energy are folded into the loudest kept part; days keep their sums."""
    day = hourly(spark, sf_dir).groupBy(F.expr("hour div 24").alias("day"), "part").agg(F.sum("amount").alias("amount"))
    return al.fold(day, ["day"], "part", "amount", 0.19).withColumn("amount", exact(F.col("amount")))


@query(f"""WITH {EV}, c AS (SELECT hour, part, CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (user_id % 2 = 0), 0) AS DECIMAL(18,4)) AS l, CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (user_id % 2 = 1), 0) AS DECIMAL(18,4)) AS r FROM ev GROUP BY 1, 2),
p AS (SELECT *, CAST(l + r AS DECIMAL(18,4)) AS parent, CASE WHEN l + r > 1e-10 THEN CAST(r - l AS DOUBLE) / CAST(l + r AS DOUBLE) ELSE 0.0 END AS pan FROM c),
k AS (SELECT p.*, layer, exp(-pow((pan - place) / 0.38, 2) / 2) AS w FROM p, (VALUES ('left', -1.0::DOUBLE), ('centre', 0.0), ('right', 1.0)) v(layer, place)),
y AS (SELECT *, w / sum(w) OVER (PARTITION BY hour, part) AS share FROM k),
z AS (SELECT *, CAST(share * CAST(parent AS DOUBLE) AS DECIMAL(18,4)) AS y, row_number() OVER (PARTITION BY hour, part ORDER BY share DESC, layer) AS n FROM y)
SELECT hour, part, layer, round(pan, 6) AS pan, parent, CAST(y + CASE WHEN n = 1 THEN parent - sum(y) OVER (PARTITION BY hour, part) ELSE 0 END AS DECIMAL(18,4)) AS allocated FROM z""")
def alloc_kernel3(spark, sf_dir):
    """Three layers by position between two channels (even and odd users); layers sum to the cell."""
    side = lambda k: exact(F.coalesce(F.sum(F.when(F.col("user_id") % 2 == k, exact(F.col("value")))), F.lit(0)))
    c = events(spark, sf_dir).groupBy("hour", "part").agg(side(0).alias("l"), side(1).alias("r"))
    done = al.position_layers(c, ["hour", "part"], "l", "r")
    return done.select("hour", "part", "layer", r6(F.col("pan")).alias("pan"), "parent", "allocated")


@query(f"""WITH {REV}, c AS (SELECT month, l_returnflag AS part, CAST(sum(price) AS DOUBLE) AS ex FROM li GROUP BY 1, 2), d AS (SELECT *, ex * CASE part WHEN 'R' THEN 1.5 WHEN 'A' THEN 1.02 ELSE 1.1 END AS re FROM c),
s AS (SELECT *, abs(sum(re - ex) OVER (PARTITION BY month)) AS excess, abs(sum(ex) OVER (PARTITION BY month)) * (pow(10, 1.5 / 20) - 1) AS room FROM d),
t AS (SELECT *, CASE WHEN excess > 1e-10 THEN greatest(0.0, least(1.0, room / excess)) ELSE 1.0 END AS scale FROM s)
SELECT month, part, round(scale, 6) AS scale, round(ex + (re - ex) * scale, 2) AS capped, scale < 1 AS trimmed FROM t""")
def alloc_consistency(spark, sf_dir):
    """Restored parts scaled down to what the mix has room for."""
    c = revenue(spark, sf_dir).groupBy("month", F.col("l_returnflag").alias("part")).agg(F.sum("price").cast("double").alias("ex"))
    c = c.withColumn("re", F.col("ex") * F.when(F.col("part") == "R", 1.5).when(F.col("part") == "A", 1.02).otherwise(1.1))
    return al.cap_additions(c, ["month"], "ex", "re").select("month", "part", r6(F.col("scale")).alias("scale"), F.round("capped", 2).alias("capped"), "trimmed")


@query(f"""WITH {REV}, {NODES}, t AS (SELECT key, parent FROM nodes WHERE key <> 'n3'), n AS (SELECT key, CASE WHEN key <> 'root' THEN CASE WHEN parent IN (SELECT key FROM t) THEN parent ELSE 'root' END END AS parent FROM t),
s AS (SELECT 's' || l_suppkey AS key, sum(price) AS total FROM li GROUP BY 1), a AS (SELECT s.key, coalesce(parent, 'root') AS parent, total FROM s LEFT JOIN n USING (key)),
b AS (SELECT a.parent AS key, any_value(n.parent) AS parent, sum(total) AS total FROM a JOIN n ON n.key = a.parent GROUP BY 1), c AS (SELECT b.parent AS key, any_value(n.parent) AS parent, sum(total) AS total FROM b JOIN n ON n.key = b.parent GROUP BY 1),
d AS (SELECT c.parent AS key, any_value(n.parent) AS parent, sum(total) AS total FROM c JOIN n ON n.key = c.parent GROUP BY 1)
SELECT key, parent, CAST(sum(total) AS DECIMAL(18,4)) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY key, parent""")
def tree_rollup(spark, sf_dir):
    """Every level of the supplier tree sums to its parent; what a node without a row held belongs to the root."""
    leaf = revenue(spark, sf_dir).groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key")).agg(F.sum("price").alias("total"))
    tree = nodes(spark, sf_dir).select("key", "parent").filter("key <> 'n3'")
    done = tr.rollup(leaf.withColumn("total", F.col("total").cast("decimal(28,4)")), tree, "total", 3)
    return done.select("key", "parent", exact(F.col("total")).alias("total"))


@query(f"""WITH {NODES}, p AS (SELECT key FROM nodes WHERE key NOT LIKE 's%' OR key IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT key, parent, label FROM nodes WHERE key IN (SELECT key FROM p) AND key NOT IN (SELECT n.parent FROM nodes n JOIN p USING (key) WHERE n.parent IS NOT NULL)""")
def tree_leaves(spark, sf_dir):
    """The deepest present nodes, in catalogue order."""
    n = nodes(spark, sf_dir)
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"))
    present = n.filter("key not like 's%'").select("key").union(rich)
    return tr.leaves(n, present).select("key", "parent", "label").orderBy("parent", "key")


@query(f"""WITH {HOURLY} SELECT hour // 24 AS day, CAST(sum(amount) AS DECIMAL(18,4)) AS recombined, CAST(coalesce(sum(amount) FILTER (part NOT IN ('click', 'view')), 0) AS DECIMAL(18,4)) AS minus_one, CAST(coalesce(sum(amount) FILTER (part IN ('click', 'view')), 0) AS DECIMAL(18,4)) AS acapella FROM hp GROUP BY 1""")
def derived_mixes(spark, sf_dir):
    """Per day: all parts, all but two, and those two."""
    day = hourly(spark, sf_dir).withColumn("day", F.expr("hour div 24"))
    done = tr.derived_mix(day, ["day"], "part", "amount", ["click", "view"])
    return done.select("day", *(exact(F.col(c)).alias(c) for c in ("recombined", "minus_one", "acapella")))


@query(f"""WITH {HOURLY}, h AS (SELECT hour // 24 AS day, hour, CAST(sum(amount) AS DOUBLE) AS o, CAST(sum(amount * CASE WHEN part = 'click' THEN 0.9 ELSE 1 END) AS DOUBLE) AS r FROM hp GROUP BY 1, 2),
g AS (SELECT day, sqrt(avg((o - r) * (o - r))) AS d, sqrt(avg(o * o)) AS m FROM h GROUP BY 1)
SELECT day, round(CASE WHEN d > 1e-10 AND m > 1e-10 THEN 20 * log10(d / m) END, 6) AS error_db FROM g""")
def recon_error(spark, sf_dir):
    """Per day, the level of what rebuilt parts miss."""
    got = F.col("amount") * F.when(F.col("part") == "click", F.lit(0.9).cast("decimal(3,1)")).otherwise(F.lit(1).cast("decimal(3,1)"))
    h = hourly(spark, sf_dir).groupBy("hour").agg(F.sum("amount").cast("double").alias("o"), F.sum(got).cast("double").alias("r")).withColumn("day", F.expr("hour div 24"))
    return me.reconstruction_error(h, ["day"], "o", "r").select("day", r6(F.col("error_db")).alias("error_db"))


@query(f"""WITH {HOURLY}, h AS (SELECT hour // 24 AS day, hour, CAST(coalesce(sum(amount) FILTER (part = 'view'), 0) AS DOUBLE) AS r, CAST(sum(amount) FILTER (part IN ('view', 'click')) AS DOUBLE) AS e FROM hp WHERE part IN ('view', 'click') GROUP BY 1, 2),
c AS (SELECT *, r - avg(r) OVER (PARTITION BY day) AS rc, e - avg(e) OVER (PARTITION BY day) AS ec FROM h), a AS (SELECT *, sum(rc * ec) OVER (PARTITION BY day) / greatest(sum(rc * rc) OVER (PARTITION BY day), 1e-10) AS al FROM c),
f AS (SELECT day, sum(rc * rc) AS rr, sum(al * rc * al * rc) AS s, sum((ec - al * rc) * (ec - al * rc)) AS n, sum(r * e) / greatest(sum(e * e), 1e-10) AS gain FROM a GROUP BY day)
SELECT day, round(CASE WHEN rr < 1e-10 THEN 'nan'::DOUBLE WHEN n < 1e-10 THEN 'inf'::DOUBLE WHEN s < 1e-10 THEN '-inf'::DOUBLE ELSE 10 * log10(s / n) END, 6) AS si_sdr_db, round(gain, 6) AS gain FROM f""")
def si_sdr(spark, sf_dir):
    """Scale-invariant ratio of a mixed estimate to its reference, and the gain that fits them, per day."""
    of = lambda parts: F.coalesce(F.sum(F.when(F.col("part").isin(*parts), F.col("amount"))), F.lit(0)).cast("double")
    h = hourly(spark, sf_dir).filter("part in ('view', 'click')").groupBy("hour").agg(of(["view"]).alias("r"), of(["view", "click"]).alias("e")).withColumn("day", F.expr("hour div 24"))
    return me.si_sdr(h, ["day"], "r", "e").select("day", r6(F.col("si_sdr_db")).alias("si_sdr_db"), r6(F.col("gain")).alias("gain"))


@query(f"""WITH {HOURLY}, p AS (SELECT part, hour, pow(CAST(amount AS DOUBLE), 2) AS p FROM hp), b AS (SELECT part, sum(p) OVER (PARTITION BY part ORDER BY hour RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) / 4 AS p FROM p),
l AS (SELECT part, p, -0.691 + 10 * log10(p) AS l FROM b WHERE p > 1e-10), g AS (SELECT part, -0.691 + 10 * log10(avg(p)) - 10 AS gate FROM l WHERE l > -70 GROUP BY part)
SELECT part, round(-0.691 + 10 * log10(avg(p)), 6) AS loudness, count(*) AS blocks FROM l JOIN g USING (part) WHERE l > -70 AND l > gate GROUP BY part""")
def loudness_gated(spark, sf_dir):
    """Gated loudness of each part over sliding blocks of four hours."""
    h = hourly(spark, sf_dir).withColumn("p", F.pow(F.col("amount").cast("double"), F.lit(2.0)))
    done = me.gated_loudness(h, ["part"], "hour", "p")
    return done.select("part", r6(F.col("loudness")).alias("loudness"), "blocks")


@query(f"""WITH {REV} SELECT l_returnflag AS flag, round(CAST(coalesce(sum(price) FILTER (l_quantity >= 1 AND l_quantity < 11), 0) AS DOUBLE) / CAST(sum(price) AS DOUBLE), 6) AS band_0,
round(CAST(coalesce(sum(price) FILTER (l_quantity >= 11 AND l_quantity < 21), 0) AS DOUBLE) / CAST(sum(price) AS DOUBLE), 6) AS band_1, round(CAST(coalesce(sum(price) FILTER (l_quantity >= 21 AND l_quantity < 51), 0) AS DOUBLE) / CAST(sum(price) AS DOUBLE), 6) AS band_2,
round(greatest(CAST(coalesce(sum(price) FILTER (l_quantity >= 1 AND l_quantity < 11), 0) AS DOUBLE), CAST(coalesce(sum(price) FILTER (l_quantity >= 11 AND l_quantity < 21), 0) AS DOUBLE), CAST(coalesce(sum(price) FILTER (l_quantity >= 21 AND l_quantity < 51), 0) AS DOUBLE)) / CAST(sum(price) AS DOUBLE), 6) AS crowding,
round(CAST(sum(CAST(l_quantity AS INTEGER) * price) AS DOUBLE) / CAST(sum(price) AS DOUBLE), 6) AS centroid FROM li GROUP BY 1""")
def band_share(spark, sf_dir):
    """Shares of registers, their crowding and the centroid, per return flag."""
    x = revenue(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("int"))
    done = me.band_shares(x, ["l_returnflag"], "q", "price", [1, 11, 21, 51])
    return done.select(F.col("l_returnflag").alias("flag"), *(r6(F.col(c)).alias(c) for c in ("band_0", "band_1", "band_2", "crowding", "centroid")))


@query(f"""WITH {HOURLY}, m AS (SELECT part, max(amount) AS peak FROM hp GROUP BY part) SELECT part, round(avg(CASE WHEN amount > 0.02 * peak THEN 1.0 ELSE 0.0 END), 6) AS occupied FROM hp JOIN m USING (part) GROUP BY part""")
def occupied_cells(spark, sf_dir):
    return me.occupied(hourly(spark, sf_dir), ["part"], "amount").select("part", r6(F.col("occupied")).alias("occupied"))


@query(f"""WITH {EV}, q AS (SELECT part, quantile_cont(value, 0.995) AS hi, quantile_cont(value, 0.5) AS lo FROM ev GROUP BY part) SELECT part, round(CASE WHEN hi > 1e-10 AND lo > 1e-10 THEN 20 * log10(hi / lo) END, 6) AS crest_db FROM q""")
def crest_db(spark, sf_dir):
    return me.crest(events(spark, sf_dir), ["part"], "value").select("part", r6(F.col("crest_db")).alias("crest_db"))


@query(f"""WITH {EV}, n AS (SELECT user_id, abs(value) AS v, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 8 AS win FROM ev) SELECT user_id, win, round(avg(v), 6) AS envelope FROM n GROUP BY 1, 2 HAVING count(*) = 8""")
def envelope_decimate(spark, sf_dir):
    return me.envelope(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 8).select("user_id", "win", r6(F.col("envelope")).alias("envelope"))


@query(f"""WITH {EV} SELECT user_id, part, round(sqrt(avg(value * value)), 6) AS level, count(*) AS n, round((max(us) - min(us)) / 1e6, 3) AS span FROM ev GROUP BY 1, 2""")
def cluster_energy(spark, sf_dir):
    """Level, count and span of each part on each track."""
    return events(spark, sf_dir).groupBy("user_id", "part").agg(r6(rms(F.col("value"))).alias("level"), F.count("*").alias("n"), F.round((F.max("us") - F.min("us")) / 1e6, 3).alias("span"))


@query(f"""WITH {EV}, n AS (SELECT user_id, us, t, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM ev), d AS (SELECT user_id, i // 4 AS bar, t, 240.0 / nullif(lead(t) OVER (PARTITION BY user_id ORDER BY t) - t, 0) AS bpm FROM n WHERE i % 4 = 0)
SELECT user_id, bar, round(coalesce(bpm, lag(bpm) OVER (PARTITION BY user_id ORDER BY t)), 9) AS bpm FROM d""")
def tempo_map(spark, sf_dir):
    """Rate of each bar of four events; the last bar repeats the one before."""
    from pyspark.sql import Window

    n = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1).filter("i % 4 = 0").withColumn("bar", F.expr("cast(i div 4 as bigint)"))
    return me.tempo_map(n, ["user_id"], "t", 4).select("user_id", "bar", F.round("bpm", 9).alias("bpm"))


@query(f"""WITH {REV}, c AS (SELECT n_regionkey AS region, s_nationkey AS nation, month, CAST(sum(price) AS DOUBLE) AS v FROM li JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3),
p AS (SELECT region, month, sum(v) AS pv FROM c GROUP BY 1, 2), j AS (SELECT * FROM c JOIN p USING (region, month)), g AS (SELECT nation, sqrt(avg(v * v)) AS a, sqrt(avg(pv * pv)) AS b, avg(v * v) / avg(pv * pv) AS full_ FROM j GROUP BY 1)
SELECT nation, round(CASE WHEN a > 1e-10 AND b > 1e-10 THEN 20 * log10(a / b) END, 6) AS level_db, round(full_, 6) AS fullness FROM g""")
def relative_level(spark, sf_dir):
    """Each nation's level against its region, and how full it is."""
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"))
    c = revenue(spark, sf_dir).join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("region", "nation", "month").agg(F.sum("price").cast("double").alias("v"))
    p = c.groupBy("region", "month").agg(F.sum("v").alias("pv"))
    v, pv = F.col("v"), F.col("pv")
    return c.join(p, ["region", "month"]).groupBy("nation").agg(r6(ratio_db(rms(v), rms(pv))).alias("level_db"), r6(F.avg(v * v) / F.avg(pv * pv)).alias("fullness"))


@query(f"""WITH {EV}, u AS (SELECT user_id, t, value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) >= 100 AS up FROM ev), g AS (SELECT user_id, count(*) FILTER (up) AS onsets, (max(t) - min(t)) / 60.0 AS m FROM u GROUP BY 1)
SELECT user_id, onsets, round(CASE WHEN m > 1e-10 THEN onsets / m END, 9) AS per_minute FROM g""")
def event_rate(spark, sf_dir):
    return me.onset_rate(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "t", "value", 100, F.expr("hour div 24")).select("user_id", "onsets", F.round("per_minute", 9).alias("per_minute"))


@query("""WITH o AS (SELECT l_suppkey, l_returnflag AS part, l_linenumber AS harmonic, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT *, m / sum(m) OVER (PARTITION BY l_suppkey, part) AS q FROM o),
b AS (SELECT part, harmonic, quantile_cont(q, 0.5) AS m FROM s GROUP BY 1, 2) SELECT part, harmonic, round(m / sum(m) OVER (PARTITION BY part), 6) AS share FROM b""")
def profile_median(spark, sf_dir):
    """Two levels of medians of the price by line number, each made to sum to 1."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("part"), F.col("l_linenumber").alias("harmonic"), "l_extendedprice")
    return me.profile(x, ["l_suppkey"], ["part"], "harmonic", "l_extendedprice").select("part", "harmonic", r6(F.col("share")).alias("share"))


@query(f"""WITH {HOURLY}, p AS (SELECT a.part, b.part AS other, abs(corr(CAST(a.amount AS DOUBLE), CAST(b.amount AS DOUBLE))) AS r FROM hp a JOIN hp b ON a.hour = b.hour AND a.part <> b.part GROUP BY 1, 2)
SELECT part, round(1 - max(round(r, 6)), 6) AS distinctness FROM p GROUP BY part""")
def sibling_distinctness(spark, sf_dir):
    """1 - the largest correlation with another part."""
    h = hourly(spark, sf_dir).withColumn("root", F.lit(1)).withColumn("v", F.col("amount").cast("double"))
    return me.best_sibling(h, ["root"], "part", "hour", "v").select("part", r6(1 - F.col("likeness")).alias("distinctness"))


@query(f"""WITH {EV}, d AS (SELECT user_id, hour // 24 AS day, part, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM ev GROUP BY 1, 2, 3), p AS (SELECT a.user_id, a.part, b.part AS other, CASE WHEN count(*) > 1 AND var_pop(a.v) > 0 AND var_pop(b.v) > 0 THEN round(abs(corr(a.v, b.v)), 6) END AS r FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.part <> b.part GROUP BY 1, 2, 3),
m AS (SELECT user_id, part, max(CASE WHEN isnan(r) THEN NULL ELSE r END) AS r FROM p GROUP BY 1, 2) SELECT d.user_id, d.part, coalesce(max(m.r), 0.0) AS bleed FROM (SELECT DISTINCT user_id, part FROM d) d LEFT JOIN m ON d.user_id = m.user_id AND d.part = m.part GROUP BY 1, 2""")
def sibling_bleed(spark, sf_dir):
    """Per track the largest correlation of each part's days with another part's."""
    d = events(spark, sf_dir).withColumn("day", F.expr("hour div 24")).groupBy("user_id", "day", "part").agg(F.sum(exact(F.col("value"))).cast("double").alias("v"))
    return me.best_sibling(d, ["user_id"], "part", "day", "v").select("user_id", "part", F.col("likeness").alias("bleed"))


ISOLATION = """g AS (SELECT part, d.d AS day, h.h AS hod FROM (SELECT DISTINCT part FROM hp), (SELECT unnest(range(0, (SELECT max(hour) // 24 + 1 FROM hp))) AS d) d, (SELECT unnest(range(0, 24)) AS h) h),
f AS (SELECT g.part, day, hod, coalesce(CAST(amount AS DOUBLE), 0.0) AS v FROM g LEFT JOIN hp ON hp.part = g.part AND hour = day * 24 + hod), m AS (SELECT part, max(v) AS peak, max(day) AS last FROM f GROUP BY part),
s AS (SELECT f.part, day, hod, last, v / greatest(peak, 1e-10) AS s FROM f JOIN m USING (part)),
l AS (SELECT a.part, a.day, a.hod, a.s, avg(b.s) AS local FROM s a, (SELECT unnest(range(-1, 2)) AS i) i, (SELECT unnest(range(-2, 3)) AS j) j JOIN s b ON true WHERE b.part = a.part AND b.day = greatest(0, least(a.last, a.day + i.i)) AND b.hod = greatest(0, least(23, a.hod + j.j)) GROUP BY 1, 2, 3, 4),
iso AS (SELECT part, round(least(1.0, 1.8 * coalesce(avg(CASE WHEN s > 0.05 THEN greatest(0.0, least(1.0, 1 - local / (s + 1e-10))) END), 0.0)), 6) AS isolation FROM l GROUP BY part)"""


@query(f"WITH {HOURLY}, {ISOLATION} SELECT * FROM iso")
def isolation_score(spark, sf_dir):
    """How much loud cells of each part's day by hour grid stand alone."""
    h = hourly(spark, sf_dir)
    last = h.agg(F.expr("max(hour) div 24").alias("last"))
    grid = h.select("part").distinct().join(F.broadcast(last)).withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).withColumn("hod", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))  # one row is broadcast
    full = grid.withColumn("hour", F.col("day") * 24 + F.col("hod")).join(h, ["part", "hour"], "left").withColumn("v", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))
    return me.grid_isolation(full, ["part"], "day", "hod", "v").select("part", r6(F.col("isolation")).alias("isolation"))


@query(f"""WITH {EV}, c AS (SELECT hour, part, coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (user_id % 2 = 0), 0)::DOUBLE AS l, coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (user_id % 2 = 1), 0)::DOUBLE AS r FROM ev GROUP BY 1, 2),
p AS (SELECT *, l + r AS w, CASE WHEN l + r > 1e-10 THEN (r - l) / (l + r) ELSE 0.0 END AS pan FROM c),
g AS (SELECT part, sum(w * pan) / greatest(sum(w), 1e-10) AS m, sum(w * pan * pan) / greatest(sum(w), 1e-10) AS q, sqrt(avg(pow((l - r) / 2, 2))) / greatest(sqrt(avg(pow((l + r) / 2, 2))), 1e-10) AS side FROM p GROUP BY part)
SELECT part, round(m, 6) AS pan_mean, round(sqrt(greatest(0.0, q - m * m)), 6) AS pan_spread, round(side, 6) AS side_ratio, sqrt(greatest(0.0, q - m * m)) > 0.22 AND side > 0.12 AS usable,
CASE WHEN sqrt(greatest(0.0, q - m * m)) > 0.22 AND side > 0.12 THEN 'spread enough to split' WHEN sqrt(greatest(0.0, q - m * m)) <= 0.22 THEN 'all in one place' ELSE 'too little at the sides' END AS reason FROM g""")
def pan_spread(spark, sf_dir):
    side = lambda k: F.coalesce(F.sum(F.when(F.col("user_id") % 2 == k, exact(F.col("value")))), F.lit(0)).cast("double")
    c = events(spark, sf_dir).groupBy("hour", "part").agg(side(0).alias("l"), side(1).alias("r"))
    done = me.pan_spread(c, ["part"], "l", "r")
    return done.select("part", *(r6(F.col(x)).alias(x) for x in ("pan_mean", "pan_spread", "side_ratio")), "usable", "reason")


@query(f"""WITH {HOURLY}, m AS (SELECT max(amount)::DOUBLE AS peak FROM hp) SELECT hour + 12 AS hour, part, round(CAST(amount AS DOUBLE) * CASE WHEN peak > 900 THEN 900 / peak ELSE 1.0 END, 6) AS scaled FROM hp, m""")
def shift_and_scale(spark, sf_dir):
    """All parts moved by one offset and, if the loudest cell is over the ceiling, scaled by one gain."""
    h = hourly(spark, sf_dir)
    peak = h.agg(F.max("amount").cast("double").alias("peak"))
    gain = F.when(F.col("peak") > 900, 900 / F.col("peak")).otherwise(1.0)
    return h.join(F.broadcast(peak)).select((F.col("hour") + 12).alias("hour"), "part", r6(F.col("amount").cast("double") * gain).alias("scaled"))  # one row is broadcast


@query(f"""WITH {HOURLY}, a AS (SELECT part, avg(CAST(amount AS DOUBLE)) AS m FROM hp GROUP BY part), x AS (SELECT hp.part, CAST(amount AS DOUBLE) AS v, CAST(amount AS DOUBLE) - m AS r FROM hp JOIN a USING (part)),
g AS (SELECT part, 1 - avg(r * r) / greatest(avg(v * v), 1e-10) AS e, sqrt(avg(r * r)) AS a, sqrt(avg(v * v)) AS b FROM x GROUP BY part) SELECT part, round(e, 6) AS explained, round(CASE WHEN a > 1e-10 AND b > 1e-10 THEN 20 * log10(a / b) END, 6) AS residual_db FROM g""")
def explained_share(spark, sf_dir):
    """How much of each part its mean explains."""
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    x = h.join(h.groupBy("part").agg(F.avg("v").alias("m")), "part").withColumn("r", F.col("v") - F.col("m"))
    return me.explained(x, ["part"], "v", "r").select("part", r6(F.col("explained")).alias("explained"), r6(F.col("residual_db")).alias("residual_db"))


@query(f"""WITH {EV}, u AS (SELECT DISTINCT us // 60000000 AS m FROM ev), o AS (SELECT us // 60000000 + k AS m, value * (1 - 0.25 * k) AS v FROM ev, (SELECT unnest(range(0, 4)) AS k)) SELECT m AS minute, round(CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE), 4) AS amount FROM o WHERE m < 43200 GROUP BY m""")
def scatter_add(spark, sf_dir):
    """Every event adds a decaying shape of four minutes; what reaches beyond the end is clipped."""
    shape = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    o = events(spark, sf_dir).select("us", "value", shape).select((F.expr("us div 60000000") + F.col("k")).alias("minute"), exact(F.col("value") * (1 - 0.25 * F.col("k"))).alias("v"))
    return o.filter("minute < 43200").groupBy("minute").agg(F.round(F.sum("v").cast("double"), 4).alias("amount"))


@query("""WITH b AS (SELECT l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 10 AS bin, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1),
i AS (SELECT bin, log10(a + 1e-8) AS x, log10(b + 1e-8) AS y FROM b WHERE bin >= 15 AND bin <= 65 AND a IS NOT NULL AND b IS NOT NULL), d AS (SELECT abs((x - avg(x) OVER ()) - (y - avg(y) OVER ())) AS d FROM i) SELECT round(avg(d), 6) AS gap, count(*) AS bins FROM d""")
def log_spectrum_gap(spark, sf_dir):
    """Distance of two centred log profiles in a band."""
    of = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("bin")).agg(of("A").alias("a"), of("R").alias("b")).filter("a is not null and b is not null")
    return me.spectrum_gap(b, [], "bin", "a", "b", 15, 65).select(r6(F.col("gap")).alias("gap"), "bins")


@query("""WITH l AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, d, avg(x) AS c FROM l GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(c * c)) AS cn FROM c GROUP BY 1),
t AS (SELECT l.vec_id, c.label, sum(x * c) AS dot, sqrt(sum(x * x)) AS xn FROM l JOIN c USING (d) GROUP BY 1, 2), e AS (SELECT t.label, vec_id, exp(10 * dot / greatest(cn * xn, 1e-10)) AS e FROM t JOIN n ON n.label = t.label), p AS (SELECT label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT label, round(max(p), 6) AS best, round(avg(p), 6) AS mean FROM p GROUP BY label""")
def zero_shot_scores(spark, sf_dir):
    """Each label's best and mean softmax score over all vectors."""
    done = me.scores_by_concept(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return done.select("label", r6(F.col("best")).alias("best"), r6(F.col("mean")).alias("mean"))

