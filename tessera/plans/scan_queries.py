"""Queries of scans, framed analysis and chains of any length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import music as mu
from ..operators import scans as sc
from ..operators import temporal as te
from ..operators.chains import cheapest_chains
from .base import EV, HOUR, events, query, r6, table
from .score_queries import move_sql


def day():
    """A slice of time: events of one day."""
    return F.expr(f"us div {24 * HOUR}")



@query(f"""WITH {EV} SELECT event_id, part, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY part ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM ev""")
def running_total(spark, sf_dir):
    """What each part has come to by each of its events; a part's days are worked on side by side."""
    e = events(spark, sf_dir).withColumn("v", F.col("value").cast("decimal(18,4)"))
    return sc.running(e, ["part"], ["us", "event_id"], "v", day(), "total").select("event_id", "part", F.col("total").cast("double").alias("total"))


@query(f"""WITH {EV}, o AS (SELECT event_id, part, us, value, row_number() OVER (PARTITION BY part ORDER BY us, event_id) AS i FROM ev)
SELECT a.event_id, a.part, round(sum(b.value * pow(0.5, (a.us - b.us) / 3600000000.0)), 6) AS level FROM o a JOIN o b ON b.part = a.part AND b.i <= a.i AND b.us >= a.us - 60 * 3600000000 GROUP BY a.event_id, a.part""")
def decaying_level(spark, sf_dir):
    """A part's level at each event: every event adds its value, and what is there halves each hour (a filter of the first order with gaps of any length)."""
    e = te.previous(events(spark, sf_dir), ["part"], ["us", "event_id"], "us", day(), "before")
    kept = F.coalesce(F.pow(F.lit(0.5), (F.col("us") - F.col("before")) / 3_600_000_000), F.lit(0.0))
    return sc.affine(e.select("event_id", "part", "us", "before", "value"), ["part"], ["us", "event_id"], kept, F.col("value"), day(), "y").select("event_id", "part", r6(F.col("y")).alias("level"))


N_FFT, HOP, BANDS = 256, 64, 3
WAVES = ", ".join(f"pow(sum(v * w * cos(2 * pi() * {b} * o / {N_FFT})), 2) + pow(sum(v * w * sin(2 * pi() * {b} * o / {N_FFT})), 2) AS band{b}" for b in range(1, BANDS + 1))


@query(f"""WITH {EV}, m AS (SELECT part, us // 60000000 AS i, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS v FROM ev GROUP BY 1, 2), z AS (SELECT part, max(i) AS z FROM m GROUP BY 1),
f AS (SELECT part, unnest(range(0, (z + 1 - {N_FFT}) // {HOP} + 1)) AS frame FROM z WHERE z + 1 >= {N_FFT}), x AS (SELECT part, i, v, unnest(range(greatest(0, (i - {N_FFT}) // {HOP}), i // {HOP} + 1)) AS frame FROM m),
y AS (SELECT f.part, f.frame, coalesce(v, 0) AS v, i - f.frame * {HOP} AS o, 0.5 - 0.5 * cos(2 * pi() * (i - f.frame * {HOP}) / {N_FFT}) AS w FROM f LEFT JOIN x ON x.part = f.part AND x.frame = f.frame AND i - f.frame * {HOP} BETWEEN 0 AND {N_FFT - 1}),
s AS (SELECT part, frame, coalesce(sum(v * w * v * w), 0) AS energy, {WAVES} FROM y GROUP BY 1, 2) SELECT part, frame, round(energy, 3) AS energy, {', '.join(f'round(coalesce(band{b}, 0), 3) AS band{b}' for b in range(1, BANDS + 1))} FROM s""")
def framed_bands(spark, sf_dir):
    """Energy and the lowest bands of overlapping Hann frames of each part's minutes; blocks of frames share their edges."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)

    def act(frames: np.ndarray) -> dict[str, np.ndarray]:
        power = np.square(np.abs(np.fft.rfft(frames * window, axis=1)))
        energy = (2 * power.sum(1) - power[:, 0] - power[:, -1]) / N_FFT
        return {"energy": np.round(energy, 3)} | {f"band{b}": np.round(power[:, b], 3) for b in range(1, BANDS + 1)}

    minutes = events(spark, sf_dir).groupBy("part", F.expr("us div 60000000").alias("i")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    return ch.frames(minutes, ["part"], "i", "v", N_FFT, HOP, act, "energy double, " + ", ".join(f"band{b} double" for b in range(1, BANDS + 1)), together=64)


def choices(spark, sf_dir):
    """piece, layer, node, own and the voices s, a, t, b: four placements of each line item's chord."""
    order = F.row_number().over(te.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    n = F.col("node")
    li = table(spark, sf_dir, "lineitem").withColumn("layer", (order - 1).cast("long")).withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    third = 3 + F.col("l_linenumber") % 2
    b = 40 + (F.col("l_partkey") + F.when(n == 1, third).when(n == 2, 7).otherwise(0)) % 12 + F.when(n == 3, 12).otherwise(0)
    t = F.col("b") + F.when(n % 2 == 0, 7).otherwise(5)
    one = li.select(F.col("l_suppkey").alias("piece"), "layer", "node", (62 + F.col("l_quantity").cast("long") % 20).alias("melody"), b.cast("long").alias("b"))
    return one.withColumn("t", t).withColumn("a", F.col("t") + 5).withColumn("s", F.col("a") + 3 + n).withColumn("own", 100 * F.abs(F.col("s") - F.col("melody")))


LEGAL, MOVES = move_sql()


@query(f"""WITH RECURSIVE l AS (SELECT l_suppkey AS piece, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS layer, l_partkey AS k, 3 + l_linenumber % 2 AS third, 62 + CAST(l_quantity AS BIGINT) % 20 AS melody FROM lineitem),
nb AS (SELECT piece, layer, node, melody, 40 + (k + CASE node WHEN 1 THEN third WHEN 2 THEN 7 ELSE 0 END) % 12 + CASE node WHEN 3 THEN 12 ELSE 0 END AS b FROM l, (SELECT unnest(range(0, 4)) AS node)),
nd AS MATERIALIZED (SELECT piece, layer, node, b, b + u AS t, b + u + 5 AS a, b + u + 8 + node AS s, 100 * abs(b + u + 8 + node - melody) AS own FROM (SELECT *, CASE WHEN node % 2 = 0 THEN 7 ELSE 5 END AS u FROM nb)),
r AS (SELECT piece, layer, s, a, t, b, CAST(own AS BIGINT) AS cost, chr(CAST(97 + node AS INTEGER)) AS path FROM nd WHERE layer = 0
  UNION ALL SELECT piece, layer, s, a, t, b, m.cost, m.path FROM (SELECT n.piece, n.layer, n.s, n.a, n.t, n.b, min(struct_pack(cost := CAST(p.cost + n.own + round(100 * ({MOVES})) + CASE WHEN {LEGAL} THEN 0 ELSE 100000 END AS BIGINT), path := p.path || chr(CAST(97 + n.node AS INTEGER)))) AS m
    FROM r p JOIN nd n ON n.piece = p.piece AND n.layer = p.layer + 1 GROUP BY n.piece, n.layer, n.node, n.s, n.a, n.t, n.b)),
e AS (SELECT piece, min(struct_pack(cost := cost, path := path)) AS m FROM r JOIN (SELECT piece, max(layer) AS layer FROM nd GROUP BY 1) USING (piece, layer) GROUP BY piece)
SELECT piece, CAST(layer AS BIGINT) AS layer, CAST(ascii(m.path[layer + 1]) - 97 AS BIGINT) AS node, m.cost AS cost FROM e, LATERAL (SELECT unnest(range(0, length(m.path))) AS layer)""")
def cheapest_voicings(spark, sf_dir):
    """The placement of every chord of every piece on the piece's cheapest way: near the melody, moving little; forbidden moves cost 1,000."""

    def move(p, n):
        legal, cost = mu.transition(p, n)
        return F.round(100 * cost).cast("long") + F.when(legal, 0).otherwise(100_000)

    return cheapest_chains(choices(spark, sf_dir), ["piece"], "layer", "node", "own", move, mu.VOICES)
