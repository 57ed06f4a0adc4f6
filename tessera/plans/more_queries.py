"""Queries of smoothing, injected analyses, cues and styled voices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pitch as pi
from ..functions import text as tx
from ..operators import music as mu
from ..operators import temporal as te
from .base import EV, HOURLY, events, hourly, query, r6
from .score_queries import CHORDS, PROGRESSION, chain_sql, chords, progression
from .time_queries import SEC, sections

# Our own words for numbers in spoken cues.
NUMBERS = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight"}


@query(f"""WITH {HOURLY}, n AS (SELECT part, hour, CAST(amount AS DOUBLE) AS v, row_number() OVER (PARTITION BY part ORDER BY hour) AS i, count(*) OVER (PARTITION BY part) AS c FROM hp),
j AS (SELECT a.part, a.hour, b.v FROM n a, (SELECT unnest(range(-4, 5)) AS o) o JOIN n b ON true WHERE b.part = a.part AND b.i = greatest(1, least(a.c, a.i + o.o))) SELECT part, hour, list_sort(list(v))[5] AS smooth FROM j GROUP BY 1, 2""")
def moving_median(spark, sf_dir):
    """Nine-hour medians of each part; edge values stand for those beyond the ends."""
    h = hourly(spark, sf_dir).withColumn("v", F.col("amount").cast("double"))
    return h.withColumn("smooth", te.moving_median(h, ["part"], ["hour"], "v", 4)).select("part", "hour", "smooth")


@query(f"""WITH {EV}, d AS (SELECT user_id, part, t - lag(t) OVER (PARTITION BY user_id, part ORDER BY us, event_id) AS d FROM ev WHERE part IN ('view', 'purchase')), a AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM ev),
m AS (SELECT user_id, quantile_cont(d, 0.5) AS p FROM d WHERE part = 'purchase' GROUP BY 1), b AS (SELECT user_id, quantile_cont(d, 0.5) AS p FROM a GROUP BY 1) SELECT user_id, CAST(greatest(2, least(7, round_even(m.p / b.p, 0))) AS BIGINT) AS beats_per_bar FROM m JOIN b USING (user_id) WHERE m.p IS NOT NULL AND b.p > 0""")
def trained_meter(spark, sf_dir):
    """Beats per bar from tables of beats and downbeats that a trained analysis gives: the ratio of their median steps."""
    e = events(spark, sf_dir)
    step = lambda d, name: d.withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).groupBy("user_id").agg(F.percentile("d", F.lit(0.5)).alias(name))
    both = step(e.filter("part = 'purchase'"), "down").join(step(e, "beat"), "user_id").filter("down is not null and beat > 0")
    return both.select("user_id", F.greatest(F.lit(2), F.least(F.lit(7), F.bround(F.col("down") / F.col("beat"), 0))).cast("long").alias("beats_per_bar"))


@query(f"""WITH {EV}, {SEC}, o AS (SELECT user_id, seq, label, row_number() OVER (PARTITION BY user_id, label ORDER BY seq) AS k FROM sec) SELECT user_id, seq, label || ' ' || CASE k {' '.join(f"WHEN {k} THEN '{w}'" for k, w in NUMBERS.items())} ELSE CAST(k AS VARCHAR) END AS cue FROM o""")
def cue_text(spark, sf_dir):
    """What a spoken cue says: the section and its number in words up to eight."""
    k = F.row_number().over(Window.partitionBy("user_id", "label").orderBy("seq"))
    s = sections(spark, sf_dir).withColumn("k", k)
    return s.select("user_id", "seq", F.concat("label", F.lit(" "), F.coalesce(tx.lookup(F.col("k"), NUMBERS), F.col("k").cast("string"))).alias("cue"))


@query(f"""WITH {CHORDS}, v AS ({' UNION ALL '.join(f"SELECT piece, idx, '{v}' AS voice, {v} AS p FROM ch" for v in mu.VOICES)}) SELECT piece, voice, round((idx - 1) * 4 * 60 / 76.0, 6) AS t0, round((idx - 1) * 4 * 60 / 76.0 + 0.95 * 4 * 60 / 76.0, 6) AS t1, p AS pitch, round(440.0 * pow(2.0, (p - 69) / 12.0), 6) AS hz FROM v""")
def satb_notes(spark, sf_dir):
    """Voicings as notes: four beats a chord at 76 beats a minute, held for 95 %."""
    beat = 60 / 76.0
    voices = F.explode(F.array(*(F.struct(F.lit(v).alias("voice"), F.col(v).alias("pitch")) for v in mu.VOICES)))
    n = chords(spark, sf_dir).select("piece", "idx", voices.alias("x")).select("piece", "x.voice", (F.col("idx") - 1).alias("k"), "x.pitch")
    start = F.col("k") * 4 * 60 / F.lit(76.0)
    return n.select("piece", "voice", r6(start).alias("t0"), r6(start + 0.95 * 4 * beat).alias("t1"), "pitch", r6(pi.hertz(F.col("pitch"))).alias("hz"))


# A usual soprano and usual spacings: what, mean and spread.
USUAL = [("s", 70.9, 4.0), ("s - a", 5.4, 2.5), ("a - t", 5.7, 2.5), ("t - b", 8.4, 4.0)]


@query(chain_sql(" + ".join(f"pow(({what} - {mean}) / {sd}, 2)" for what, mean, sd in USUAL)))
def satb_styled(spark, sf_dir):
    """The cheapest path when voicings far from a usual soprano and spacing cost more."""
    cost = sum((F.pow((F.expr(what) - mean) / sd, F.lit(2.0)) for what, mean, sd in USUAL), F.lit(0.0))
    return mu.cheapest_chain(progression(spark), "k", list(mu.VOICES), len(PROGRESSION), mu.transition, ("s", mu.LEAPS["s"]), cost)


@query(f"""WITH {EV}, u AS (SELECT part, hour // 24 AS day, value - lag(value) OVER (PARTITION BY part ORDER BY us, event_id) AS d, value FROM ev) SELECT part, day, round(avg(CASE WHEN d > 0 THEN d ELSE 0 END), 6) AS flux, count(*) AS n FROM u GROUP BY 1, 2""")
def daily_flux(spark, sf_dir):
    """Mean rise from each event to the next, per part and day."""
    e = te.previous(events(spark, sf_dir).withColumn("day", F.expr("hour div 24")), ["part"], ["us", "event_id"], "value", F.col("day"), "before")
    d = F.col("value") - F.col("before")
    return e.groupBy("part", "day").agg(r6(F.avg(F.when(d > 0, d).otherwise(0.0))).alias("flux"), F.count("*").alias("n"))
