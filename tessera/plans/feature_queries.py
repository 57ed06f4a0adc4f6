"""Queries of pooled spectra, frames of spans, fallbacks and matched notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as bd
from ..operators import metrics as me
from ..operators import pursuit as pu
from ..operators import sections as se
from ..operators import temporal as te
from .base import EV, HOUR, HOURLY, events, hourly, query, r6, table
from .time_queries import SEC, sections

#: Frames of twelve hours, bins of ten units of value, bands from 20 on.
FRAME, BIN, LOWEST = 12 * HOUR, 10, 20.0
SPECTRUM = f"""sp AS (SELECT part, us // {FRAME} AS frame, CAST(floor(value / {BIN}) AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS energy FROM ev GROUP BY 1, 2, 3),
bs AS (SELECT part, frame, energy, k * {float(BIN)} AS lo, (k + 1) * {float(BIN)} AS hi FROM sp), ba AS (SELECT unnest(range(0, 120)) AS band), be AS (SELECT band, {LOWEST} * pow(2, (band - 0.5) / 12.0) AS b0, {LOWEST} * pow(2, (band + 0.5) / 12.0) AS b1 FROM ba),
pooled AS (SELECT part, frame, band, sum(energy * (least(hi, b1) - greatest(lo, b0)) / (hi - lo)) AS energy FROM bs JOIN be ON hi > b0 AND lo < b1 GROUP BY 1, 2, 3)"""


def spectrum(spark, sf_dir):
    """part, frame, low, high, energy: how often each part has values of a bin in a frame."""
    k = F.floor(F.col("value") / BIN)
    one = events(spark, sf_dir).groupBy("part", F.expr(f"us div {FRAME}").alias("frame"), k.alias("k")).agg(F.count("*").cast("double").alias("energy"))
    return one.select("part", "frame", (F.col("k") * float(BIN)).alias("low"), ((F.col("k") + 1) * float(BIN)).alias("high"), "energy")


@query(f"WITH {EV}, {SPECTRUM} SELECT part, frame, CAST(band AS BIGINT) AS band, round(energy, 6) AS energy FROM pooled")
def band_energy(spark, sf_dir):
    """Each part's spectrum in bands of a twelfth of an octave; a bin gives each band the share that lies in it."""
    return bd.pooled(spectrum(spark, sf_dir), ["part", "frame"], "low", "high", "energy", LOWEST).select("part", "frame", "band", r6(F.col("energy")).alias("energy"))


HALF, THIN = 4, 3
HANN = " ".join(f"WHEN {o} THEN 0.5 - 0.5 * cos(2 * pi() * {o + HALF + 1} / {2 * HALF + 2})" for o in range(-HALF, HALF + 1))


@query(f"""WITH {EV}, {SPECTRUM}, ch AS (SELECT part, frame, band % 12 AS pc, sum(energy) AS e FROM pooled GROUP BY 1, 2, 3), q AS (SELECT part, frame, pc, e / sum(e) OVER (PARTITION BY part, frame) AS s FROM ch),
st AS (SELECT part, frame, pc, {' + '.join(f'CASE WHEN s > {x} THEN 0.25 ELSE 0 END' for x in bd.THRESHOLDS)} AS v FROM q), w AS (SELECT CAST(o AS INTEGER) AS o, CASE o {HANN} END AS w FROM (SELECT unnest(range({-HALF}, {HALF + 1})) AS o)), z AS (SELECT part, max(frame) AS z FROM ch GROUP BY 1),
sm AS (SELECT st.part, frame + o AS frame, pc, sum(v * w) / (SELECT sum(w) FROM w) AS v FROM st, w WHERE v > 0 GROUP BY 1, 2, 3) SELECT part, frame, CAST(pc AS BIGINT) AS pitch_class, round(v / sqrt(sum(v * v) OVER (PARTITION BY part, frame)), 6) AS value FROM sm JOIN z USING (part) WHERE frame % {THIN} = 0 AND frame BETWEEN 0 AND z""")
def chroma_statistics(spark, sf_dir):
    """Shares of pitch classes in steps, smoothed and thinned, each frame of length 1."""
    bands = bd.pooled(spectrum(spark, sf_dir), ["part", "frame"], "low", "high", "energy", LOWEST)
    done = bd.chroma_statistics(bd.classes(bands, ["part", "frame"]), ["part"], "frame", HALF, THIN)
    return done.select("part", "frame", "pitch_class", r6(F.col("value")).alias("value"))


@query(f"""WITH {EV}, {SEC}, f AS (SELECT user_id, seq, CAST(ceil(us0 / {HOUR}.0) AS BIGINT) AS frame0, CAST(ceil(us1 / {HOUR}.0) AS BIGINT) AS frame1 FROM sec)
SELECT user_id, seq, frame0, frame1, greatest(0, least(frame1, 499)) AS clipped, frame1 BETWEEN 0 AND 499 AS there FROM f WHERE frame1 - frame0 >= 4""")
def section_frames(spark, sf_dir):
    """The hours of each section of at least four, and its end among the first 500 hours."""
    done = te.frame_spans(sections(spark, sf_dir), "us0", "us1", HOUR)
    at, there = te.frame_at(F.col("us1"), HOUR, F.lit(500).cast("long"))
    return done.select("user_id", "seq", "frame0", "frame1", at.alias("clipped"), there.alias("there"))


@query(f"""WITH o AS (SELECT l_suppkey, l_returnflag AS part, l_linenumber AS harmonic, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT *, m / sum(m) OVER (PARTITION BY l_suppkey, part) AS q FROM o),
b AS (SELECT part, harmonic, quantile_cont(q, 0.5) AS m FROM s GROUP BY 1, 2), p AS (SELECT part, harmonic, m / sum(m) OVER (PARTITION BY part) AS share FROM b), a AS (SELECT DISTINCT l_linestatus || l_returnflag AS part FROM lineitem UNION SELECT DISTINCT l_returnflag FROM lineitem),
h AS (SELECT CAST(unnest(range(1, 17)) AS INTEGER) AS harmonic), f AS (SELECT part, harmonic, pow(harmonic, -1.2) / (SELECT sum(pow(harmonic, -1.2)) FROM h) AS share FROM a, h WHERE part NOT IN (SELECT part FROM p)) SELECT part, harmonic, round(share, 6) AS share FROM (SELECT * FROM p UNION ALL SELECT * FROM f)""")
def profile_or_fallback(spark, sf_dir):
    """The profile of each part; of parts without a note a gently falling series."""
    li = table(spark, sf_dir, "lineitem")
    x = li.select("l_suppkey", F.col("l_returnflag").alias("part"), F.col("l_linenumber").cast("int").alias("harmonic"), "l_extendedprice")
    parts = li.select(F.concat("l_linestatus", "l_returnflag").alias("part")).union(li.select("l_returnflag")).distinct()
    done = me.with_fallback(me.profile(x, ["l_suppkey"], ["part"], "harmonic", "l_extendedprice"), parts, ["part"], "harmonic")
    return done.select("part", "harmonic", r6(F.col("share")).alias("share"))


@query(f"""WITH {EV}, e AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1), m AS (SELECT ev.user_id, value FROM ev JOIN e USING (user_id) WHERE hi - lo <= {240 * HOUR} OR (us >= lo + (hi - lo - {240 * HOUR}) // 2 AND us < lo + (hi - lo - {240 * HOUR}) // 2 + {240 * HOUR}))
SELECT user_id, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total FROM m GROUP BY 1""")
def middle_levels(spark, sf_dir):
    """What each track has in its middle ten days, as forecasts look at a recording's middle."""
    m = me.middle(events(spark, sf_dir), ["user_id"], "us", 240 * HOUR)
    return m.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total"))


@query(None)
def note_matching(spark, sf_dir):
    """Precision, recall and F1 of views as estimates of clicks: at most a day and 50 units apart, each in one pair at most."""
    e = events(spark, sf_dir)
    est, ref = e.filter("part = 'view'"), e.filter("part = 'click'")
    pairs = se.note_pairs(est, ref, ["user_id"], "us", "value", 24 * HOUR, 50.0, 240 * HOUR)
    return se.scored(pairs, est, ref, ["user_id"]).withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


ROUNDS, LEAST = 4, 0.01


def rounds_sql() -> str:
    """The rounds of the pursuit, one after the other."""
    steps = []
    for n in range(1, ROUNDS + 1):
        before = " ".join(f"AND NOT EXISTS (SELECT 1 FROM t{k} WHERE t{k}.part = d.part AND t{k}.atom = d.atom)" for k in range(1, n))
        open_ = f"AND part IN (SELECT part FROM t{n - 1})" if n > 1 else ""
        steps += [
            f"d{n} AS (SELECT r.part, atom, sum(v * w) AS d FROM r{n - 1} r JOIN tp USING (part, cell) WHERE true {open_} GROUP BY 1, 2)",
            f"b{n} AS (SELECT d.part, d.atom, d / ww AS size, d * d / ww AS gain FROM d{n} d JOIN nm ON nm.part = d.part AND nm.atom = d.atom WHERE d > 0 {before} QUALIFY row_number() OVER (PARTITION BY d.part ORDER BY round(d * d / ww, 9) DESC, d.atom) = 1)",
            f"t{n} AS (SELECT b.part, atom, {n} AS round, size, gain / total AS more FROM b{n} b JOIN al USING (part) WHERE gain / total >= {LEAST})",
            f"r{n} AS (SELECT r.part, r.cell, r.v - coalesce(t.size * tp.w, 0) AS v FROM r{n - 1} r LEFT JOIN t{n} t ON t.part = r.part LEFT JOIN tp ON tp.part = r.part AND tp.atom = t.atom AND tp.cell = r.cell)",
        ]
    return ", ".join(steps) + f" SELECT part, atom, round, round(size, 6) AS size, round(more, 6) AS share FROM ({' UNION ALL '.join(f'SELECT * FROM t{n}' for n in range(1, ROUNDS + 1))})"


@query(f"""WITH {HOURLY}, r0 AS (SELECT part, hour AS cell, CAST(amount AS DOUBLE) AS v FROM hp), tp AS (SELECT part, cell, (cell + o + 24) % 24 AS atom, CASE o WHEN 0 THEN 1.0 ELSE 0.5 END AS w FROM r0, (SELECT unnest([-1, 0, 1]) AS o)),
nm AS MATERIALIZED (SELECT part, atom, sum(w * w) AS ww FROM tp GROUP BY 1, 2), al AS (SELECT part, sum(v * v) AS total FROM r0 GROUP BY 1), {rounds_sql()}""")
def explained_rounds(spark, sf_dir):
    """Which hours of the day, each with half of its neighbours, explain most of a part's hours, one after the other."""
    h = hourly(spark, sf_dir).select("part", F.col("hour").alias("cell"), F.col("amount").cast("double").alias("v"))
    near = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(1.0 if o == 0 else 0.5).alias("w")) for o in (-1, 0, 1))))
    atoms = h.select("part", "cell", near.alias("x")).select("part", ((F.col("cell") + F.col("x.o") + 24) % 24).alias("atom"), "cell", "x.w")
    done = pu.explain(h, atoms, ["part"], "cell", "v", "atom", "w", ROUNDS, LEAST)
    total = h.groupBy("part").agg(F.sum(F.col("v") * F.col("v")).alias("total"))
    size = atoms.groupBy("part", "atom").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    rows = done.found.join(total, "part").join(size, ["part", "atom"])
    return rows.select("part", "atom", "round", r6(F.col("size")).alias("size"), r6(F.col("size") * F.col("size") * F.col("ww") / F.col("total")).alias("share"))
