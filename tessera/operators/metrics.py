"""Levels, errors, shares and profiles of measured parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, correlation, power_db, ratio_db, rms
from .temporal import previous


def reconstruction_error(df: DataFrame, by: Sequence[str], original: str, rebuilt: str) -> DataFrame:
    """error_db: the level of what differs, against the original."""
    return df.groupBy(*by).agg(ratio_db(rms(F.col(original) - F.col(rebuilt)), rms(F.col(original))).alias("error_db"))


def si_sdr(df: DataFrame, by: Sequence[str], reference: str, estimate: str) -> DataFrame:
    """si_sdr_db and gain: both centred, the estimate's part along the reference against the rest; not a number for a
    reference without energy, infinite where nothing is left over, minus infinite where all is.

    The rest is summed in a second pass; the closed form of one pass cancels at high ratios."""
    w = Window.partitionBy(*by)
    r, e = (F.col(c).cast("double") for c in (reference, estimate))
    centred = df.withColumn("_r", r - F.avg(r).over(w)).withColumn("_e", e - F.avg(e).over(w))
    alpha = F.sum(F.col("_r") * F.col("_e")).over(w) / F.greatest(F.sum(F.col("_r") * F.col("_r")).over(w), F.lit(EPS))
    both = centred.withColumn("_s", alpha * F.col("_r")).withColumn("_n", F.col("_e") - F.col("_s"))
    signal, noise, level = (F.sum(F.col(c) * F.col(c)) for c in ("_s", "_n", "_r"))
    gain = F.sum(r * e) / F.greatest(F.sum(e * e), F.lit(EPS))
    db = F.when(level < EPS, F.lit(float("nan"))).when(noise < EPS, F.lit(float("inf"))).when(signal < EPS, F.lit(float("-inf"))).otherwise(10 * F.log10(signal / noise))
    return both.groupBy(*by).agg(db.alias("si_sdr_db"), gain.alias("gain"))


def gated_loudness(df: DataFrame, by: Sequence[str], at: str, power: str, block: int = 4, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """loudness and blocks: sliding blocks, first gated absolutely, then against the mean of what is left."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-(block - 1), 0)
    blocks = df.withColumn("_p", F.sum(power).over(w) / block).withColumn("_l", -0.691 + power_db(F.col("_p")))
    loud = blocks.filter(F.col("_l") > absolute)
    gate = loud.groupBy(*by).agg((-0.691 + power_db(F.avg("_p")) + relative).alias("_gate"))
    return loud.join(gate, list(by)).filter(F.col("_l") > F.col("_gate")).groupBy(*by).agg((-0.691 + power_db(F.avg("_p"))).alias("loudness"), F.count("*").alias("blocks"))


def band_shares(df: DataFrame, by: Sequence[str], freq: str, energy: str, edges: Sequence[float]) -> DataFrame:
    """shares of the bands between edges, crowding (the largest) and the centroid."""
    bands = [F.coalesce(F.sum(F.when((F.col(freq) >= a) & (F.col(freq) < z), F.col(energy))), F.lit(0)).cast("double") for a, z in zip(edges, edges[1:], strict=False)]
    total = F.sum(energy).cast("double")
    named = [(b / total).alias(f"band_{k}") for k, b in enumerate(bands)]
    return df.groupBy(*by).agg(*named, F.greatest(*(b / total for b in bands)).alias("crowding"), (F.sum(F.col(freq) * F.col(energy)).cast("double") / total).alias("centroid"))


def occupied(df: DataFrame, by: Sequence[str], value: str, part: float = 0.02) -> DataFrame:
    """Share of the cells above a part of the loudest one."""
    peak = df.groupBy(*by).agg(F.max(value).alias("_peak"))
    return df.join(peak, list(by)).groupBy(*by).agg(F.avg((F.col(value) > part * F.col("_peak")).cast("double")).alias("occupied"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], buckets: int = 4096) -> DataFrame:
    """by and the named exact percentiles (linear between ranks) of a value, for keys with any number of rows.

    Values are counted in buckets between a key's least and greatest; only those of the buckets that hold a wanted rank
    are counted by value and put in order. All counting is combined before the shuffle."""
    keys = list(by)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("long")
    placed = rows.join(span.drop("_n"), keys).select(*keys, bucket.alias("_b"), "_v")
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    held = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(order))
    at = lambda p: p * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in wanted.values()))))
    found = held.join(span.select(*keys, "_n"), keys).withColumn("_r", F.explode(ranks)).filter((F.col("_r") >= F.col("_upto") - F.col("_c")) & (F.col("_r") < F.col("_upto")))
    found = found.select(*keys, "_b", "_r", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_k"))
    inside = placed.join(found.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_m"))
    reach = F.sum("_m").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    exact_ = inside.withColumn("_to", reach).join(found, [*keys, "_b"]).filter((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_m"))).select(*keys, "_r", "_v")
    value_of = lambda rank: F.max(F.when(F.col("_r") == rank, F.col("_v")))
    part = lambda p: at(p) - F.floor(at(p))
    joined = exact_.join(span.select(*keys, "_n"), keys).groupBy(*keys, "_n").agg(*(x for n, p in wanted.items() for x in (value_of(F.floor(at(p))).alias(f"_{n}0"), value_of(F.ceil(at(p))).alias(f"_{n}1"))))
    return joined.select(*keys, *(((1 - part(p)) * F.col(f"_{n}0") + part(p) * F.col(f"_{n}1")).alias(n) for n, p in wanted.items()))


def crest(df: DataFrame, by: Sequence[str], value: str, high: float = 0.995, low: float = 0.5) -> DataFrame:
    """crest_db: the level of a high percentile over the median's."""
    both = percentiles(df, by, value, {"_high": high, "_low": low})
    return both.select(*by, ratio_db(F.col("_high"), F.col("_low")).alias("crest_db"))


def envelope(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, window: int) -> DataFrame:
    """Mean magnitude per window of rows; a last window that isn't full is dropped."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = df.withColumn("win", F.floor((F.row_number().over(w) - 1) / window))
    return at.groupBy(*by, "win").agg(F.avg(F.abs(F.col(value))).alias("envelope"), F.count("*").alias("_n")).filter(F.col("_n") == window).drop("_n")


def tempo_map(df: DataFrame, by: Sequence[str], at: str, beats: int) -> DataFrame:
    """bpm from each downbeat (a time in seconds) to the next; the last one repeats the one before."""
    w = Window.partitionBy(*by).orderBy(at)
    to_next = 60.0 * beats / F.nullif(F.lead(at).over(w) - F.col(at), F.lit(0))
    rated = df.withColumn("_bpm", to_next)
    return rated.withColumn("bpm", F.coalesce("_bpm", F.lag("_bpm").over(w))).drop("_bpm")


def onset_rate(df: DataFrame, by: Sequence[str], order: Sequence[str], t: str, value: str, least: float, slice_: Column) -> DataFrame:
    """onsets and their rate per minute: rises of at least `least` over the row before; slices of time part large keys."""
    rise = previous(df, by, order, value, slice_, "_before").withColumn("_up", F.col(value) - F.col("_before") >= least)
    minutes = (F.max(t) - F.min(t)) / 60.0
    return rise.groupBy(*by).agg(F.count_if("_up").alias("onsets"), F.when(minutes > EPS, F.count_if("_up") / minutes).alias("per_minute"))


def profile(df: DataFrame, note: Sequence[str], part: Sequence[str], harmonic: str, value: str) -> DataFrame:
    """The share of each harmonic: per note the median over its rows, made to sum to 1; then the median over notes, again."""
    one = df.groupBy(*note, *part, harmonic).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    scaled = one.withColumn("_m", F.col("_m") / F.sum("_m").over(Window.partitionBy(*note, *part)))
    both = scaled.groupBy(*part, harmonic).agg(F.percentile("_m", F.lit(0.5)).alias("_m"))
    return both.withColumn("share", F.col("_m") / F.sum("_m").over(Window.partitionBy(*(part or [F.lit(1)])))).drop("_m")


def with_fallback(shares: DataFrame, parts: DataFrame, part: Sequence[str], harmonic: str, harmonics: int = 16, fall: float = 1.2) -> DataFrame:
    """shares (part, harmonic, share) and, for each of parts that has none, a gently falling series: 1 / h ** fall, made to sum to 1."""
    total = sum(1 / h**fall for h in range(1, harmonics + 1))
    series = F.explode(F.array(*(F.struct(F.lit(h).cast(shares.schema[harmonic].dataType).alias(harmonic), F.lit(1 / h**fall / total).alias("share")) for h in range(1, harmonics + 1))))
    bare = parts.select(*part).distinct().join(shares.select(*part).distinct(), list(part), "left_anti").select(*part, series.alias("_h")).select(*part, f"_h.{harmonic}", "_h.share")
    return shares.select(*part, harmonic, "share").unionByName(bare)


def middle(df: DataFrame, by: Sequence[str], t: str, span: int) -> DataFrame:
    """The rows of each key within `span` of time around the middle of its own; all of a shorter one."""
    ends = df.groupBy(*by).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    begin = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo") - span) / 2)
    return df.join(ends, list(by)).filter((F.col("_hi") - F.col("_lo") <= span) | ((F.col(t) >= begin) & (F.col(t) < begin + span))).drop("_lo", "_hi")


def pan_spread(df: DataFrame, by: Sequence[str], left: str, right: str, least_spread: float = 0.22, least_side: float = 0.12) -> DataFrame:
    """Weighted mean and spread of the position, side against mid, and whether a split by position is worth it."""
    weight = F.col(left) + F.col(right)
    pan = F.when(weight > EPS, (F.col(right) - F.col(left)) / weight).otherwise(0.0)
    at = df.withColumn("_w", weight).withColumn("_p", pan)
    total = F.greatest(F.sum("_w"), F.lit(EPS))
    mean = F.sum(F.col("_w") * F.col("_p")) / total
    square = F.sum(F.col("_w") * F.col("_p") * F.col("_p")) / total
    side = F.sqrt(F.avg(F.pow((F.col(left) - F.col(right)) / 2, F.lit(2.0)))) / F.greatest(F.sqrt(F.avg(F.pow((F.col(left) + F.col(right)) / 2, F.lit(2.0)))), F.lit(EPS))
    out = at.groupBy(*by).agg(mean.alias("pan_mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("pan_spread"), side.alias("side_ratio"))
    usable = (F.col("pan_spread") > least_spread) & (F.col("side_ratio") > least_side)
    why = F.when(usable, "spread enough to split").when(F.col("pan_spread") <= least_spread, "all in one place").otherwise("too little at the sides")
    return out.withColumn("usable", usable).withColumn("reason", why)


def best_sibling(df: DataFrame, parent: Sequence[str], part: str, at: str, value: str) -> DataFrame:
    """Per part the largest |correlation| of its series with a sibling's (0 without siblings; a series that doesn't vary is like none)."""
    a, b = df.alias("a"), df.alias("b")
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*parent, at)]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    pairs = a.join(b, on & (F.col(f"a.{part}") != F.col(f"b.{part}"))).groupBy(*(F.col(f"a.{c}").alias(c) for c in (*parent, part)), F.col(f"b.{part}").alias("_other")).agg(correlation(F.col(f"a.{value}"), F.col(f"b.{value}")).alias("_r"))
    best = pairs.groupBy(*parent, part).agg(F.max(F.when(~F.isnan("_r"), F.round(F.abs("_r"), 6))).alias("likeness"))
    return df.select(*parent, part).distinct().join(best, [*parent, part], "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))


def grid_isolation(df: DataFrame, by: Sequence[str], row: str, col: str, value: str) -> DataFrame:
    """How far loud cells of a grid stand alone: 1.8 x the mean of 1 - local mean / cell over cells above 5 % of the peak.

    The local mean is over 3 rows x 5 columns; edge cells stand for those beyond the grid's ends."""
    peak = F.max(value).over(Window.partitionBy(*by))
    s = df.withColumn("_s", F.col(value) / F.greatest(peak, F.lit(EPS)))

    def smooth(d: DataFrame, across: str, along: str, half: int, name: str) -> DataFrame:
        w = Window.partitionBy(*by, across).orderBy(along)
        near = F.sum("_v").over(w.rowsBetween(-half, half))
        place, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by, across))
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low = F.greatest(F.lit(0), half + 1 - place) * F.first("_v").over(full)
        high = F.greatest(F.lit(0), place + half - size) * F.last("_v").over(full)
        return d.withColumn(name, (near + low + high) / (2 * half + 1))

    one = smooth(s.withColumn("_v", F.col("_s")), row, col, 2, "_h")
    two = smooth(one.withColumn("_v", F.col("_h")), col, row, 1, "_local")
    alone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_local") / (F.col("_s") + EPS)))
    return two.groupBy(*by).agg(F.least(F.lit(1.0), 1.8 * F.coalesce(F.avg(F.when(F.col("_s") > 0.05, alone)), F.lit(0.0))).alias("isolation"))


def explained(df: DataFrame, by: Sequence[str], value: str, rest: str) -> DataFrame:
    share = 1 - F.avg(F.col(rest) * F.col(rest)) / F.greatest(F.avg(F.col(value) * F.col(value)), F.lit(EPS))
    return df.groupBy(*by).agg(share.alias("explained"), ratio_db(rms(F.col(rest)), rms(F.col(value))).alias("residual_db"))


def spectrum_gap(df: DataFrame, by: Sequence[str], freq: str, a: str, b: str, low: float, high: float) -> DataFrame:
    """Mean distance of two log spectra in a band, each less its own mean there."""
    inside = df.filter((F.col(freq) >= low) & (F.col(freq) <= high)).withColumn("_a", F.log10(F.col(a) + 1e-8)).withColumn("_b", F.log10(F.col(b) + 1e-8))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    centred = inside.withColumn("_d", F.abs((F.col("_a") - F.avg("_a").over(w)) - (F.col("_b") - F.avg("_b").over(w))))
    return centred.groupBy(*by).agg(F.avg("_d").alias("gap"), F.count("*").alias("bins"))


def scores_by_concept(rows: DataFrame, vector: str, label: str, sharpness: float = 10.0) -> DataFrame:
    """Per label, the best softmax score that any vector gives its unit centroid (cosine x sharpness).

    Labels are few: their centroids go to the vectors as one row of arrays, so no vector is shuffled."""
    long = rows.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    centre = long.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("c")).select(label, F.transform("c", lambda x: x["c"]).alias("c"))
    concepts = centre.select(F.struct(label, "c", F.sqrt(dot(F.col("c"), F.col("c"))).alias("cn")).alias("k")).groupBy().agg(F.collect_list("k").alias("_all"))
    x = F.transform(vector, lambda v: v.cast("double"))
    scored = rows.select(x.alias("_x")).withColumn("_xn", F.sqrt(dot(F.col("_x"), F.col("_x")))).join(F.broadcast(concepts))  # one row is broadcast
    scored = scored.select(F.transform("_all", lambda k: F.struct(k[label].alias(label), F.exp(sharpness * dot(F.col("_x"), k["c"]) / F.greatest(k["cn"] * F.col("_xn"), F.lit(EPS))).alias("e"))).alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda acc, k: acc + k["e"])
    each = scored.withColumn("_total", total).select(F.explode("_s").alias("k"), "_total").select(F.col(f"k.{label}").alias(label), (F.col("k.e") / F.col("_total")).alias("_p"))
    return each.groupBy(label).agg(F.max("_p").alias("best"), F.avg("_p").alias("mean"))


def level_column(c: Column) -> Column:
    return power_db(c)
