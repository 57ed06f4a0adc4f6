"""Repairs under a ceiling: what can't be repaired honestly is refused and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, correlation


def damage(df: DataFrame, by: Sequence[str], value: str, parent: str, floor_db: float, share: float = 0.35) -> DataFrame:
    """alive: loud enough and a fair share of its parent; lost: the parent is loud and the share small."""
    w = Window.partitionBy(*by)
    k = 10 ** (floor_db / 20)
    part = F.col(value) / F.greatest(F.col(parent), F.lit(EPS))
    peak, top = F.max(value).over(w), F.max(parent).over(w)
    return df.withColumn("alive", (F.col(value) > k * peak) & (part > share)).withColumn("lost", (F.col(parent) > k * top) & (part <= share))


def fill_gaps(df: DataFrame, by: Sequence[str], at: str, value: str, parent: str, longest: int) -> DataFrame:
    """filled and status (kept, repaired, refused, outside) of rows marked alive or lost.

    A lost run of at most `longest` steps between alive cells is filled log-linearly from both ends, never
    above the parent; longer ones are refused."""
    w = Window.partitionBy(*by).orderBy(at)
    back, forth = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    alive = lambda c: F.when(F.col("alive"), F.col(c))
    ends = (
        df.withColumn("_a", F.last(alive(at), ignorenulls=True).over(back)).withColumn("_va", F.last(alive(value), ignorenulls=True).over(back))
        .withColumn("_z", F.first(alive(at), ignorenulls=True).over(forth)).withColumn("_vz", F.first(alive(value), ignorenulls=True).over(forth))
    )
    within = F.col("_a").isNotNull() & F.col("_z").isNotNull()
    short = F.col("_z") - F.col("_a") - 1 <= longest
    place = (F.col(at) - F.col("_a")) / (F.col("_z") - F.col("_a"))
    line = F.exp(F.ln(F.greatest(F.col("_va"), F.lit(EPS))) * (1 - place) + F.ln(F.greatest(F.col("_vz"), F.lit(EPS))) * place)
    status = F.when(~F.col("lost") | F.col("alive"), "kept").when(~within, "outside").when(short, "repaired").otherwise("refused")
    filled = F.when(status == "repaired", F.greatest(F.col(value), F.least(line, F.col(parent)))).otherwise(F.col(value))
    return ends.withColumn("status", status).withColumn("filled", filled).drop("_a", "_va", "_z", "_vz")


def last_clean(df: DataFrame, by: Sequence[str], at: str, clean: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last_clean", F.last(F.when(F.col(clean), F.col(at)), ignorenulls=True).over(w))


def local_peaks(df: DataFrame, by: Sequence[str], at: str, value: str, half: int = 2, part: float = 0.85) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-half, half)
    return df.withColumn("is_peak", F.col(value) >= part * F.max(value).over(w))


def limiter(df: DataFrame, by: Sequence[str], at: str, value: str, ceiling: float, reach: int = 3) -> DataFrame:
    """gain: what keeps each value under the ceiling, spread ahead and behind and smoothed twice."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-reach, reach)
    target = F.least(F.lit(1.0), ceiling / F.greatest(F.abs(F.col(value)), F.lit(EPS)))
    out = df.withColumn("_t", target).withColumn("_m", F.min("_t").over(w)).withColumn("_s", F.avg("_m").over(w)).withColumn("_s", F.avg("_s").over(w))
    return out.withColumn("gain", F.least(F.col("_s"), F.col("_t"))).withColumn("limited", F.col(value) * F.col("gain")).drop("_t", "_m", "_s")


def borrow(df: DataFrame, group: Sequence[str], instance: str, at: str, value: str, parent: str, clean: str, least_cells: int, least_agreement: float) -> DataFrame:
    """Damaged cells take the median of the same cell in other instances of their group that agree with theirs.

    Two instances agree if the correlation of their log values over cells clean in both reaches the bar; a
    borrowed value only ever raises a cell and never exceeds its parent."""
    keys = [*group, at]
    host = df.select(*keys, F.col(instance).alias("_host"), F.col(value).alias("_hv"), F.col(clean).alias("_hc"), F.col(parent).alias("_hp"))
    donor = df.filter(clean).select(*keys, F.col(instance).alias("_donor"), F.col(value).alias("_dv"))
    pairs = host.join(donor, keys).filter("_host <> _donor")
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(EPS)))
    agree = pairs.filter("_hc").groupBy(*group, "_host", "_donor").agg(F.round(correlation(log("_hv"), log("_dv")), 6).alias("_r"), F.count("*").alias("_n")).filter((F.col("_n") >= least_cells) & (F.col("_r") >= least_agreement))
    lent = pairs.filter("not _hc").join(agree.select(*group, "_host", "_donor"), [*group, "_host", "_donor"]).groupBy(*keys, "_host").agg(F.percentile("_dv", F.lit(0.5)).alias("_b"), F.count("*").alias("donors"))
    out = df.join(lent.withColumnRenamed("_host", instance), [*keys, instance], "left")
    better = ~F.col(clean) & (F.least("_b", parent) > F.col(value))
    return out.withColumn("borrowed", F.coalesce(better, F.lit(False))).withColumn("restored", F.when(F.col("borrowed"), F.least("_b", parent)).otherwise(F.col(value))).withColumn("donors", F.coalesce("donors", F.lit(0).cast("long"))).drop("_b")


def harmonic_fit(df: DataFrame, note: Sequence[str], frame: Sequence[str], partial: str, value: str, parent: str, clean: str, worst: float = 0.45, least: int = 3) -> DataFrame:
    """Per frame the level that fits a note's partial ratios to the clean ones by least squares; a good fit raises damaged partials."""
    ok, q, v = F.col(clean), F.col("_q"), F.col(value)
    per, at = Window.partitionBy(*note, partial), Window.partitionBy(*note, *frame)  # windows: df is worked out once
    both = df.withColumn("_q", F.percentile(F.when(ok, v), F.lit(0.5)).over(per)).withColumn("_n", F.count_if(ok).over(per)).filter("_n >= 2").drop("_n")
    level = F.sum(F.when(ok, v * q)).over(at) / F.sum(F.when(ok, q * q)).over(at)
    fit = both.withColumn("siblings", F.count_if(ok).over(at)).withColumn("level", F.round(level, 9)).filter("siblings > 0")
    error = F.sum(F.when(ok, F.abs(v - F.col("level") * q))).over(at) / F.greatest(F.sum(F.when(ok, v)).over(at), F.lit(EPS))
    used = fit.withColumn("error", error)
    good = ~ok & (F.col("siblings") >= least) & (F.round("error", 6) <= worst)
    guess = F.least(F.col("level") * F.col("_q"), F.col(parent))
    return used.withColumn("raised", good & (guess > F.col(value))).withColumn("restored", F.when(F.col("raised"), guess).otherwise(F.col(value))).drop("_q")


def fill_from_template(df: DataFrame, value: str, parent: str, template: str, damaged: str, times: float = 1.5) -> DataFrame:
    """Damaged cells that the template exceeds clearly take it, up to their parent."""
    take = F.col(damaged) & (F.col(template) > times * F.col(value))
    return df.withColumn("taken", take).withColumn("restored", F.when(take, F.greatest(F.col(value), F.least(F.col(template), F.col(parent)))).otherwise(F.col(value)))
