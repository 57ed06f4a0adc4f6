"""Spectra pooled to bands of equal ratio, folded to pitch classes, and made into slow, robust features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EPS

# Fixed values of the published chroma statistics (CENS): thresholds of a class's share, each of which adds a quarter.
THRESHOLDS, STEP = (0.4, 0.2, 0.1, 0.05), 0.25


def band_edge(band: Column, lowest: float, per_octave: int) -> Column:
    """Where a band begins: half a step below its centre, lowest * 2 ** (band / per_octave)."""
    return lowest * F.pow(F.lit(2.0), (band - 0.5) / per_octave)


def pooled(spectrum: DataFrame, by: Sequence[str], low: str, high: str, energy: str, lowest: float, per_octave: int = 12) -> DataFrame:
    """by, band and energy: each bin [low, high) gives every band that it lies in that share of its energy.

    A bin lists the bands that it touches itself, so there is no join; what is below band 0 is left out, all else is kept: bands sum to the bins."""
    place = lambda f: F.floor(per_octave * F.log2(F.greatest(F.col(f), F.lit(EPS)) / lowest) + 0.5)
    bins = spectrum.filter(F.col(high) > F.col(low)).select(*by, low, high, energy, F.explode(F.sequence(F.greatest(place(low) - 1, F.lit(0).cast("long")), F.greatest(place(high) + 1, F.lit(0).cast("long")))).alias("band"))
    begin, end = band_edge(F.col("band"), lowest, per_octave), band_edge(F.col("band") + 1, lowest, per_octave)
    share = (F.least(F.col(high), end) - F.greatest(F.col(low), begin)) / (F.col(high) - F.col(low))
    return bins.withColumn("_s", share).filter("_s > 0").groupBy(*by, "band").agg(F.sum(F.col(energy) * F.col("_s")).alias("energy"))


def classes(bands: DataFrame, by: Sequence[str], per_octave: int = 12) -> DataFrame:
    """by, pitch_class (0 .. 11, from the lowest band's) and energy of bands."""
    pitch = F.pmod(F.floor(F.col("band") * 12 / per_octave), F.lit(12))
    return bands.groupBy(*by, pitch.alias("pitch_class")).agg(F.sum("energy").alias("energy"))


def chroma_statistics(chroma: DataFrame, by: Sequence[str], frame: str, half: int = 20, hop: int = 10) -> DataFrame:
    """by, frame, pitch_class and value: shares of each frame in steps, smoothed over 2 half + 1 frames (Hann) and thinned to every hop-th, of length 1.

    Frames are dense whole numbers from 0; a class that a frame lacks counts as 0. Each value goes to the kept frames around it, so a long
    signal is no single window."""
    keys, t = list(by), F.col(frame)
    total = chroma.groupBy(*keys, frame).agg(F.sum("energy").alias("_all"), F.max("energy").alias("_top"))
    share = F.col("energy") / F.greatest(F.col("_all"), F.lit(EPS))
    stepped = chroma.join(total, [*keys, frame]).withColumn("_q", sum((F.when(share > x, STEP).otherwise(0.0) for x in THRESHOLDS), F.lit(0.0)))
    width = 2 * half + 3
    weights = [0.5 - 0.5 * math.cos(2 * math.pi * k / (width - 1)) for k in range(1, width - 1)]
    near = F.sequence(F.ceil(F.greatest(t - half, F.lit(0)) / hop), F.floor((t + half) / hop))
    weight = F.get(F.array(*(F.lit(w / sum(weights)) for w in weights)), (t - F.col("_k") * hop + half).cast("int"))
    spread = stepped.filter("_q > 0").withColumn("_k", F.explode(F.when(F.ceil(F.greatest(t - half, F.lit(0)) / hop) <= F.floor((t + half) / hop), near).otherwise(F.array().cast("array<bigint>"))))
    last = chroma.groupBy(*keys).agg(F.max(frame).alias("_last"))
    smooth = spread.join(last, keys).filter(F.col("_k") * hop <= F.col("_last")).groupBy(*keys, (F.col("_k") * hop).alias(frame), "pitch_class").agg(F.sum(F.col("_q") * weight).alias("_v"))
    length = smooth.groupBy(*keys, frame).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_len"))
    return smooth.join(length, [*keys, frame]).select(*keys, frame, "pitch_class", (F.col("_v") / F.greatest(F.col("_len"), F.lit(EPS))).alias("value"))
