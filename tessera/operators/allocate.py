"""Additive allocation: children always sum to their parent, exactly.

Weights are computed in doubles, amounts are kept as decimals, and what rounding
leaves goes to the loudest part. A group is one cell's parts, a handful of rows
after aggregation, so a hot cell is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, exact


def shares(df: DataFrame, cell: Sequence[str], weight: Column) -> DataFrame:
    """share of every row in its cell's weight; even shares where the cell has none."""
    w = Window.partitionBy(*cell)
    total = F.sum("_w").over(w)
    share = F.when(total < EPS, 1 / F.count("*").over(w)).otherwise(F.col("_w") / total)
    return df.withColumn("_w", weight).withColumn("share", share).drop("_w")


def settle(df: DataFrame, cell: Sequence[str], part: str, parent: str, loudness: Column, out: str = "allocated") -> DataFrame:
    """out := share x parent as a decimal; what is left of the parent goes to the loudest part."""
    w = Window.partitionBy(*cell)
    first = F.row_number().over(w.orderBy(F.desc("_l"), F.asc(part)))
    rough = df.withColumn("_l", loudness).withColumn("_y", exact(F.col("share") * F.col(parent).cast("double"))).withColumn("_first", first)
    left = F.col(parent) - F.sum("_y").over(w)
    return rough.withColumn(out, exact(F.col("_y") + F.when(F.col("_first") == 1, left).otherwise(F.lit(0)))).drop("_y", "_first", "_l")


def allocate(df: DataFrame, cell: Sequence[str], part: str, estimate: str, parent: str, power: float = 2.0) -> DataFrame:
    """Split each cell's parent over its parts in proportion to |estimate|^power."""
    loud = F.abs(F.col(estimate))
    return settle(shares(df, cell, F.pow(loud, F.lit(power))), cell, part, parent, loud)


def residual(df: DataFrame, cell: Sequence[str], part: str, amount: str, parent: str, rest: str) -> DataFrame:
    """Keep the parts' amounts; the part named rest gets what they leave of the parent, whatever was given for it."""
    own = df.filter(F.col(part) != rest).select(*cell, part, F.col(amount).alias("allocated"))
    left = df.groupBy(*cell).agg((F.max(parent) - F.coalesce(F.sum(F.when(F.col(part) != rest, F.col(amount))), F.lit(0))).alias("allocated"))
    return own.unionByName(left.select(*cell, F.lit(rest).alias(part), exact(F.col("allocated")).alias("allocated")))


def band_weight(freq: Column, low: Column, high: Column, nyquist: float, floor: float = 0.25) -> Column:
    """How plausible a frequency is for a part of the band [low, 6 high]; 1 for an unknown part."""
    top = F.least(6 * high, F.lit(nyquist))
    below = floor + (1 - floor) * F.pow(freq / F.greatest(low, F.lit(EPS)), F.lit(2.0))
    above = floor + (1 - floor) * F.pow(1 - (freq - top) / F.greatest(F.lit(nyquist) - top, F.lit(EPS)), F.lit(2.0))
    return F.when(low.isNull(), 1.0).when(freq < low, below).when(freq > top, above).otherwise(1.0)


def sharpen(df: DataFrame, cell: Sequence[str], part: str, estimate: str, parent: str, band: Column, rounds: int = 2, start: float = 2.0, end: float = 5.0) -> DataFrame:
    """Repeat the split with rising power and band weights, always of the parent."""
    cur = df.withColumn("_cur", F.abs(F.col(estimate)))
    for k in range(1, rounds + 1):
        power = start + (end - start) * k / rounds
        cur = shares(cur, cell, F.pow(F.col("_cur"), F.lit(power)) * band).withColumn("_cur", F.col("share") * F.col(parent).cast("double"))
    return settle(cur, cell, part, parent, F.col("_cur")).drop("_cur")


def fold(df: DataFrame, cell: Sequence[str], part: str, amount: str, least: float, into: str | None = None) -> DataFrame:
    """Parts with less than `least` of all energy give their amounts to `into`, else the loudest kept; nothing is lost."""
    energy = df.groupBy(part).agg(F.sum(F.col(amount).cast("double") * F.col(amount).cast("double")).alias("_e"))
    every = Window.partitionBy(F.lit(1))
    judged = energy.withColumn("_drop", F.col("_e") / F.sum("_e").over(every) < least)  # one row per part
    rank = F.row_number().over(every.orderBy(F.asc("_drop"), F.desc("_e"), F.asc(part)))
    named = judged.withColumn("_r", rank).withColumn("_to", F.lit(into) if into else F.max(F.when((F.col("_r") == 1) & ~F.col("_drop"), F.col(part))).over(every))
    target = F.when(F.col("_drop") & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col(part))
    return df.join(F.broadcast(named.select(part, target.alias("_part"))) if into is None else named.select(part, target.alias("_part")), part).groupBy(*cell, F.col("_part").alias(part)).agg(F.sum(amount).alias(amount))


def position_layers(df: DataFrame, cell: Sequence[str], left: str, right: str, names: Sequence[str] = ("left", "centre", "right"), width: float = 0.38) -> DataFrame:
    """Split a stereo cell into layers by its place between the channels; the layers sum to it."""
    total = F.col(left) + F.col(right)
    pan = F.when(total > EPS, (F.col(right) - F.col(left)).cast("double") / total.cast("double")).otherwise(0.0)
    kernels = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(float(k - 1)).alias("at")) for k, n in enumerate(names)))
    wide = df.withColumn("pan", pan).withColumn("parent", exact(total)).withColumn("k", F.explode(kernels)).select("*", "k.layer", "k.at").drop("k")
    kernel = F.exp(-F.pow((F.col("pan") - F.col("at")) / width, F.lit(2.0)) / 2)
    return settle(shares(wide, cell, kernel), cell, "layer", "parent", F.col("share")).drop("at")


def cap_additions(df: DataFrame, cell: Sequence[str], exact_col: str, restored: str, tolerance_db: float = 1.5) -> DataFrame:
    """Scale down what was added to a cell's parts until it fits the tolerance over the mix."""
    w = Window.partitionBy(*cell)
    added = F.col(restored) - F.col(exact_col)
    excess = F.abs(F.sum(added).over(w))
    room = F.abs(F.sum(exact_col).over(w)) * (10 ** (tolerance_db / 20) - 1)
    scale = F.when(excess > EPS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), room / excess))).otherwise(1.0)
    return df.withColumn("scale", scale).withColumn("capped", F.col(exact_col) + added * F.col("scale")).withColumn("trimmed", F.col("scale") < 1)
