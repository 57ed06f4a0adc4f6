"""What a few templates explain of measured cells, found one by one in rounds that all groups share."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS
from .steps import cut


class Explained(NamedTuple):
    """found: by, atom, round and size (how much of the atom); rest: by, cell and rest, what is left of each cell; shares: by, explained and rounds."""

    found: DataFrame
    rest: DataFrame
    shares: DataFrame


def explain(values: DataFrame, atoms: DataFrame, by: Sequence[str], cell: str, value: str, atom: str, weight: str, rounds: int = 3, least: float = 0.01) -> Explained:
    """In each round every group takes the atom that explains most of what is left of it, and looks at the rest again.

    values: by, cell, value; atoms: by, atom, cell, weight (a group's templates). An atom is taken once. A group is done when a round would explain less
    than `least` more of its power; it keeps what it had, and the others go on. A round is one join of all groups' cells with their atoms, summed
    before it is shuffled by atom, so neither a group nor an atom is one task's; of equal atoms the first by name is taken."""
    keys = list(by)
    power = F.sum(F.col("_r") * F.col("_r"))
    rest = cut(values.select(*keys, cell, F.col(value).cast("double").alias("_r")))
    whole = rest.groupBy(*keys).agg(F.greatest(power, F.lit(EPS)).alias("_all"))
    state = cut(whole.withColumn("explained", F.lit(0.0)).withColumn("rounds", F.lit(0)).withColumn("_open", F.lit(True)))
    found = None
    one = atoms.select(*keys, atom, cell, F.col(weight).cast("double").alias("_w"))
    norms = cut(one.groupBy(*keys, atom).agg(F.sum(F.col("_w") * F.col("_w")).alias("_ww")).filter(F.col("_ww") > EPS))
    for n in range(1, rounds + 1):
        left = norms if found is None else norms.join(found.select(*keys, atom), [*keys, atom], "left_anti")
        open_ = state.filter("_open").select(*keys)
        dots = rest.join(open_, keys).join(one, [*keys, cell]).groupBy(*keys, atom).agg(F.sum(F.col("_r") * F.col("_w")).alias("_d")).join(left, [*keys, atom])
        order = Window.partitionBy(*keys).orderBy(F.round(F.col("_d") * F.col("_d") / F.col("_ww"), 9).desc(), atom)
        best = cut(dots.filter("_d > 0").withColumn("_k", F.row_number().over(order)).filter("_k = 1").select(*keys, atom, (F.col("_d") / F.col("_ww")).alias("size"), (F.col("_d") * F.col("_d") / F.col("_ww")).alias("_gain")))
        judged = best.join(state.select(*keys, "_all"), keys).withColumn("_more", F.col("_gain") / F.col("_all"))
        taken = cut(judged.filter(F.col("_more") >= least).select(*keys, atom, F.lit(n).alias("round"), "size", "_more"))
        if taken.isEmpty():
            break
        found = taken.drop("_more") if found is None else found.unionByName(taken.drop("_more"))
        parts = taken.select(*keys, atom, "size").join(one, [*keys, atom]).select(*keys, cell, (F.col("size") * F.col("_w")).alias("_y"))
        rest = cut(rest.join(parts, [*keys, cell], "left").select(*keys, cell, (F.col("_r") - F.coalesce("_y", F.lit(0.0))).alias("_r")))
        now = state.join(taken.select(*keys, "_more"), keys, "left")
        state = cut(now.select(*keys, "_all", (F.col("explained") + F.coalesce("_more", F.lit(0.0))).alias("explained"), F.when(F.col("_more").isNotNull(), n).otherwise(F.col("rounds")).alias("rounds"), (F.col("_open") & F.col("_more").isNotNull()).alias("_open")))
    if found is None:
        found = norms.limit(0).select(*keys, atom, F.lit(0).alias("round"), F.lit(0.0).alias("size"))
    return Explained(found, rest.withColumnRenamed("_r", "rest"), state.select(*keys, "explained", "rounds"))
