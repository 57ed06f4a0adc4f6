"""Verdicts from weighted evidence, with vetoes and reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, clip, ramp, reasons

# Weights of the evidence (energy, band, onset, harmonic, distinct), and limits.
WEIGHTS = {False: (0.20, 0.15, 0.15, 0.15, 0.35), True: (0.20, 0.15, 0.15, 0.0, 0.50)}
PRESENT, ABSENT = 0.62, 0.34


def presence(df: DataFrame, strictness: float = 1.0) -> DataFrame:
    """confidence, decision and why, from energy_db, band, onset, harmonic, distinct and percussive.

    Two vetoes cap the confidence: a part that its siblings already account for, and one hardly audible."""
    energy = ramp(F.col("energy_db"), -42.0, 27.0)
    score = lambda w: w[0] * energy + w[1] * F.col("band") + w[2] * F.col("onset") + w[3] * F.col("harmonic") + w[4] * F.col("distinct")
    raw = F.when(F.col("percussive"), score(WEIGHTS[True])).otherwise(score(WEIGHTS[False]))
    copied = F.when(F.col("distinct") < 0.15, F.least(raw, F.lit(0.30))).otherwise(raw)
    audible = F.least(copied, 0.2 + 0.8 * ramp(F.col("energy_db"), -50.0, 20.0))
    c = F.round(clip(audible), 6)
    decision = F.when(F.col("energy_db").isNull(), "absent").when(c >= PRESENT * strictness, "present").when(c < ABSENT * strictness, "absent").otherwise("uncertain")
    why = reasons((F.col("energy_db").isNull(), "silent"), (F.col("energy_db") < -35, "very quiet"), (F.col("band") < 0.3, "outside its band"), (F.col("distinct") < 0.15, "copies a sibling"), (F.col("onset") < 0.2, "few onsets"), default="supported")
    return df.withColumn("confidence", F.when(F.col("energy_db").isNull(), 0.0).otherwise(c)).withColumn("decision", decision).withColumn("why", F.array_join(why, "; "))


def blended(confidence: Column, second: Column) -> tuple[Column, Column]:
    """Confidence with a second opinion, and its decision."""
    c = F.round(0.65 * confidence + 0.35 * second, 6)
    return c, F.when(c >= PRESENT, "present").when(c < ABSENT, "absent").otherwise("uncertain")


def quality(bleed: Column, artifact: Column, fullness: Column) -> tuple[Column, Column]:
    """good, usable or rough, and notes."""
    verdict = F.when((bleed < 0.35) & (artifact < 0.35) & (fullness > 0.02), "good").when((bleed < 0.65) & (artifact < 0.6), "usable").otherwise("rough")
    notes = reasons((bleed >= 0.35, "bleeds into a sibling"), (artifact >= 0.35, "isolated cells"), (fullness <= 0.02, "thin"), default="clean")
    return verdict, F.array_join(notes, "; ")


def difficulty(density: Column, crest: Column, crowd: Column, width: Column, dull: Column, energy: Column | None = None) -> tuple[Column, Column]:
    """A weighted score and its grade; with no energy (where that is given) there is nothing to take apart, which is easy."""
    score = F.round(0.30 * density + 0.25 * crest + 0.20 * crowd + 0.15 * width + 0.10 * dull, 6)
    if energy is not None:
        score = F.when(energy < EPS, 0.0).otherwise(score)
    return score, F.when(score < 0.28, "easy").when(score < 0.48, "moderate").when(score < 0.68, "hard").otherwise("very hard")


def advice(density: Column, crest: Column, crowd: Column) -> Column:
    return F.array_join(reasons((density > 0.6, "expect shared cells"), (crest > 0.6, "limited dynamics"), (crowd > 0.5, "one register dominates"), default="no special care"), "; ")


# Groups of siblings, and the one of each that takes what others leave (none: the loudest kept).
SIBLINGS = {"vocals": (["lead_vocal", "bgv"], "lead_vocal"), "instrumental": (["drums", "bass", "electric_guitar", "keys", "pads"], "pads"), "drums": (["kick", "snare", "toms", "hihat", "cymbals"], None)}


def apply_inventory(parts: DataFrame, verdicts: DataFrame, track: str, part: str, cell: Sequence[str], amount: str, keep_uncertain: bool = True) -> DataFrame:
    """track, part, cell and amount once rejected parts have given theirs to a sibling; sums of siblings stay."""
    energies = parts.groupBy(track, part).agg(F.sum(F.col(amount).cast("double") * F.col(amount).cast("double")).alias("_e"))
    return parts.join(inventory_moves(energies, verdicts, track, part, keep_uncertain), [track, part]).groupBy(track, F.col("_to").alias(part), *cell).agg(F.sum(amount).alias(amount))


def inventory_moves(energies: DataFrame, verdicts: DataFrame, track: str, part: str, keep_uncertain: bool = True) -> DataFrame:
    """track, part and _to: where what a part has belongs by the verdicts; parts that leave the mix have no row. energies: track, part, _e.

    verdicts: track, part, decision. A part is rejected if it is absent (or uncertain, unless those are kept) and at
    least two of its siblings are there; its group's residual never is. Without a residual the loudest kept sibling
    takes the amounts; a group of which all would go stays. Pieces of a rejected drum kit are its own and leave with it."""
    group = {p: g for g, (members, _) in SIBLINGS.items() for p in members}
    rest = {p: r for members, r in SIBLINGS.values() for p in members if r}
    named = lambda table: F.coalesce(*(F.when(F.col(part) == k, v) for k, v in table.items()))
    known = energies.withColumn("_g", named(group)).withColumn("_r", named(rest)).join(verdicts.select(track, part, "decision"), [track, part], "left")
    out = F.col("decision").isin(["absent"] if keep_uncertain else ["absent", "uncertain"])
    siblings = Window.partitionBy(track, "_g")
    judged = known.withColumn("_out", F.coalesce(out & F.col("_g").isNotNull() & ~F.col(part).eqNullSafe(F.col("_r")), F.lit(False))).withColumn("_n", F.count("*").over(siblings)).withColumn("_kept", F.count_if(~F.col("_out")).over(siblings))
    judged = judged.withColumn("_out", F.col("_out") & (F.col("_n") > 1) & (F.col("_kept") > 0))
    loudest = F.max(F.when(~F.col("_out"), F.struct(F.col("_e").alias("e"), F.col(part).alias("p")))).over(siblings)["p"]
    has_rest = F.max(F.when(F.col(part) == F.col("_r"), F.col("_r"))).over(siblings)
    kit = F.max(F.when((F.col(part) == "drums") & F.col("_out"), True)).over(Window.partitionBy(track))
    placed = judged.withColumn("_to", F.when(F.col("_out"), F.coalesce(has_rest, loudest)).otherwise(F.col(part))).withColumn("_gone", F.coalesce(kit & F.col(part).isin(SIBLINGS["drums"][0]), F.lit(False)))
    return placed.filter(~F.col("_gone")).select(track, part, "_to")
