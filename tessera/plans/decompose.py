"""Whole runs: a recording with injected estimates, or a folder of channels, to parts that sum to it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import EPS
from ..functions.text import lookup
from ..operators import chunks as ch
from ..operators import spectral as sp
from ..operators.judge import inventory_moves
from ..sources import audio as au
from .options import PART_TREE, SPLITS, Options

# Parts that no transposition changes.
UNPITCHED = ["drums", "kick", "snare", "toms", "hihat", "cymbals"]


class Result(NamedTuple):
    parts: DataFrame
    proof: DataFrame
    analysis: DataFrame
    click: DataFrame | None = None
    report: DataFrame | None = None


PARENT = {p[0]: p[1] for p in PART_TREE if p[1]}


def part_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PART_TREE, "part_key string, parent_key string, label string, filename string, color string, is_optional boolean")


def leaves(parts: DataFrame) -> DataFrame:
    """The parts of each track that no other part of it splits."""
    inner = parts.select("track_id", lookup(F.col("part_key"), PARENT).alias("part_key")).filter("part_key is not null").distinct()
    return parts.join(inner, ["track_id", "part_key"], "left_anti")


def proof(leaves: DataFrame, mix: DataFrame) -> DataFrame:
    """track_id, error_db: the level of what the leaves' sum misses of the mix (null if nothing measurable), or has beyond its end.

    Both are laid on one grid by their samples' places, however they are cut into chunks, and compared array by array."""
    key = ["track_id", "channel"]
    total = ch.added(ch.on_grid(leaves), key)
    both = ch.added(ch.on_grid(mix), key).withColumnRenamed("total", "m").join(total, [*key, "cell"], "full")
    zero, none = F.lit(0.0), F.array().cast("array<double>")
    miss = F.zip_with(F.coalesce("m", none), F.coalesce("total", none), lambda m, v: F.coalesce(m, zero) - F.coalesce(v, zero))
    sums = both.select("track_id", ch.squares(miss).alias("d"), ch.squares(F.coalesce("m", none)).alias("m"), F.size(miss).alias("n")).groupBy("track_id").agg(*(F.sum(c).alias(c) for c in "dmn"))
    missed, level = F.sqrt(F.col("d") / F.col("n")), F.sqrt(F.col("m") / F.col("n"))
    return sums.select("track_id", F.when((missed > EPS) & (level > EPS), 20 * F.log10(missed / level)).alias("error_db"))


def folded(parts: DataFrame, verdicts: DataFrame, options: Options) -> DataFrame:
    """parts (AUDIO) once rejected ones have given their samples to a sibling; verdicts: track_id, part_key, decision."""
    energies = parts.groupBy("track_id", "part_key").agg(F.sum(ch.squares(F.transform("samples", lambda x: x.cast("double")))).alias("_e"))
    moved = parts.join(inventory_moves(energies, verdicts, "track_id", "part_key", options.keep_uncertain), ["track_id", "part_key"]).withColumn("part_key", F.col("_to")).drop("_to")
    done = ch.added(ch.on_grid(moved), ["track_id", "part_key", "channel", "sr"])
    samples = F.transform("total", lambda x: x.cast("float")).alias("samples")
    return done.select("track_id", "part_key", "channel", F.col("cell").cast("int").alias("chunk_no"), (F.col("cell") * ch.CELL / F.col("sr")).alias("t0"), "sr", samples)


def separate(mix: DataFrame, estimates: DataFrame, options: Options = Options(), verdicts: DataFrame | None = None, notes: DataFrame | None = None, sections: DataFrame | None = None, knots: DataFrame | None = None) -> Result:
    """Split the mix down the tree by its estimates (AUDIO rows from any model), then fold what the verdicts reject, repair, regrid and transpose.

    Each step takes what it needs or is left out: verdicts (track_id, part_key, decision) for folds; notes and sections (as spectral.restored has
    them) for repairs, if options.restore; knots (track_id, source, target in microseconds) for a steady tempo, if that is asked for. The proof is
    of the split and its folds: repairs and what follows change the parts on purpose.

    A split's parts sum to their parent, so the leaves sum to the mix. A residual without an estimate is the parent less
    the others; lead and backing vocals, and the kit's pieces, need two estimates; without one of the vocals the mix stays whole."""
    whole = mix.withColumn("part_key", F.lit("mix"))
    every = whole.select(*sp.COLUMNS).unionByName(estimates.filter("part_key <> 'mix'").select(*sp.COLUMNS))
    parts = sp.split_tree(every, SPLITS, options.separation_power, options.exact, options.refine_rounds, options.power_end)
    if verdicts is not None:
        parts = folded(parts, verdicts, options)
    proven = proof(leaves(parts), whole)
    if options.restore and notes is not None and sections is not None:
        kept = parts.unionByName(whole.select(*sp.COLUMNS))
        parts = sp.restored(kept, PARENT, notes, sections, options.max_gap_ms, options.tolerance_db)
    if options.steady_tempo and knots is not None:
        parts = sp.moved_beats(parts, knots)
    if options.semitones:
        fixed = F.col("part_key").isin(UNPITCHED)
        parts = parts.filter(fixed).unionByName(sp.transpose(parts.filter(~fixed), options.semitones))
    return Result(parts, proven, sp.analyse(whole.select(*sp.COLUMNS)))


def multitrack(spark: SparkSession, folder: str, overrides: DataFrame | None = None) -> Result:
    """A folder of channels: classify (the folder's channels.json and the overrides given come first), pan, sum by part, and analyse the sum of all; the click and what became of each channel come with it."""
    own = au.channel_overrides(spark, folder)
    if overrides is not None:
        own = overrides.select("file", "given").union(own.join(overrides, "file", "left_anti"))
    named = au.classify_channels(au.read_wavs(spark, folder), own)
    parts = au.sum_channels(named)
    key = ["track_id", "channel", "sr"]
    total = ch.added(ch.on_grid(parts), key).withColumn("samples", F.transform("total", lambda x: x.cast("float"))).withColumn("part_key", F.lit("mix"))
    mix = total.withColumn("chunk_no", F.col("cell").cast("int")).withColumn("t0", F.col("cell") * ch.CELL / F.col("sr")).select(*sp.COLUMNS)
    return Result(parts, proof(parts, mix), sp.analyse(mix), au.click_channel(named), au.channel_report(named))
