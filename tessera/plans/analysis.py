"""A recording's whole analysis: tempo, meter, downbeats, key and sections, as joins over the table of its beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pitch import camelot_table
from ..operators import music as mu
from ..operators import sections as se
from ..operators import spectral as sp
from ..operators import structure as st
from ..operators import temporal as te

SECOND = 1_000_000
DAY = 86_400 * SECOND


def median_step(times: Column) -> Column:
    steps = F.array_sort(F.transform(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda t, i: t - F.get(times, i)))
    return (F.get(steps, F.floor((F.size(steps) - 1) / 2).cast("int")) + F.get(steps, F.floor(F.size(steps) / 2).cast("int"))) / 2


def bars(beats: DataFrame) -> DataFrame:
    """track_id, beats_per_bar, phase: the meter by onset strength, and the phase with most low energy; 4 and 0 under four beats."""
    n = beats.groupBy("track_id").agg(F.count("*").alias("n"))
    of = mu.meter(beats, ["track_id"], ["beat_no"], "strength").select("track_id", F.col("beats").alias("beats_per_bar"))
    phases = beats.join(of, "track_id").groupBy("track_id", F.pmod("beat_no", "beats_per_bar").alias("phase")).agg(F.avg("low").alias("low"))
    best = phases.groupBy("track_id").agg(F.max(F.struct("low", (-F.col("phase")).alias("p")))["p"].alias("p"))
    few = F.col("n") < 4
    return n.join(of, "track_id").join(best, "track_id").select("track_id", "n", F.when(few, 4).otherwise(F.col("beats_per_bar")).alias("beats_per_bar"), F.when(few, 0).otherwise(-F.col("p")).alias("phase"))


def keys(tracks: DataFrame) -> DataFrame:
    """track_id, key, mode, key_confidence, camelot; C major without confidence where there is no sound."""
    profile = tracks.select("track_id", F.posexplode("chroma").alias("deg", "v")).withColumn("_all", F.sum("v").over(Window.partitionBy("track_id"))).filter("_all > 0")
    best = mu.detect_key(profile, ["track_id"], "deg", "v").select("track_id", F.col("key1").alias("key"), F.col("mode1").alias("mode"), F.round("confidence", 3).alias("key_confidence"))
    all_ = tracks.select("track_id").join(best, "track_id", "left").select("track_id", F.coalesce("key", F.lit(0)).alias("key"), F.coalesce("mode", F.lit("major")).alias("mode"), F.coalesce("key_confidence", F.lit(0.0)).alias("key_confidence"))
    return all_.join(F.broadcast(camelot_table(tracks.sparkSession).withColumnRenamed("pitch", "key")), ["key", "mode"])  # 24 rows


def sections(beats: DataFrame, tracks: DataFrame, downbeats: DataFrame) -> DataFrame:
    """track_id, start, end (seconds), label, ordinal of every section, snapped to downbeats."""
    ends = tracks.select("track_id", (F.col("duration") * SECOND).cast("long").alias("duration"))
    at = (F.col("t") * SECOND).cast("long")
    spans = beats.join(ends, "track_id").select("track_id", "beat_no", "duration", at.alias("start"), F.coalesce(F.lead(at).over(Window.partitionBy("track_id").orderBy("beat_no")), F.col("duration")).alias("end"), "energy", "features")
    clusters = st.segment_tracks(spans.select("track_id", "beat_no", "features"), "track_id", "beat_no", "features").withColumn("cluster", F.concat(F.lit("s"), F.col("cluster").cast("string")))
    placed = spans.join(clusters, ["track_id", "beat_no"])
    loud = te.islands(placed, ["track_id"], ["beat_no"], "cluster").groupBy("track_id", "run").agg(F.avg("energy").alias("energy"), F.max("duration").alias("duration"))
    runs = te.merge_runs(placed, ["track_id"], ["beat_no"], "cluster", "start", "end").join(loud, ["track_id", "run"])
    named = mu.label_segments(runs, ["track_id"], "cluster", "energy", "start", "end").select("track_id", "start", "label", "duration")
    moved = se.snap_sections(named, downbeats.select("track_id", at.alias("beat")), ["track_id"], "start", "duration", "beat", DAY, SECOND)
    ordinal = F.row_number().over(Window.partitionBy("track_id", "label").orderBy("start"))
    return moved.select("track_id", (F.col("start") / SECOND).alias("start"), (F.col("end") / SECOND).alias("end"), "label", ordinal.alias("ordinal"))


def analyze(audio: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """One row per track: bpm, beats_per_bar, key, mode, key_confidence, camelot, duration, beats, downbeats, sections, backend.

    trained (track_id, beats, downbeats, sections) comes from a model; where it has sections, its beats, downbeats and
    sections stand in place of ours, and the meter is the ratio of their median steps, from 2 to 7."""
    tracks = sp.beat_table(audio)
    beats = tracks.select("track_id", F.posexplode("beats").alias("beat_no", "b")).select("track_id", "beat_no", "b.*")
    of = bars(beats)
    down = beats.join(of, "track_id").filter(((F.col("n") < 4) & (F.col("beat_no") == 0)) | ((F.col("n") >= 4) & (F.col("beat_no") >= F.col("phase")) & (F.pmod(F.col("beat_no") - F.col("phase"), F.col("beats_per_bar")) == 0)))
    listed = lambda d, name, *cols: d.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(*cols) if len(cols) > 1 else F.col(cols[0]))).alias(name))  # noqa: E731  a track's own few
    found = sections(beats, tracks, down.select("track_id", "t"))
    out = tracks.select("track_id", F.round("bpm", 2).alias("bpm"), "duration", F.transform("beats", lambda b: b["t"]).alias("beats")).join(keys(tracks), "track_id").join(of.select("track_id", "beats_per_bar"), "track_id", "left")
    out = out.join(listed(down, "downbeats", "t"), "track_id", "left").join(listed(found, "sections", "start", "end", "label", "ordinal"), "track_id", "left").withColumn("backend", F.lit("own"))
    if trained is not None:
        theirs = trained.filter(F.size("sections") > 0).select("track_id", F.col("beats").alias("_beats"), F.col("downbeats").alias("_downbeats"), F.col("sections").alias("_sections"))
        has = F.col("_sections").isNotNull()
        ratio = F.greatest(F.lit(2), F.least(F.lit(7), F.bround(median_step(F.col("_downbeats")) / median_step(F.col("_beats")), 0))).cast("int")
        out = out.join(theirs, "track_id", "left").withColumn("beats_per_bar", F.when(has, F.coalesce(ratio, F.lit(4))).otherwise(F.col("beats_per_bar"))).withColumn("backend", F.when(has, "trained").otherwise("own"))
        out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("beats", "downbeats", "sections")}).drop("_beats", "_downbeats", "_sections")
    order = ["track_id", "bpm", "beats_per_bar", "key", "mode", "key_confidence", "camelot", "duration", "beats", "downbeats", "sections", "backend"]
    return out.withColumn("beats_per_bar", F.coalesce("beats_per_bar", F.lit(4))).select(*order)


def transposed(analysis: DataFrame, semitones: int) -> DataFrame:
    """The analysis with its key moved, and the wheel's code of the new one."""
    moved = analysis.withColumn("key", F.pmod(F.col("key") + semitones, F.lit(12))).drop("camelot")
    return moved.join(F.broadcast(camelot_table(analysis.sparkSession).withColumnRenamed("pitch", "key")), ["key", "mode"]).select(*analysis.columns)  # 24 rows


def steady_map(analysis: DataFrame, target_bpm: float | None = None) -> DataFrame:
    """track_id, source, target (microseconds): each beat and where it falls on a constant grid from the first one on, of the
    target tempo or else the usual step; tracks with fewer than four beats have none."""
    period = F.lit(60.0 / target_bpm) if target_bpm else median_step(F.col("beats"))
    beats = analysis.filter(F.size("beats") >= 4).select("track_id", period.alias("period"), F.get("beats", F.lit(0)).alias("first"), F.posexplode("beats").alias("k", "t"))
    return beats.select("track_id", (F.col("t") * SECOND).cast("long").alias("source"), ((F.col("first") + F.col("k") * F.col("period")) * SECOND).cast("long").alias("target"))


def regridded(analysis: DataFrame, knots: DataFrame) -> DataFrame:
    """The analysis with beats, downbeats, sections and tempo moved by the map; tracks that it doesn't have stay as they are."""
    points = analysis.select("track_id", F.posexplode(F.concat(
        F.transform("beats", lambda t: F.struct(F.lit("beat").alias("kind"), t.alias("t"))), F.transform(F.coalesce("downbeats", F.array().cast("array<double>")), lambda t: F.struct(F.lit("down").alias("kind"), t.alias("t"))),
        F.flatten(F.transform(F.coalesce("sections", F.array().cast(analysis.schema["sections"].dataType)), lambda s: F.array(F.struct(F.lit("start").alias("kind"), s["start"].alias("t")), F.struct(F.lit("end").alias("kind"), s["end"].alias("t"))))),
    )).alias("i", "x")).select("track_id", "i", "x.kind", (F.col("x.t") * SECOND).cast("long").alias("t"))
    moved = te.warp(points, knots, "t", "source", "target", ["track_id"], DAY, clamp=True).filter("warped is not null")
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("i", (F.col("warped") / SECOND).alias("t"))))), lambda x: x["t"])  # noqa: E731  a track's own few
    lists = moved.groupBy("track_id").agg(*(of(kind).alias(f"_{kind}") for kind in ("beat", "down", "start", "end")))
    out = analysis.join(lists, "track_id", "left")
    known = F.col("_beat").isNotNull()
    sections = F.transform("sections", lambda s, i: F.struct(F.get("_start", i).alias("start"), F.get("_end", i).alias("end"), s["label"].alias("label"), s["ordinal"].alias("ordinal")))
    changed = {"bpm": F.round(60 / median_step(F.col("_beat")), 2), "beats": F.col("_beat"), "downbeats": F.col("_down"), "sections": sections}
    return out.withColumns({c: F.when(known, new).otherwise(F.col(c)) for c, new in changed.items()}).select(*analysis.columns)


def regrid_report(knots: DataFrame) -> DataFrame:
    """track_id, beats_used, max_stretch, mean_stretch (source time per target time) and drift_ms (the largest move)."""
    w = Window.partitionBy("track_id").orderBy("source")
    steps = knots.withColumn("ds", F.col("source") - F.lag("source").over(w)).withColumn("dt", F.col("target") - F.lag("target").over(w))
    rate = F.when(F.col("dt") > 0, F.col("ds") / F.col("dt"))
    return steps.groupBy("track_id").agg(F.count("*").alias("beats_used"), F.round(F.max(rate), 4).alias("max_stretch"), F.round(F.sum("ds") / F.sum("dt"), 4).alias("mean_stretch"), F.round(F.max(F.abs(F.col("source") - F.col("target"))) / 1000, 1).alias("drift_ms"))


def transcription_report(parts: DataFrame, notes: DataFrame) -> DataFrame:
    """track_id, part_key, n_notes and warning of every pitched part, from notes that a model gave for it."""
    n = notes.groupBy("track_id", "part_key").agg(F.count("*").alias("n_notes"))
    every = parts.select("track_id", "part_key").distinct().join(n, ["track_id", "part_key"], "left").withColumn("n_notes", F.coalesce("n_notes", F.lit(0)))
    return every.withColumn("warning", F.when(F.col("n_notes") == 0, F.concat(F.lit("no notes in "), F.col("part_key"))))
