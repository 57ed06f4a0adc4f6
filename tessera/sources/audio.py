"""Audio in and out: WAV files as rows of samples, channel folders as parts.

One row holds one chunk of one channel, so a recording's rows stay small and
spread; kernels regroup them by (track, part, channel).
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import match_length
from ..functions.text import CHANNELS, CLICK, IGNORED, channel_base, channel_name, channel_side, first_match, own_track
from ..operators.chunks import added, on_grid
from .wav import AUDIO, CHUNK, encoded, header, read_format, read_wavs, write_wavs  # noqa: F401  the tables of audio and its files


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """float32 (channel, sample) and the rate; one channel becomes two."""
    form = read_format(io.BytesIO(data), len(data))
    x = form.decoded(data[form.begin : form.begin + form.frames * form.frame])
    return (np.repeat(x, 2, 0) if form.channels == 1 else x), form.rate


def encode_wav(x: np.ndarray, sr: int, width: int = 3) -> bytes:
    """WAV bytes (24 or 16 bits) of a (channel, sample) array, clipped to +-1."""
    x = np.atleast_2d(x)
    return header(x.shape[1], len(x), sr, width) + encoded(x, width)


def channel_overrides(spark: SparkSession, path: str) -> DataFrame:
    """file, given: what the folder's channels.json (file name without ending -> part) says; no rows without one."""
    text = spark.read.format("binaryFile").option("pathGlobFilter", "channels.json").load(path).select(F.col("content").cast("string").alias("text"))
    return text.select(F.explode(F.from_json("text", "map<string,string>")).alias("file", "given"))


def match_shape(audio: DataFrame, channels: int, length: int) -> DataFrame:
    """Whole signals (one chunk a channel) with so many channels, the first repeated or the last left out, and samples, cut or silent at the end."""
    some = audio.filter(F.col("channel") < channels)
    n = F.max("channel").over(Window.partitionBy("track_id", "part_key"))
    spread = some.withColumn("_n", n).withColumn("_c", F.when(F.col("channel") == 0, F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: c > F.col("_n")))).otherwise(F.array("channel")))
    return spread.withColumn("channel", F.explode("_c")).withColumn("samples", match_length(F.col("samples"), F.lit(length))).drop("_n", "_c")


def classify_channels(audio: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """audio with clean, side and part_key by the channel rules; overrides (file, given) come first."""
    clean = channel_name(F.col("part_key"))
    rule = first_match(channel_base(clean), CHANNELS, own_track(clean))
    named = audio.withColumn("file", F.col("part_key")).withColumn("clean", clean).withColumn("side", channel_side(clean)).withColumn("rule", rule)
    if overrides is not None:  # by file name, with or without its ending
        stem = F.regexp_replace("file", r"\.[A-Za-z0-9]+$", "")
        given = overrides.groupBy(F.regexp_replace("file", r"\.(?i:wav|aif|aiff|flac|caf)$", "").alias("_stem")).agg(F.max("given").alias("given"))
        named = named.withColumn("_stem", stem).join(given, "_stem", "left").drop("_stem")
    else:
        named = named.withColumn("given", F.lit(None).cast("string"))
    return named.withColumn("part_key", F.coalesce("given", "rule")).drop("rule", "given")


def channel_report(classified: DataFrame) -> DataFrame:
    """track_id, file, clean, part_key, side, kind, sr, seconds of each channel: kind says whether it is a part's, the click's, ignored, or unmatched,
    which then is a part of its own."""
    part = F.col("part_key")
    kind = F.when(part == CLICK, "click").when(part == IGNORED, "ignored").when(part.startswith("ch_"), "unmatched").otherwise("part")
    ends = F.max(F.col("t0") + F.size("samples") / F.col("sr")).alias("seconds")
    return classified.groupBy("track_id", "file", "clean", "part_key", "side", "sr").agg(ends).withColumn("kind", kind)


def click_channel(classified: DataFrame) -> DataFrame:
    """The click's audio of each track: its first channel file by name."""
    clicks = classified.filter(F.col("part_key") == CLICK)
    first = clicks.groupBy("track_id").agg(F.min("file").alias("file"))
    return clicks.join(first, ["track_id", "file"]).select("track_id", F.lit("click").alias("part_key"), "channel", "chunk_no", "t0", "sr", "samples")


def sum_channels(audio: DataFrame, ceiling: float = 0.99) -> DataFrame:
    """Channels of a part panned by side and summed sample by sample, all parts under one gain per track.

    Clicks and ignored channels are left out; shorter channels count as silent at the end."""
    on = audio.filter(~F.col("part_key").isin(CLICK, IGNORED)).filter(((F.col("side") == "l") & (F.col("channel") == 0)) | ((F.col("side") == "r") & (F.col("channel") == 1)) | (F.col("side") == ""))
    # a part's channels of one cell are a handful of arrays, added in doubles and in order
    total = added(on_grid(on), ["track_id", "part_key", "channel", "sr"])
    summed = total.select("track_id", "part_key", "channel", F.col("cell").cast("int").alias("chunk_no"), (F.col("cell") * CHUNK / F.col("sr")).alias("t0"), "sr", F.col("total").alias("samples"))
    peak = summed.groupBy("track_id").agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))
    gain = F.when(F.col("peak") > ceiling, ceiling / F.col("peak")).otherwise(1.0)
    scaled = summed.join(peak, "track_id").withColumn("samples", F.transform("samples", lambda v: (v * gain).cast("float")))
    return scaled.select("track_id", "part_key", "channel", "chunk_no", "t0", "sr", "samples")
