"""Long signals in pieces: a grid of cells, edges sent to the neighbours, overlapping pieces added up.

A signal's samples have places, counted from its start, so how a table cuts it into chunks
never matters: what is compared or added is first laid on a common grid, and what looks
at a stretch of samples gets the edges of the cells beside it. No signal is one group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a cell.
CELL = 1 << 16


def first_sample(t0: str = "t0", sr: str = "sr") -> Column:
    """The place of a chunk's first sample in its signal."""
    return F.round(F.col(t0) * F.col(sr)).cast("long")


def on_grid(audio: DataFrame, size: int = CELL, halo: int = 0) -> DataFrame:
    """audio's chunks cut along a grid: cell, place (the first sample's) and samples instead of chunk_no, t0; a cell also gets `halo` samples of
    each side from its neighbours, as far as there are any."""
    a, n = F.col("_a"), F.size("samples")
    k = F.sequence(F.floor((a - halo) / size), F.floor((a + n - 1 + halo) / size))
    rows = audio.filter(n > 0).withColumn("_a", first_sample()).withColumn("cell", F.explode(k)).filter("cell >= 0")
    lo, hi = F.greatest(a, F.col("cell") * size - halo), F.least(a + n, (F.col("cell") + 1) * size + halo)
    return rows.withColumn("place", lo).withColumn("samples", F.slice("samples", (lo - a + 1).cast("int"), (hi - lo).cast("int"))).drop("_a", "chunk_no", "t0")


def added(pieces: DataFrame, by: Sequence[str], samples: str = "samples", size: int = CELL) -> DataFrame:
    """by, cell and total: the sum of all pieces (cell, place) of a cell, sample by sample from the cell's start; pieces are added in order, so
    sums don't depend on how rows arrive. A cell has one piece for each part or frame there."""
    lead = F.array_repeat(F.lit(0.0), (F.col("place") - F.col("cell") * size).cast("int"))
    own = F.concat(lead, F.transform(samples, lambda x: x.cast("double")))
    order = F.struct(F.col("place").alias("place"), own.alias("x"))
    add = lambda acc, p: F.zip_with(acc, p["x"], lambda u, v: F.coalesce(u, F.lit(0.0)) + F.coalesce(v, F.lit(0.0)))
    rows = pieces.groupBy(*by, "cell").agg(F.array_sort(F.collect_list(order)).alias("_p"))
    return rows.select(*by, "cell", F.reduce("_p", F.array().cast("array<double>"), add).alias("total"))


def squares(samples: Column | str) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x)


def by_cell(audio: DataFrame, size: int, halo: int, act: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]], need: str, schema: str, columns: list[str]) -> DataFrame:
    """act(signals by part, sr) -> signals by part, cell by cell of each track and channel: it sees the samples of the part `need` in the cell and `halo`
    more on each side, with the other parts over the same stretch, and its results are kept within the cell, as chunks of the grid.

    size and halo should be multiples of the step of what act does, so that its frames lie where those of the whole signal would."""

    def run(pdf):
        import pandas as pd

        cell, sr = int(pdf["cell"].iloc[0]), int(pdf["sr"].iloc[0])
        own = pdf[pdf["part_key"] == need]
        lo = int(own["place"].min()) if len(own) else 0
        hi = int((own["place"] + own["samples"].map(len)).max()) if len(own) else 0
        begin, end = max(lo, cell * size), min(hi, (cell + 1) * size)
        if begin >= end:
            return pd.DataFrame([], columns=columns)
        signals = {}
        for part, g in pdf.groupby("part_key"):
            x = signals[part] = np.zeros(hi - lo)
            for place, samples in zip(g["place"], g["samples"], strict=True):
                a, z = max(lo, place), min(hi, place + len(samples))
                if a < z:
                    x[a - lo : z - lo] = samples[a - place : z - place]
        done = act(signals, sr)
        rows = [(pdf["track_id"].iloc[0], part, int(pdf["channel"].iloc[0]), cell, begin / sr, sr, y[begin - lo : end - lo].astype(np.float32)) for part, y in done.items()]
        return pd.DataFrame(rows, columns=columns)

    return on_grid(audio, size, halo).groupBy("track_id", "channel", "cell").applyInPandas(run, schema)


def frames(series: DataFrame, by: Sequence[str], index: str, value: str, n_fft: int, hop: int, act: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, together: int = 256) -> DataFrame:
    """by, frame and what act gives for each whole frame of a series on a dense integer axis (from 0; rows that are missing count as 0).

    `together` frames are a block; each row goes to the blocks whose frames it lies in, so the edges that two blocks share are sent to both and a
    series that a third of all rows has is worked on by many tasks. act: (frames, n_fft) -> columns; frames end with the series' last row."""
    span, i = together * hop, F.col(index)
    ends = series.groupBy(*by).agg(F.max(index).alias("_last"))
    blocks = series.select(*by, index, value, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((i - n_fft + 1 - (together - 1) * hop) / span)).cast("long"), F.floor(i / span).cast("long"))).alias("_block"))
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf):
        import pandas as pd

        block, last = int(pdf["_block"].iloc[0]), int(pdf["_last"].iloc[0])
        begin = block * span
        n = min(together, (last + 1 - n_fft - begin) // hop + 1)
        if n <= 0:
            return pd.DataFrame([], columns=[*by, "frame", *names])
        x = np.zeros((n - 1) * hop + n_fft)
        at = pdf[index].to_numpy(np.int64) - begin
        inside = (at >= 0) & (at < len(x))
        x[at[inside]] = pdf[value].to_numpy(float)[inside]
        got = act(np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop])
        return pd.DataFrame({c: [pdf[c].iloc[0]] * n for c in by} | {"frame": block * together + np.arange(n)} | got)[[*by, "frame", *names]]

    return blocks.join(ends, list(by)).groupBy(*by, "_block").applyInPandas(run, f"{kinds}, frame long, {schema}")
