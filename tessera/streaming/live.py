"""Structured Streaming forms of event rates, levels and sessions (an extension: the batch queries are the measure)."""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """New Parquet files under path as a stream, with ts as an instant so that it can be watermarked."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def rates(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value per part and tumbling window; a window is given once it can't change."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), F.col("event_type").alias("part")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "part", "n", "mean")


def block_levels(stream: DataFrame, block: str = "4 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean square per part over sliding blocks, the streaming part of gated loudness."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", block, step), F.col("event_type").alias("part")).agg(F.avg(F.col("value") * F.col("value")).alias("power")).select(F.col("window.start").alias("start"), "part", "power")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's sessions of events no further apart than gap, given once they have closed."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


#: Where RocksDB keeps state by key and map key, which the histogram of levels needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class GatedLoudness(StatefulProcessor):
    """Per part, how many blocks have had each level and their power: the relative gate depends on all earlier blocks, so levels are kept and
    not blocks. Levels are `step` dB wide: state is bounded by their range, whatever the stream's length."""

    def __init__(self, absolute: float, relative: float, step: float):
        self.absolute, self.relative, self.step = absolute, relative, step

    def init(self, handle) -> None:
        self.levels = handle.getMapState("levels", "level long", "n long, power double")

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:  # noqa: N802  Spark's name
        import pandas as pd

        added: dict[int, list[float]] = {}
        for pdf in rows:
            for p in pdf["power"].tolist():
                if p is not None and p > 1e-10 and (level := -0.691 + 10 * log10(p)) > self.absolute:
                    own = added.setdefault(int(level // self.step), [0, 0.0])
                    own[0] += 1
                    own[1] += p
        for level, (n, power) in added.items():
            before = self.levels.getValue((level,)) if self.levels.containsKey((level,)) else (0, 0.0)
            self.levels.updateValue((level,), (int(before[0] + n), float(before[1] + power)))
        every = [(level, n, power) for (level,), (n, power) in self.levels.iterator()]
        if not every:
            return
        mean = lambda x: sum(p for *_, p in x) / sum(n for _, n, _ in x)
        gate = -0.691 + 10 * log10(mean(every)) + self.relative
        # a level counts by its blocks' mean power: all of it lies on one side, but for the level that the gate cuts
        loud = [x for x in every if -0.691 + 10 * log10(x[2] / x[1]) > gate]
        yield pd.DataFrame({"part": [key[0]], "loudness": [-0.691 + 10 * log10(mean(loud))], "blocks": [sum(n for _, n, _ in loud)]})

    def close(self) -> None:
        pass


def gated_loudness(blocks: DataFrame, absolute: float = -70.0, relative: float = -10.0, step: float = 0.01) -> DataFrame:
    """part, loudness, blocks after every batch of a stream of blocks (part, power): those above the absolute gate that are above the relative one
    of all so far, as the batch form has them but for blocks within `step` dB of the gate."""
    blocks.sparkSession.conf.set(*STATE_STORE)
    return blocks.groupBy("part").transformWithStateInPandas(GatedLoudness(absolute, relative, step), "part string, loudness double, blocks long", "Update", "None")
