"""A whole run with all its steps, and gated loudness as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as me
from tessera.plans.decompose import separate
from tessera.plans.options import Options
from tessera.sources import audio as au
from tessera.streaming import live

SR = 8000


def test_options_are_read_and_steps_follow_each_other(spark):
    t = np.arange(2 * SR) / SR
    truth = {"vocals": 0.3 * np.sin(2 * np.pi * 440 * t), "bass": 0.3 * np.sin(2 * np.pi * 55 * t)}
    frame = lambda s: spark.createDataFrame([("song", k, c, 0, 0.0, SR, [float(v) for v in np.float32(x)]) for k, x in s.items() for c in (0, 1)], au.AUDIO)
    notes = spark.createDataFrame([("song", "vocals", 0.1, 1.5, 69, 1.0)], "track_id string, part_key string, t_start double, t_end double, pitch int, amplitude double")
    sections = spark.createDataFrame([("song", 0.0, 2.0, "verse")], "track_id string, t_start double, t_end double, label string")
    knots = spark.createDataFrame([("song", k * 500_000, k * 600_000) for k in range(5)], "track_id string, source long, target long")
    mix, estimates = frame({"mix": truth["vocals"] + truth["bass"]}), frame({"vocals": truth["vocals"], "bass": truth["bass"]})
    plain = separate(mix, estimates, Options(restore=False), notes=notes, sections=sections, knots=knots)
    steady = separate(mix, estimates, Options(steady_tempo=True), notes=notes, sections=sections, knots=knots)
    size = lambda r: {x.part_key: x.n for x in r.parts.groupBy("part_key").agg(F.sum(F.size("samples")).alias("n")).collect()}
    before, after = size(plain), size(steady)
    assert set(before) == set(after) == {"vocals", "instrumental", "bass", "pads"} and all(after[p] > before[p] for p in before)
    assert all((r.proof.first().error_db or -200) < -100 for r in (plain, steady))
    assert Options().merged({"semitones": 2, "no_such": 1}) == Options(semitones=2)


def test_streamed_loudness_is_that_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(p, int(k), float(v)) for p, scale in (("a", 100.0), ("b", 3.0), ("quiet", 1e-12)) for k, v in enumerate(scale * rng.lognormal(0, 2.5, 400))]
    table = spark.createDataFrame(rows, "part string, at long, power double")
    for n in range(4):
        table.filter(F.pmod("at", F.lit(4)) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict[str, list] = {}

    def keep(batch, _):
        for r in batch.collect():
            seen.setdefault(r.part, []).append((r.loudness, r.blocks))

    old = spark.conf.get(live.STATE_STORE[0])
    try:
        q = live.gated_loudness(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.set(live.STATE_STORE[0], old)
    want = {r.part: r for r in me.gated_loudness(table, ["part"], "at", "power", block=1).collect()}
    assert set(seen) == set(want) == {"a", "b"} and all(len(x) == 4 for x in seen.values())
    for part, r in want.items():
        loudness, blocks = seen[part][-1]
        assert loudness == pytest.approx(r.loudness, abs=0.02) and abs(blocks - r.blocks) <= 1
