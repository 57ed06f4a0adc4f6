"""Kernels over tables of audio: one group per track and channel, numpy inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .chunks import by_cell

AUDIO = "track_id string, part_key string, channel int, chunk_no int, t0 double, sr int, samples array<float>"
COLUMNS = ["track_id", "part_key", "channel", "chunk_no", "t0", "sr", "samples"]


def whole(pdf) -> np.ndarray:
    return np.concatenate(list(pdf.sort_values("chunk_no")["samples"])).astype(float)


def one_chunk(track, part, channel, sr, x: np.ndarray) -> tuple:
    return (track, part, int(channel), 0, 0.0, int(sr), x.astype(np.float32))


#: Samples of a frame and of a cell in which a tree is split: a multiple of the frames' step.
N_FFT, CELL = 4096, 1 << 17


def split_tree(audio: DataFrame, splits: list[tuple], power: float = 2.0, exact: bool = True, rounds: int = 0, end: float = 5.0, size: int = CELL) -> DataFrame:
    """All parts of the mixes in audio, from the estimates in it: the whole tree of a track and channel in one pass, cell by cell.

    Cells see as much of their neighbours as frames of all levels and rounds reach, so the parts are those of the signal as a whole."""
    levels: dict[str, int] = {}
    for parent, members, *_ in splits:
        levels |= {p: levels.get(parent, 0) + 1 for p in members}
    halo = N_FFT * max(levels.values(), default=0) * (1 + (rounds if exact else 0))

    def act(signals: dict, sr: int) -> dict:
        return {p: y for p, y in k.split_tree(signals, splits, power, exact, rounds, end).items() if p != "mix"}

    return by_cell(audio, size, halo, act, "mix", AUDIO, COLUMNS)


def per_signal(audio: DataFrame, change, name: str | None = None) -> DataFrame:
    """Each part's signal through change(x, sr) -> y."""

    def run(pdf):
        import pandas as pd

        sr = int(pdf["sr"].iloc[0])
        y = change(whole(pdf), sr)
        return pd.DataFrame([one_chunk(pdf["track_id"].iloc[0], name or pdf["part_key"].iloc[0], pdf["channel"].iloc[0], sr, y)], columns=COLUMNS)

    return audio.groupBy("track_id", "part_key", "channel").applyInPandas(run, AUDIO)


def transpose(audio: DataFrame, semitones: float) -> DataFrame:
    return per_signal(audio, lambda x, sr: k.pitch_shift(x, sr, semitones))


def resampled(audio: DataFrame, rate: int) -> DataFrame:
    """Each part's signal at another rate."""

    def run(pdf):
        import pandas as pd

        sr = int(pdf["sr"].iloc[0])
        x = whole(pdf)
        y = x if sr == rate else k.resample(x, sr, rate)
        return pd.DataFrame([one_chunk(pdf["track_id"].iloc[0], pdf["part_key"].iloc[0], pdf["channel"].iloc[0], rate, y)], columns=COLUMNS)

    return audio.groupBy("track_id", "part_key", "channel").applyInPandas(run, AUDIO)


def moved_beats(audio: DataFrame, knots: DataFrame) -> DataFrame:
    """Each part's signal with its beats moved by the map (track_id, source, target in microseconds); tracks without one stay."""
    lists = knots.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("knots"))  # a track's beats

    def run(pdf):
        import pandas as pd

        sr, x = int(pdf["sr"].iloc[0]), whole(pdf)
        pairs = pdf["knots"].iloc[0]
        at = np.array([[p["source"], p["target"]] for p in pairs], float) / 1e6 if pairs is not None and len(pairs) else np.empty((0, 2))
        return pd.DataFrame([one_chunk(pdf["track_id"].iloc[0], pdf["part_key"].iloc[0], pdf["channel"].iloc[0], sr, k.regrid(x, at[:, 0], at[:, 1], sr))], columns=COLUMNS)

    return audio.join(lists, "track_id", "left").groupBy("track_id", "part_key", "channel").applyInPandas(run, AUDIO)


def restored(audio: DataFrame, parents: dict[str, str], notes: DataFrame, sections: DataFrame, longest_ms: float = 250.0, tolerance_db: float = 1.5) -> DataFrame:
    """Parts of each track and channel after repairs: repeats, harmonics, short gaps, then together under the mix's ceiling.

    audio has the mix and the parts; a part's parent is the one named, or else the mix. notes: track_id, part_key, t_start,
    t_end, pitch, amplitude; sections: track_id, t_start, t_end, label. The loudest parent cells bound what is filled in."""
    of = lambda d, name, *cols: d.groupBy("track_id").agg(F.collect_list(F.struct(*cols)).alias(name))  # noqa: E731  a track's own
    rows = audio.join(of(notes, "notes", "part_key", "t_start", "t_end", "pitch", "amplitude"), "track_id", "left").join(of(sections, "sections", "t_start", "t_end", "label"), "track_id", "left")

    def run(pdf):
        import pandas as pd

        from .restoration import cap_to_mix, restore

        signals = {p: whole(g) for p, g in pdf.groupby("part_key")}
        mix, sr = signals.pop("mix"), int(pdf["sr"].iloc[0])
        listed = lambda name: [] if pdf[name].iloc[0] is None else list(pdf[name].iloc[0])
        spans = [(s["t_start"], s["t_end"], s["label"]) for s in listed("sections")]
        done = {}
        for part, x in signals.items():
            own = [(n["t_start"], n["t_end"], n["pitch"], n["amplitude"]) for n in listed("notes") if n["part_key"] == part]
            done[part] = restore(x, signals.get(parents.get(part, "mix"), mix), sr, own, spans, longest_ms)[0]
        bounded = cap_to_mix(done, signals, mix, tolerance_db)[0] if done else {}
        return pd.DataFrame([one_chunk(pdf["track_id"].iloc[0], p, pdf["channel"].iloc[0], sr, y) for p, y in bounded.items()], columns=COLUMNS)

    return rows.groupBy("track_id", "channel").applyInPandas(run, AUDIO)


def analyse(audio: DataFrame) -> DataFrame:
    """Tempo, beats, onset rate, harmonic share and mean chroma of every part's mono mix."""

    def run(pdf):
        import pandas as pd

        x = np.mean([whole(g) for _, g in pdf.groupby("channel")], axis=0)
        sr = int(pdf["sr"].iloc[0])
        bpm, times = k.beats(x, sr)
        rate = len(k.onsets(x, sr)) / max(len(x) / sr / 60, 1e-9)
        row = (pdf["track_id"].iloc[0], pdf["part_key"].iloc[0], bpm, times.tolist(), rate, k.harmonicity(x), k.chroma(x, sr).mean(1).tolist())
        return pd.DataFrame([row], columns=["track_id", "part_key", "bpm", "beats", "onsets_per_minute", "harmonicity", "chroma"])

    return audio.groupBy("track_id", "part_key").applyInPandas(run, "track_id string, part_key string, bpm double, beats array<double>, onsets_per_minute double, harmonicity double, chroma array<double>")


def beat_table(audio: DataFrame, rate: int = 22_050) -> DataFrame:
    """track_id, bpm, duration, chroma and beats (time, strength, low, energy, features) of each track's mono mix, on a copy of at most `rate`."""

    def run(pdf):
        import pandas as pd

        x, sr = np.mean([whole(g) for _, g in pdf.groupby("channel")], axis=0), int(pdf["sr"].iloc[0])
        if sr > rate:
            x, sr = k.resample(x, sr, rate), rate
        bpm, times = k.beats(x, sr)
        rows = [{"t": t, "strength": s, "low": low, "energy": e, "features": f} for t, s, low, e, f in k.beat_rows(x, sr, times)]
        return pd.DataFrame([(pdf["track_id"].iloc[0], float(bpm), len(x) / sr, k.chroma(x, sr).mean(1).tolist(), rows)], columns=["track_id", "bpm", "duration", "chroma", "beats"])

    return audio.groupBy("track_id").applyInPandas(run, "track_id string, bpm double, duration double, chroma array<double>, beats array<struct<t: double, strength: double, low: double, energy: double, features: array<double>>>")


def frame_energy(series: DataFrame, by: str, order: str, value: str, n_fft: int) -> DataFrame:
    """by, frame, energy, time_energy: FFT energy of whole frames of a series and the same from its samples."""

    def run(pdf):
        import pandas as pd

        x = pdf.sort_values(order)[value].to_numpy(float)
        frames = x[: len(x) // n_fft * n_fft].reshape(-1, n_fft)
        spec = np.square(np.abs(np.fft.fft(frames, axis=1))).sum(1) / n_fft
        return pd.DataFrame({by: pdf[by].iloc[0], "frame": np.arange(len(frames)), "energy": np.round(spec, 4), "time_energy": np.round(np.square(frames).sum(1), 4)})

    kind = series.schema[by].dataType.simpleString()
    return series.groupBy(by).applyInPandas(run, f"`{by}` {kind}, frame long, energy double, time_energy double")
