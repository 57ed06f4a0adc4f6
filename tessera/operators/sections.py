"""Sections, cues and notes of tracks: snapping, downbeats, phrases, settings, peaks, matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBERED, lookup
from .scans import running
from .temporal import nearest, previous
from .tracks import in_order, kinds, split, starts, whole

# What a spoken cue calls a section, by language, and number words.
PHRASES = {
    "ro": {"intro": "Intro", "verse": "Strofa", "prechorus": "Pre refren", "chorus": "Refren", "bridge": "Bridge", "inst": "Instrumental", "solo": "Solo", "break": "Pauză", "outro": "Final", "end": "Sfârșit"},
    "en": {"intro": "Intro", "verse": "Verse", "prechorus": "Pre chorus", "chorus": "Chorus", "bridge": "Bridge", "inst": "Instrumental", "solo": "Solo", "break": "Break", "outro": "Outro", "end": "End"},
}
NUMBERS = {
    "ro": ["unu", "doi", "trei", "patru", "cinci", "șase", "șapte", "opt"],
    "en": ["one", "two", "three", "four", "five", "six", "seven", "eight"],
}
# A transcription's onset and frame thresholds and shortest note in ms, by part, and for others.
TRANSCRIPTION = {"lead_vocal": (0.8, 0.6, 400.0), "bgv": (0.8, 0.6, 400.0), "pads": (0.8, 0.6, 400.0), "bass": (0.8, 0.6, 400.0), "keys": (0.7, 0.5, 250.0), "electric_guitar": (0.7, 0.5, 250.0)}
OTHERS = (0.7, 0.5, 250.0)


def snap_sections(sections: DataFrame, downbeats: DataFrame, by: Sequence[str], start: str, duration: str, beat: str, width: int, shortest: int) -> DataFrame:
    """by, the section's own columns, start and end: starts moved to the nearest downbeat (the earlier of a tie), of
    sections that come to begin together the first kept, each ended by the next one and the last by the duration, and
    those of at most `shortest` left out. Tracks with fewer than two downbeats keep their sections as they are."""
    enough = downbeats.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(*by)
    moved = nearest(sections.join(enough, list(by), "left_semi"), downbeats.select(*by, F.col(beat).alias("_beat")), start, "_beat", by, width)
    first = moved.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "nearest").orderBy(start))).filter("_k = 1")
    following = F.lead("nearest").over(Window.partitionBy(*by).orderBy("nearest"))
    snapped = first.withColumn("end", F.coalesce(following, F.col(duration))).withColumn(start, F.col("nearest")).drop("nearest", "_k").filter(F.col("end") - F.col(start) > shortest)
    left = sections.join(enough, list(by), "left_anti")
    after = F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    return snapped.unionByName(left.withColumn("end", F.coalesce(after, F.col(duration))))


def downbeat_flags(beats: DataFrame, downbeats: DataFrame, by: Sequence[str], t: str, per_bar: int) -> DataFrame:
    """beats with is_down: whether a downbeat has the same time to four decimals; in tracks without any, every per_bar-th beat."""
    key = lambda c: F.round(F.col(c) * 10_000).cast("long").alias("_t")
    down = downbeats.select(*by, key(t), F.lit(True).alias("_down")).distinct()
    some = down.select(*by, F.lit(True).alias("_some")).distinct()
    placed = beats.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(t)) - 1).withColumn("_t", key(t))
    found = placed.join(down, [*by, "_t"], "left").join(some, list(by), "left")
    return found.withColumn("is_down", F.coalesce("_down", F.col("_some").isNull() & (F.col("_i") % per_bar == 0))).drop("_i", "_t", "_down", "_some")


def cue_phrase(label: Column, ordinal: Column, lang: Column) -> Column:
    """What a spoken cue says, in English for an unknown language; numbers in words up to eight."""
    words = lambda name: F.coalesce(lookup(label, PHRASES[name]), F.initcap(label))
    number = lambda name: F.coalesce(F.get(F.array(*map(F.lit, NUMBERS[name])), (ordinal - 1).cast("int")), ordinal.cast("string"))
    said = lambda name: F.when(label.isin(NUMBERED) & (ordinal > 0), F.concat(words(name), F.lit(" "), number(name))).otherwise(words(name))
    return F.when(lang == "ro", said("ro")).otherwise(said("en"))


def transcription_settings(parts: DataFrame, part: str) -> DataFrame:
    """parts with onset, frame and shortest_ms: those given (columns of these names, where not null), else the part's, else the usual ones."""
    out = parts
    for k, name in enumerate(("onset", "frame", "shortest_ms")):
        own = F.coalesce(lookup(F.col(part), {p: v[k] for p, v in TRANSCRIPTION.items()}), F.lit(OTHERS[k]))
        out = out.withColumn(name, F.coalesce(name, own) if name in parts.columns else own)
    return out


def strongest_apart(peaks: DataFrame, by: Sequence[str], freq: str, height: str, octaves: float, most: int) -> DataFrame:
    """Up to `most` peaks of each group, the highest first, all more than `octaves` apart."""
    rest, kept = peaks, None
    for _ in range(most):
        top = rest.groupBy(*by).agg(F.max(F.struct(height, freq)).alias("_x")).select(*by, F.col(f"_x.{height}").alias(height), F.col(f"_x.{freq}").alias(freq))
        kept = top if kept is None else kept.unionByName(top)
        rest = rest.join(top.select(*by, F.col(freq).alias("_f")), list(by)).filter(F.abs(F.log2(F.col(freq) / F.col("_f"))) > octaves).drop("_f")
    return kept


def largest_matching(mine: list[tuple], theirs: list[tuple], near: tuple[float, float]) -> list[tuple[int, int]]:
    """As many pairs (i, j) as can be, no note in two, of notes (t, pitch) that are within `near` in time and in pitch."""
    links = [[j for j, b in enumerate(theirs) if abs(a[0] - b[0]) <= near[0] and abs(a[1] - b[1]) <= near[1]] for a in mine]
    own, partner = [-1] * len(mine), [-1] * len(theirs)
    for i in range(len(mine)):
        came: dict[int, int] = {}  # who looked at a note of theirs first
        queue, free = [i], -1
        for k in queue:
            for j in links[k]:
                if j not in came:
                    came[j] = k
                    if partner[j] < 0:
                        free = j
                        break
                    queue.append(partner[j])
            if free >= 0:
                break
        while free >= 0:  # along the way back everyone moves on by one
            k = came[free]
            own[k], partner[free], free = free, k, own[k]
    return [(i, j) for i, j in enumerate(own) if j >= 0]


def note_pairs(est: DataFrame, ref: DataFrame, by: Sequence[str], t: str, pitch: str, near_t: int, near_pitch: float, slice_width: int, together: int = 100_000) -> DataFrame:
    """by, ref_t, ref_pitch, est_t, est_pitch: a largest one-to-one matching of notes at most near_t apart in time and near_pitch in pitch.

    A track's notes are parted wherever two neighbours in pitch are further apart than near_pitch, and those parts wherever two neighbours in
    time are further apart than near_t: no pair lies across. What is left together, a few notes in music, is matched by augmenting ways. Tracks of up to `together` notes are a task's, with many others."""
    keys = list(by)
    one = lambda d, kind: d.select(*keys, F.col(pitch).cast("double").alias("_p"), F.col(t).cast("long").alias("_t"), F.lit(kind).alias("_kind"))
    every = one(ref, 0).unionByName(one(est, 1)).filter("_p is not null and _t is not null")
    columns = ["ref_t", "ref_pitch", "est_t", "est_pitch"]
    schema = f"{kinds(every, keys)}, ref_t long, ref_pitch double, est_t long, est_pitch double"
    short, both = split(every, keys, every.groupBy(*keys).agg(F.count("*").alias("size")), together)

    def act(rows: pa.Table) -> pa.Table:
        p, at, kind = (rows.column(c).to_numpy() for c in ("_p", "_t", "_kind"))
        new = ~(np.diff(p, prepend=np.nan) <= near_pitch)
        new[starts(rows, keys)] = True
        line = np.cumsum(new)
        order = np.lexsort((kind, p, at, line))
        p, at, kind, line = p[order], at[order], kind[order], line[order]
        begin = np.flatnonzero(np.r_[True, (np.diff(line) > 0) | (np.diff(at) > near_t)])
        size, theirs = np.diff(np.r_[begin, len(p)]), np.add.reduceat(kind, begin)
        found, of = [], []
        for k in np.flatnonzero((theirs > 0) & (theirs < size)).tolist():
            here = slice(begin[k], begin[k] + size[k])
            notes = sorted(zip(kind[here].tolist(), at[here].tolist(), p[here].tolist(), strict=True))
            mine, others = ([x[1:] for x in notes if x[0] == which] for which in (0, 1))
            pairs = largest_matching(mine, others, (near_t, near_pitch))
            found += [(*mine[i], *others[j]) for i, j in pairs]
            of += [order[begin[k]]] * len(pairs)
        values = list(zip(*found, strict=True)) or [()] * 4
        out = rows.select(keys).take(pa.array(of, pa.int64()))
        for name, x, t in zip(columns, values, (pa.int64(), pa.float64()) * 2, strict=True):
            out = out.append_column(name, pa.array(x, t))
        return out

    done = whole(in_order(short, keys, ["_p", "_t", "_kind"]), keys, act, schema)
    if both is None:
        return done

    def parted(df: DataFrame, keys: list[str], at: str, near: float, slice_, out: str) -> DataFrame:
        order = [at, "_t", "_p", "_kind"]
        step = previous(df, keys, order, at, slice_, "_last").withColumn("_new", F.when(F.col(at) - F.col("_last") <= near, 0).otherwise(1))
        return running(step, keys, order, "_new", slice_, out).drop("_last", "_new")

    groups = parted(both, keys, "_p", near_pitch, F.floor(F.col("_p") / (1000 * near_pitch)), "_line")
    groups = parted(groups, [*keys, "_line"], "_t", near_t, F.floor(F.col("_t") / slice_width), "_island")

    def run(pdf):
        import pandas as pd

        mine, theirs = (sorted(zip(pdf["_t"][pdf["_kind"] == k].tolist(), pdf["_p"][pdf["_kind"] == k].tolist(), strict=True)) for k in (0, 1))
        pairs = largest_matching(mine, theirs, (near_t, near_pitch))
        out = pd.DataFrame([(*mine[i], *theirs[j]) for i, j in pairs], columns=columns)
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, *columns]]

    both_kinds = groups.groupBy(*keys, "_line", "_island").agg(F.count_if(F.col("_kind") == 0).alias("_a"), F.count_if(F.col("_kind") == 1).alias("_b")).filter("_a > 0 and _b > 0").select(*keys, "_line", "_island")
    return done.unionByName(groups.join(both_kinds, [*keys, "_line", "_island"]).groupBy(*keys, "_line", "_island").applyInPandas(run, schema))


def scored(pairs: DataFrame, est: DataFrame, ref: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_ref, n_est, matched, precision, recall, f1 of a matching."""
    count = lambda d, name: d.groupBy(*by).agg(F.count("*").alias(name))
    out = count(ref, "n_ref").join(count(est, "n_est"), list(by), "full").join(count(pairs, "matched"), list(by), "left").na.fill(0, ["n_ref", "n_est", "matched"])
    part = lambda c: F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(0.0)
    return out.withColumn("precision", part("n_est")).withColumn("recall", part("n_ref")).withColumn("f1", 2 * F.col("matched") / (F.col("n_ref") + F.col("n_est")))


def note_scores(est: DataFrame, ref: DataFrame, by: Sequence[str], t: str, pitch: str, tolerance: int) -> DataFrame:
    """by, n_ref, n_est, matched, precision, recall, f1: the largest one-to-one matching of notes of one pitch whose onsets
    are at most `tolerance` apart.

    On a line, taking the oldest open partner first gives the largest matching. A pitch's notes are parted wherever two
    of them are further apart than the tolerance; each part, a few notes, is folded by itself."""
    both = ref.select(*by, F.col(pitch).alias("_p"), F.col(t).alias("_t"), F.lit(0).alias("_kind")).union(est.select(*by, pitch, t, F.lit(1)))
    w = Window.partitionBy(*by, "_p").orderBy("_t", "_kind")
    parted = both.withColumn("_new", F.when(F.col("_t") - F.lag("_t").over(w) <= tolerance, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    runs = parted.groupBy(*by, "_p", "_island").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").cast("long").alias("t"), F.col("_kind").alias("kind")))).alias("x"), F.count_if(F.col("_kind") == 0).alias("n_ref"), F.count_if(F.col("_kind") == 1).alias("n_est"))

    def step(acc, x):
        live = F.filter(acc["open"], lambda o: x["t"] - o <= tolerance)
        meets = (acc["kind"] != x["kind"]) & (F.size(live) > 0)
        stay = F.when(acc["kind"] == x["kind"], live).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            F.when(meets, F.slice(live, 2, F.size(live))).otherwise(F.concat(stay, F.array(x["t"]))).alias("open"), F.when(meets, acc["kind"]).otherwise(x["kind"]).alias("kind"), (acc["n"] + F.when(meets, 1).otherwise(0)).alias("n")
        )

    start = F.struct(F.array().cast("array<bigint>").alias("open"), F.lit(0).alias("kind"), F.lit(0).alias("n"))
    folded = runs.select(*by, "n_ref", "n_est", F.aggregate("x", start, step, lambda acc: acc["n"]).cast("long").alias("matched"))
    out = folded.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_ref", "n_est", "matched")))
    part = lambda c: F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(0.0)
    both_ = F.col("n_ref") + F.col("n_est")
    return out.withColumn("precision", part("n_est")).withColumn("recall", part("n_ref")).withColumn("f1", F.when(both_ > 0, 2 * F.col("matched") / both_).otherwise(0.0))
