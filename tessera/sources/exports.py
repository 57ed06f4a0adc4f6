"""Text exports of sections and cues, and matching of note lists."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.temporal import range_join


def seconds_text(us: Column) -> Column:
    """Microseconds (not negative) as seconds with three decimals, halves up."""
    ms = F.floor((us + 500) / 1000)
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def marker_line(label: Column, start: Column, end: Column, offset: int) -> Column:
    """Name,Start,End,Length,Type of a section; times in microseconds."""
    return F.concat_ws(",", label, seconds_text(start + offset), seconds_text(end + offset), seconds_text(end - start), F.lit("section"))


def cue_time(us: Column) -> Column:
    """mm:ss:ff at 75 frames a second."""
    second = F.floor(us / 1_000_000)
    frame = F.least(F.lit(74), F.floor(us % 1_000_000 * 75 / 1_000_000))
    return F.format_string("%02d:%02d:%02d", F.floor(second / 60), second % 60, frame)


def bars(length: Column, bar: float) -> Column:
    """Whole bars of a length, halves to even, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.bround(length / bar, 0).cast("long"))


def cue_times(sections: DataFrame, by: Sequence[str], start: str, lead: int) -> DataFrame:
    """cue_us: three leads before a section's start; half a lead before the first one's, but not before 0."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(start)) == 1
    return sections.withColumn("cue_us", F.when(first, F.greatest(F.lit(0).cast("long"), F.col(start) - lead // 2)).otherwise(F.col(start) - 3 * lead))


def prominent(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, half: int, least: float) -> DataFrame:
    """Rows above their neighbours and at least `least` above the higher of the lowest values on either side."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = F.col(value)
    x = df.withColumn("_p", F.lag(v).over(w)).withColumn("_n", F.lead(v).over(w)).withColumn("_lo", F.min(v).over(w.rowsBetween(-half, -1))).withColumn("_hi", F.min(v).over(w.rowsBetween(1, half)))
    return x.filter((v > F.col("_p")) & (v >= F.col("_n")) & (v - F.greatest("_lo", "_hi") >= least)).drop("_p", "_n", "_lo", "_hi")


def match_notes(est: DataFrame, ref: DataFrame, by: Sequence[str], onset: int, pitch: int) -> DataFrame:
    """Counts of reference, estimated, matched (each other's closest, a greedy one-to-one matching) and octave errors.

    est: est, us, ep; ref: ref, rus, rp. The join in time is bucketed by the tolerance."""
    spans = ref.withColumn("_lo", F.col("rus") - onset).withColumn("_hi", F.col("rus") + onset + 1)
    m = range_join(est, spans, "us", "_lo", "_hi", 2 * onset, by).withColumn("d", F.abs(F.col("us") - F.col("rus")))
    close = m.filter(F.abs(F.col("ep") - F.col("rp")) <= pitch)
    best = close.withColumn("k", F.row_number().over(Window.partitionBy("est").orderBy("d", "ref"))).withColumn("j", F.row_number().over(Window.partitionBy("ref").orderBy("d", "est"))).filter("k = 1 and j = 1")
    octave = m.filter((F.col("ep") != F.col("rp")) & ((F.col("ep") - F.col("rp")) % 12 == 0)).select("est").distinct()
    kinds = [(ref, "reference"), (est, "estimated"), (best, "matched"), (octave, "octave_errors")]
    rows = [d.select(F.lit(n).alias("kind")) for d, n in kinds]
    every = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return every.groupBy().agg(*(F.count_if(F.col("kind") == n).alias(n) for _, n in kinds))


def write_text(lines: list[str], path: str) -> None:
    """A small text export (markers, cue sheet, chart), rendered on the driver from a manifest."""
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def cue_sheet(title: str, audio: str, rows: list[tuple[str, str]]) -> list[str]:
    """The lines of a cue sheet from (label, mm:ss:ff) rows."""
    out = [f'TITLE "{title}"', f'FILE "{audio}" WAVE']
    for k, (label, at) in enumerate(rows, 1):
        out += [f"  TRACK {k:02d} AUDIO", f'    TITLE "{label}"', f"    INDEX 01 {at}"]
    return out


def chart(title: str, key: str, bpm: float, rows: list[tuple[str, int, float]]) -> list[str]:
    """The lines of a chart from (label, bars, seconds) rows."""
    out = [f"# {title}", "", f"Key: {key}  Tempo: {bpm:.1f}", "", "| section | bars | at |", "| --- | --- | --- |"]
    return out + [f"| {label} | {n} | {int(at // 60)}:{int(at % 60):02d} |" for label, n, at in rows]


def session_json(title: str, analysis: dict, files: list[dict], **more) -> str:
    """The whole result as one document."""
    return json.dumps({"title": title, "analysis": analysis, "files": files, **more}, ensure_ascii=False, indent=2, default=str)


def folder_name(title: str, key: str, bpm: float, taken: set[str]) -> str:
    """Title [Key 76bpm], with a number if that is taken."""
    plain = re.sub(r"\s+", " ", re.sub(r"[^\w() -]", "_", title)).strip() or "Track"
    name = f"{plain} [{key} {bpm:.0f}bpm]"
    k, out = 2, name
    while out in taken:
        out, k = f"{name} ({k})", k + 1
    return out


def project_text(title: str, bpm: float, sections: list[tuple[str, float]], tracks: list[tuple[str, str, int, bool]]) -> str:
    """A plain-text audio project: tempo, markers and tracks (name, file, packed colour, muted)."""
    out = ['<REAPER_PROJECT 0.1 "6.0" 0', f"  TEMPO {bpm:.3f} 4 4"]
    out += [f'  MARKER {k} {at:.3f} "{label}"' for k, (label, at) in enumerate(sections, 1)]
    for name, file, color, muted in tracks:
        out += ["  <TRACK", f'    NAME "{name}"', f"    PEAKCOL {color}", f"    MUTESOLO {int(muted)} 0 0", "    <ITEM", "      POSITION 0", "      <SOURCE WAVE", f'        FILE "{file}"', "      >", "    >", "  >"]
    return "\n".join([*out, ">"]) + "\n"


def midi_bytes(notes: list[tuple[float, float, int, float]], program: int = 0, bpm: float = 120.0, drum: bool = False) -> bytes:
    """A one-track MIDI file of notes (start, end, pitch, level) in seconds."""
    ticks, channel = 480, 9 if drum else 0

    def length(n: int) -> bytes:
        out = [n & 0x7F]
        while n := n >> 7:
            out.append(n & 0x7F | 0x80)
        return bytes(out[::-1])

    beat = lambda t: round(t * bpm / 60 * ticks)
    moves = sorted([(beat(a), 1, p, min(127, max(1, round(v * 127)))) for a, _, p, v in notes] + [(beat(z), 0, p, 0) for _, z, p, _ in notes])
    body, last = length(0) + b"\xff\x51\x03" + struct.pack(">I", round(6e7 / bpm))[1:] + length(0) + bytes([0xC0 | channel, program]), 0
    for at, on, pitch, level in moves:
        body += length(at - last) + bytes([(0x90 if on else 0x80) | channel, pitch, level])
        last = at
    body += length(0) + b"\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ticks) + b"MTrk" + struct.pack(">I", len(body)) + body
