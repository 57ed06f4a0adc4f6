"""Pitches, keys and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of the twelve notes.
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

# Key profiles by scale degree, major and minor.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def hertz(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12.0)


def note_name(midi: Column) -> Column:
    names = F.array(*(F.lit(n) for n in NAMES))
    return F.concat(F.get(names, F.pmod(midi, F.lit(12)).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


def named_hertz(name: str, octave: int = 3) -> float:
    """The frequency of a note by name; an unknown name is read as C."""
    at = NAMES.index(name) if name in NAMES else 0
    return 440.0 * 2 ** ((at + 12 * (octave - 4) - 9) / 12)


def transposed(pitch: Column, by: Column) -> Column:
    return F.pmod(pitch + by, F.lit(12))


def shortest_move(a: Column, b: Column) -> Column:
    d = F.pmod(b - a, F.lit(12))
    return F.coalesce(F.when(d <= 6, d).otherwise(d - 12), F.lit(0))


def camelot_code(pitch: int, mode: str) -> str:
    """A key's place on the wheel of fifths: 8B is C major, 8A A minor."""
    fifths = (pitch * 7 + (0 if mode == "major" else 9)) % 12
    return f"{(fifths + 7) % 12 + 1}{'B' if mode == 'major' else 'A'}"


def camelot_table(spark: SparkSession) -> DataFrame:
    """pitch, mode, camelot: 24 rows."""
    return spark.createDataFrame([(p, m, camelot_code(p, m)) for m in ("major", "minor") for p in range(12)], "pitch int, mode string, camelot string")


def key_templates(spark: SparkSession) -> DataFrame:
    """key, mode, degree, weight: each of the 24 keys' profile over the 12 pitch classes."""
    rows = [(p, m, d, table[(d - p) % 12]) for m, table in (("major", MAJOR), ("minor", MINOR)) for p in range(12) for d in range(12)]
    return spark.createDataFrame(rows, "key int, mode string, degree int, weight double")
