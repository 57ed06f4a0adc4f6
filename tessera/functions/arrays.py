"""Sample arrays as columns: lengths, mono mixes, gains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import EPS


def match_length(samples: Column, n: Column) -> Column:
    """The first n samples, with silence where there are fewer."""
    zero = F.lit(0.0).cast("float")
    return F.concat(F.slice(samples, F.lit(1), n), F.array_repeat(zero, F.greatest(F.lit(0), n - F.size(samples))))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / 2)


def peak_db(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, F.abs))
    return F.when(peak > EPS, 20 * F.log10(peak))


def gain_to(level_db: Column, target_db: float, most: float = 24.0) -> Column:
    """The factor that brings a level to a target, within +-most dB; 1 for silence."""
    return F.coalesce(F.pow(F.lit(10.0), F.greatest(F.lit(-most), F.least(F.lit(most), target_db - level_db)) / 20), F.lit(1.0))


def scaled(samples: Column, gain: Column) -> Column:
    return F.transform(samples, lambda v: (v * gain).cast("float"))
