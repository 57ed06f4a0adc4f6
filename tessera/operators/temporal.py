"""Joins and windows over time: ranges, nearest and as-of rows, warps, runs."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import absorbed, running
from .tracks import in_order, kinds, split, starts, whole


def range_join(points: DataFrame, intervals: DataFrame, t: str, low: str, high: str, width: int, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Points with low <= t < high, by an equal join on buckets of `width` (about an interval's length).

    Each interval is listed under every bucket that it touches and a point has one, so no pair comes twice."""
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    last = F.greatest(F.floor(F.col(low) / width), F.ceil(F.col(high) / width) - 1)
    i = intervals.withColumn("_ib", F.explode(F.sequence(F.floor(F.col(low) / width), last)))
    for c in by:
        i = i.withColumnRenamed(c, f"_{c}")
    on = (F.col("_b") == F.col("_ib")) & (F.col(t) >= F.col(low)) & (F.col(t) < F.col(high))
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return p.join(i, on, how).drop("_b", "_ib", *(f"_{c}" for c in by))


def around(left: DataFrame, right: DataFrame, t: str, s: str, by: Sequence[str], slice_width: int) -> DataFrame:
    """left with prev and next: the last s <= t and the first s >= t of right's rows with the same keys.

    A key's time is cut into slices, so that a hot key is worked on by many tasks: windows run within a
    slice, and one row per slice carries what lies before and after it."""
    cut = lambda c: F.floor(F.col(c) / slice_width).alias("_slice")
    rows = left.select("*", cut(t)).withColumn("_at", F.col(t)).withColumn("_s", F.lit(None).cast("long"))
    marks = right.select(*by, F.col(s).cast("long").alias("_s")).distinct().withColumn("_slice", F.floor(F.col("_s") / slice_width)).withColumn("_at", F.col("_s"))
    ends = marks.groupBy(*by, "_slice").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    steps = ends.unionByName(rows.select(*by, "_slice").distinct().withColumn("_lo", F.lit(None).cast("long")).withColumn("_hi", F.lit(None).cast("long")))
    steps = steps.groupBy(*by, "_slice").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_slice")
    carried = steps.select(*by, "_slice", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = rows.withColumn("_left", F.lit(True)).unionByName(marks.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    v = Window.partitionBy(*by, "_slice").orderBy("_at")
    near = both.withColumn("_p", F.max("_s").over(v.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.min("_s").over(v.rangeBetween(0, Window.unboundedFollowing))).filter("_left")
    out = near.join(carried, [*by, "_slice"], "left")
    return out.select(*(out[c] for c in left.columns), F.coalesce("_p", "_before").alias("prev"), F.coalesce("_n", "_after").alias("next"))


def nearest(left: DataFrame, right: DataFrame, t: str, s: str, by: Sequence[str], slice_width: int) -> DataFrame:
    """left with nearest: the closest s of right, the earlier one of a tie."""
    both = around(left, right, t, s, by, slice_width)
    later = F.col("prev").isNull() | (F.col("next") - F.col(t) < F.col(t) - F.col("prev"))
    return both.withColumn("nearest", F.when(F.col("next").isNotNull() & later, F.col("next")).otherwise(F.col("prev"))).drop("prev", "next")


def warp(points: DataFrame, knots: DataFrame, t: str, source: str, target: str, by: Sequence[str], width: int, clamp: bool = False) -> DataFrame:
    """points with warped: t carried through the piecewise linear map of knots; null outside it, or held at its ends."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(source)
    segments = knots.select(*by, F.col(source).alias("_x0"), F.col(target).alias("_y0"), F.lead(source).over(w).alias("_x1"), F.lead(target).over(w).alias("_y1"))
    inner = segments.filter("_x1 is not null and _x1 > _x0")
    ends = knots.groupBy(*by).agg(F.min(F.struct(source, target)).alias("_a"), F.max(F.struct(source, target)).alias("_z"))
    hit = range_join(points, inner, t, "_x0", "_x1", width, by, "left")
    line = F.col("_y0") + (F.col(t) - F.col("_x0")) * ((F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0")))
    out = hit.join(ends, list(by), "left") if by else hit.join(F.broadcast(ends))  # one row
    last = F.when(F.col(t) == F.col("_z")[source], F.col("_z")[target].cast("double"))
    held = F.when(F.col(t) < F.col("_a")[source], F.col("_a")[target].cast("double")).when(F.col(t) > F.col("_z")[source], F.col("_z")[target].cast("double"))
    return out.withColumn("warped", F.coalesce(line, last, held) if clamp else F.coalesce(line, last)).drop("_x0", "_y0", "_x1", "_y1", "_a", "_z")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, slice_: Column | None = None) -> DataFrame:
    """df with run: the number (from 1) of its run of equal labels. slice_ grows with the order: a key's slices are then worked on by many tasks."""
    slice_ = F.lit(0) if slice_ is None else slice_
    before = previous(df, by, order, label, slice_, "_l")
    changed = F.when(F.col("_l").eqNullSafe(F.col(label)), 0).otherwise(1)
    return running(before.withColumn("_c", changed), by, order, "_c", slice_, "run").drop("_c", "_l")


def merge_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, start: str, end: str, slice_: Column | None = None) -> DataFrame:
    """One row per run: label, its first start and last end, and ordinal: which run of that label it is."""
    runs = islands(df, by, order, label, slice_).groupBy(*by, "run", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("size"))
    ordinal = running(runs, [*by, label], ["run"], F.lit(1), F.floor(F.col("run") / 65_536), "ordinal")
    return ordinal.withColumn("ordinal", F.col("ordinal").cast("int"))


def absorb_short_runs(labels: list, least: int) -> list:
    """The shortest run under `least` (the first of equal ones) joins its longer neighbour (of equal ones the previous), again and again."""
    runs: list[list] = []  # label, size, previous, next; neighbours are numbers of runs
    for x in labels:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1, len(runs) - 1, len(runs) + 1])
    end = len(runs)
    queue = [(r[1], k) for k, r in enumerate(runs)]
    heapq.heapify(queue)
    left = end

    def remove(k: int) -> None:
        nonlocal left
        _, _, before, after = runs[k]
        runs[k][1] = 0
        left -= 1
        if before >= 0:
            runs[before][3] = after
        if after < end:
            runs[after][2] = before

    while left > 1:
        size, k = heapq.heappop(queue)
        if not runs[k][1] or size != runs[k][1]:
            continue  # merged or grown since
        if size >= least:
            break
        _, _, before, after = runs[k]
        into = before if before >= 0 and (after >= end or runs[before][1] >= runs[after][1]) else after
        runs[into][1] += size
        remove(k)
        if before >= 0 and after < end and runs[before][0] == runs[after][0]:
            runs[before][1] += runs[after][1]
            remove(after)
            into = before
        heapq.heappush(queue, (runs[into][1], into))
    return [x for x, n, *_ in runs for _ in range(n)]


def min_run_merge(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, least: int, slice_: Column | None = None, together: int = 20_000) -> DataFrame:
    """by, order columns and merged: labels once the shortest runs under `least` are absorbed, as absorb_short_runs does for a list.

    A track of up to `together` rows is one task's, with many others. Runs of a longer one are contracted in slices, so it may have any number of
    them; each row then takes the label of the run that its place came to lie in."""
    keys, columns = list(by), [*by, *order]
    named = df.withColumn("_label", F.col(label).cast("string"))
    short, long = split(named, keys, named.groupBy(*keys).agg(F.count("*").alias("size")), together)

    def act(rows: pa.Table) -> pa.Table:
        labels, begin = rows.column("_label").to_pylist(), starts(rows, keys).tolist()
        merged = [x for a, z in zip(begin, [*begin[1:], len(labels)], strict=True) for x in absorb_short_runs(labels[a:z], least)]
        return rows.select(columns).append_column("merged", pa.array(merged, pa.string()))

    done = whole(in_order(short.select(*columns, "_label"), keys, order), keys, act, f"{kinds(df, columns)}, merged string")
    return done if long is None else done.unionByName(long_merge(long, keys, order, label, least, slice_, together))


def long_merge(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, least: int, slice_: Column | None, together: int) -> DataFrame:
    """What min_run_merge does for tracks of any length."""
    keys, slice_ = list(by), F.lit(0) if slice_ is None else slice_
    rows = running(df.withColumn("_slice0", slice_).select(*keys, *order, label, "_slice0"), keys, order, F.lit(1), F.col("_slice0"), "_pos").drop("_slice0")
    runs = islands(rows, keys, ["_pos"], label, F.floor(F.col("_pos") / 65_536)).groupBy(*keys, "run", label).agg(F.min("_pos").alias("first"), F.count("*").alias("size"))
    left = absorbed(runs.select(*keys, F.col("run").cast("long").alias("num"), F.col(label).cast("string").alias("label"), "size", F.col("first").cast("long").alias("first")), keys, least, together)
    placed = around(rows.select(*keys, *order, F.col("_pos").cast("long").alias("_pos")), left, "_pos", "first", keys, 65_536)
    return placed.join(left.select(*keys, F.col("first").alias("prev"), F.col("label").alias("merged")), [*keys, "prev"]).select(*keys, *order, "merged")


def frame_spans(spans: DataFrame, start: str, end: str, hop: int, least: int = 4) -> DataFrame:
    """spans with frame0 and frame1: the frames (every hop) from the first at or after start to before the first at or after end; spans of fewer than `least` are left out."""
    first = lambda c: F.ceil(F.col(c) / hop).cast("long")
    return spans.withColumn("frame0", first(start)).withColumn("frame1", first(end)).filter(F.col("frame1") - F.col("frame0") >= least)


def frame_at(t: Column, hop: int, frames: Column) -> tuple[Column, Column]:
    """The first frame at or after t, clipped to those that there are, and whether it was one of them (null t: the first, and no)."""
    k = F.ceil(t / hop).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(k, F.lit(0)), frames - 1)), F.coalesce((k >= 0) & (k < frames), F.lit(False))


def steady_grid(spans: DataFrame, start: str, end: str, period: str) -> DataFrame:
    """spans with k and t: the steps of a constant grid over [start, end]."""
    n = F.floor((F.col(end) - F.col(start)) / F.col(period))
    return spans.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("t", F.col(start) + F.col("k") * F.col(period))


def moving_median(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, half: int) -> Column:
    """The median of the 2 half + 1 rows around each row; edge rows stand for those beyond the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = F.collect_list(value).over(w.rowsBetween(-half, half))
    place, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    padded = F.concat(F.array_repeat(first, F.greatest(F.lit(0), half + 1 - place)), near, F.array_repeat(last, F.greatest(F.lit(0), place + half - size).cast("int")))
    return F.get(F.array_sort(padded), F.lit(half))


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, slice_: Column, out: str) -> DataFrame:
    """df with out: the value of the row before, null for the first. Windows run within slices (which must grow with the
    order), so a key that very many rows have is worked on by many tasks; each slice's last value is carried to the next one."""
    keys = list(by)
    sliced = df.withColumn("_slice", slice_)
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))  # one row a slice
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    first = F.row_number().over(w) == 1
    within = sliced.withColumn("_first", first).withColumn("_within", F.lag(value).over(w))
    joined = within.join(carried, [*keys, "_slice"])
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_carried")["v"]).otherwise(F.col("_within"))).drop("_slice", "_first", "_within", "_carried")
