"""Keys that fit into a task, many of them in each; longer ones are told apart, for what works in slices or rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import cut


def split(df: DataFrame, by: Sequence[str], sizes: DataFrame, together: int) -> tuple[DataFrame, DataFrame | None]:
    """df's rows of keys of a size (by, size) up to `together`, and those of larger keys (None: there are none). Rows with a null key are left out."""
    keys, named = list(by), df.dropna(subset=list(by))
    large = cut(sizes.filter(F.col("size") > together).select(*keys))
    if large.isEmpty():
        return named, None
    return named.join(large, keys, "left_anti"), named.join(large, keys, "left_semi")


def starts(rows: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Where the keys of rows in order of them begin."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in by:
        a = rows.column(c).combine_chunks()
        new[1:] |= pc.not_equal(a.slice(1), a.slice(0, max(0, len(a) - 1))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole(df: DataFrame, by: Sequence[str], act: Callable[[pa.Table], pa.Table], schema: str, rows: int = 200_000) -> DataFrame:
    """What act gives for whole keys, about `rows` rows of them at a time; df's partitions must have whole keys, in order of them."""
    keys = list(by)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            last = int(starts(table, keys)[-1])
            if last:
                yield from act(table.slice(0, last)).to_batches()
            held, n = table.slice(last).to_batches(), n - last
        if n:
            yield from act(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(run, schema)


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with each key's rows in one partition, in order."""
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
