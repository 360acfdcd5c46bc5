"""What the vector operators share: reading lists of floats from Arrow, and whole groups from sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not empty, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of vector among the lists."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, where = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(where)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[where[rows][:, None] + np.arange(d)[None]].astype(np.float64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys (longs): tables of whole groups, and where each group begins (and the end)."""
    carry: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        if not table.num_rows:
            continue
        cuts = bounds(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
        carry = table.slice(cuts[-2])
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks(), np.array([0, carry.num_rows])
