"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.store import Store


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a-b, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


#: Edges that a task joins up at once; more are taken in portions, whose forests are valid edges too.
PORTION = 1_000_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each portion of edges becomes the stars of its components: as connected, fewer."""

    def stars(parts):
        u, v = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= PORTION:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """edges (u, v) of longs without nulls -> (node, component): the smallest node reachable, for nodes with an edge.

    Every round is two joins with per-node minima, which partial aggregation computes; a node
    with a third of all edges is a skewed join key, which adaptive execution splits. Each round is
    written to the shared folder. Rounds are logarithmic in the longest path.
    """
    stars = edges.select("u", "v").where("u <> v").mapInArrow(_local, "u long, v long").distinct()
    stars = store.save(stars, f"{name}-0")
    state, turn = None, 0
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        # Large star: larger neighbours of a node move to the smallest neighbour.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").mapInArrow(_local, "u long, v long").distinct()
        large = store.save(large, f"{name}-{turn}-large")
        # Small star: smaller neighbours of a node, and itself, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        small = small.where("u <> v").mapInArrow(_local, "u long, v long").distinct()
        new = store.save(small, f"{name}-{turn + 1}")
        store.drop(f"{name}-{turn}", f"{name}-{turn}-large")
        stars, turn = new, turn + 1
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return store.save(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), f"{name}-components")
