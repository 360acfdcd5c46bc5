"""Embedding near-dedup by p-stable hashing of unit vectors, and exact cosines within buckets.

A table's bucket is PROJECTIONS Gaussian projections of the unit vector, shifted and cut into
cells of WIDTH. Cosine 0.98 is distance 0.2, where two cells agree with probability 0.89, so a
table finds a pair with 0.26 and TABLES tables miss one in 400 at the threshold itself (and ever fewer
nearer); vectors at a right angle meet in a table about once in 90,000 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.components import components
from callscape.llm.shingles import U, mix
from callscape.llm.store import Store
from callscape.llm.vectors import matrices, usable, whole_groups

PROJECTIONS, TABLES, WIDTH, LEAST = 12, 20, 1.5, 0.98
#: Vectors that a block of a bucket holds, about; a larger bucket is compared block by block.
BLOCK = 256


@lru_cache
def _planes(d: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919 + d)
    return rng.standard_normal((d, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def buckets(x: np.ndarray) -> np.ndarray:
    """Bucket hashes (rows, TABLES) of vectors in rows."""
    unit = x / np.abs(x).max(1, keepdims=True)  # no overflow
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = _planes(x.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    h = np.broadcast_to(mix(np.arange(TABLES, dtype=np.uint64) + U(x.shape[1] << 20)), (len(x), TABLES))
    for i in range(PROJECTIONS):
        h = mix(h + cells[:, :, i])
    return h.view(np.int64)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((batch.num_rows, TABLES), np.int64)
        for rows, x in matrices(batch.column("vector")):
            out[rows] = buckets(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * TABLES), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "id", "label", "vector")), lists], names=["row", "id", "label", "vector", "hashes"])


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["bucket", "i", "j"]):
            rows, ids = table.column("row").to_numpy(), table.column("id").to_numpy()
            block, i, j, nth = (table.column(c).to_numpy() for c in ("block", "i", "j", "nth"))
            hashes = table.column("hashes").combine_chunks().values.to_numpy().reshape(len(rows), TABLES)
            where = table.column("vector").combine_chunks().offsets.to_numpy()
            flat = table.column("vector").combine_chunks().values.to_numpy()
            out: list[tuple] = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                members = np.arange(lo, hi)
                d = where[lo + 1] - where[lo]
                members = members[np.diff(where[lo : hi + 1]) == d]  # hashes of other lengths don't collide but by chance
                x = flat[where[members][:, None] + np.arange(d)[None]].astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                a = np.flatnonzero(block[members] == i[lo])
                b = a if i[lo] == j[lo] else np.flatnonzero(block[members] == j[lo])
                if not len(a) or not len(b):
                    continue
                hit = x[a] @ x[b].T >= least
                if a is b:
                    np.fill_diagonal(hit, False)
                p, q = np.nonzero(hit)
                if not len(p):
                    continue
                t = int(nth[lo])
                first = np.ones(len(p), bool)  # a pair counts in the first table where it meets
                for s in range(t):
                    first &= hashes[members[a[p]], s] != hashes[members[b[q]], s]
                p, q = p[first], q[first]
                if not len(p):
                    continue
                counts_a = np.bincount(p, minlength=len(a))
                counts_b = np.zeros(len(b), int) if a is b else np.bincount(q, minlength=len(b))
                ia, ib = ids[members[a]], ids[members[b]]
                low_a, low_b = ia.copy(), ib.copy()
                while True:
                    new_a, new_b = low_a.copy(), low_b.copy()
                    np.minimum.at(new_a, p, low_b[q])
                    np.minimum.at(new_b, q, new_a[p])
                    if np.array_equal(new_a, low_a) and np.array_equal(new_b, low_b):
                        break
                    low_a, low_b = new_a, new_b
                for side, n, node, low in ((a, counts_a, ia, low_a), (b, counts_b, ib, low_b)):
                    pick = (n > 0) | (node != low)
                    out.append((rows[members[side[pick]]], n[pick], node[pick], low[pick]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]).astype(np.int64)) for c in range(4)], names=["row", "n", "u", "v"])

    return run


def dedup(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vectors (vec_id long, embedding array of floats, label) -> vec_id, n_links, component_id, kept; one row per row.

    Links pairs of equal label that meet in a bucket and whose cosine, in doubles, is at least
    `least`. Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label
    or vec_id, link with nothing and are their own component. Repeated rows are vectors of
    their own that share an id. Other columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "embdedup")
    rows = store.save(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector")), "rows")
    kind = rows.schema["vector"].dataType.simpleString()
    hashed = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    hashed = store.save(hashed.mapInArrow(_hash, f"row long, id long, label string, vector {kind}, hashes array<long>"), "hashed")
    placed = hashed.select("row", "label", F.posexplode("hashes").alias("nth", "h")).select("row", "nth", F.xxhash64("label", "nth", "h").alias("bucket"))
    shared = store.save(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # Only buckets of two or more get vectors; a large bucket is dealt out as pairs of blocks.
    placed = placed.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    met = placed.join(hashed, "row").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "nth", "row", "id", "vector", "hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = store.save(met.mapInArrow(_compare(least), "row long, n long, u long, v long"), "found")
    counts = store.save(found.groupBy("row").agg(F.sum("n").alias("n_links")), "counts")
    joined = components(found, store, "links")
    out = rows.select("row", "id").join(counts, "row", "left").join(joined, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
