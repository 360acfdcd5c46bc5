"""Labelled rows for fitting, and the fold that a document is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int) -> tuple[DataFrame, float]:
    """(text, label) of at most per_class rows of either label outside the held-out fold, those of the least hash of
    the id, and the log of the odds by which rows of label 1 are over-represented.

    The chosen ids, of which there are at most 2 * per_class, are what is broadcast.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("id"), mod) != held))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    import math

    rate = [min(per_class, n.get(y, 0)) / max(1, n.get(y, 0)) or 1.0 for y in (0, 1)]
    return texts.select("id", "text", "y"), math.log(rate[1] / rate[0])
