"""Bounds and envelopes of paged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The largest depth and page.
MAX_DEPTH, MAX_LIMIT = 20, 5000


def clamp(depth: int, limit: int, offset: int, hub_threshold: int) -> tuple[int, int, int, int]:
    return max(0, min(depth, MAX_DEPTH)), max(1, min(limit, MAX_LIMIT)), max(0, offset), max(1, hub_threshold)


def envelope(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, how many the page returns, and whether it leaves any out before or behind it."""
    total = F.count("*")
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), total - offset))
    return rows.agg(total.alias("total"), returned.cast("long").alias("returned"), ((total > offset + limit) | F.lit(offset > 0)).alias("truncated"))


def page(rows: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    """The page of rows in order, each with total, truncated and a hint at what the page leaves out."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
    end = F.least(F.col("total"), F.lit(offset + limit))
    more = F.col("total") > offset + limit
    onward = F.concat(F.lit(f"rows {offset} to "), end.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("; the next page begins at "), end.cast("string"))
    back = F.concat(F.lit(f"begins at {offset}, of "), F.col("total").cast("string"), F.lit(" rows"))
    return cut.withColumn("truncated", more | F.lit(offset > 0)).withColumn("hint", F.when(more, onward).when(F.lit(offset > 0), back).otherwise(""))


def without_hubs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Results that are no hubs (id). The walk itself still went through them; to stop there, give the hubs as `avoid`."""
    return rows.join(hubs.select("id"), "id", "left_anti")
