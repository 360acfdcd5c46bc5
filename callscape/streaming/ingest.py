"""Incremental ingest: files that arrive in a folder, the latest content of each path in a table of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KIND = "path string, content string, modified timestamp"


def latest(rows: DataFrame) -> DataFrame:
    """(path, content, modified, hash): of each path the newest content; of equally new ones the greater."""
    best = rows.groupBy("path").agg(F.max(F.struct("modified", "content")).alias("b"))
    return best.select("path", "b.content", "b.modified", F.sha2("b.content", 256).alias("hash"))


def follow(spark: SparkSession, arriving: str, table: str, checkpoint: str) -> StreamingQuery:
    """Takes Parquet files (path, content, modified) as they arrive; a batch adds to `table` only what is new or has other content.

    A batch that runs again after a failure finds its own rows and adds none twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = latest(batch)
        place = spark._jvm.org.apache.hadoop.fs.Path(table)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            new = new.join(current(spark, table).select("path", "hash"), ["path", "hash"], "left_anti").select("path", "content", "modified", "hash")
        new.write.mode("append").parquet(table)

    rows = spark.readStream.schema(KIND).parquet(arriving)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each path."""
    return latest(spark.read.schema(KIND + ", hash string").parquet(table))
