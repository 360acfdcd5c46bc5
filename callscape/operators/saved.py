"""Tables that traversals write between levels, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a new temporary folder becomes it in local mode; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="callscape-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        found = "file://" + place
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Saved:
    """A folder of tables. A written table has no lineage and outlives executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[str] = []

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, like: DataFrame) -> DataFrame:
        """Everything saved here so far, which must be of one schema, as one scan."""
        return self.spark.read.schema(like.schema).parquet(*(f"{self.root}/{n}" for n in range(1, self.n + 1)))

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """df bucketed and sorted by key, a bucket for each shuffle partition: a join on the key moves only the other side."""
        self.n += 1
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"`{self.spark.catalog.currentDatabase()}`.callscape_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key)
        dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{self.root}/{self.n}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def close(self) -> None:
        """Take the bucketed tables from the catalog; plans that hold their files go on."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []
