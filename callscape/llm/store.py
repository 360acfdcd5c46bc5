"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a new temporary folder becomes it in local mode, whose only machine shares it; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="callscape-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_lock = threading.Lock()
_writing, _before = 0, "false"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """What a written table cuts off needs no shuffle files any more: they go when a write has ended. The first of several
    writes at once sets this and the last one sets it back."""
    global _writing, _before
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _lock:
        if not _writing:
            _before = spark.conf.get(key, "false")
            spark.conf.set(key, "true")
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.set(key, _before)


_held: ContextVar[list[Store] | None] = ContextVar("held", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that operators save inside go at the end: what is wanted of them must be written before."""
    held: list[Store] = []
    token = _held.set(held)
    try:
        yield
    finally:
        _held.reset(token)
        for store in held:
            store.clear()


class Store:
    """Parquet tables of one operator call. Written tables cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        if (held := _held.get()) is not None:
            held.append(self)

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write
        for key, value in options.items():
            writer = writer.option(key, value)
        with _cleaning(self.spark):
            writer.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no remaining plan reads."""
        for name in names:
            remove(self.spark, f"{self.root}/{name}")
            self.names = [n for n in self.names if n != name]

    def only(self, *names: str) -> None:
        """Remove all tables but these, which the result still reads."""
        self.drop(*(n for n in self.names if n not in names))

    def clear(self) -> None:
        self.names = []
        remove(self.spark, self.root)
