"""Driver-side state: indexes, their tables in memory, and background tasks. None of it holds rows."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def index_id(path: str, language: str) -> str:
    return hashlib.sha256(f"{path}:{language}".encode()).hexdigest()[:12]


def call_id(tool: str, arguments: dict) -> str:
    """The same for calls of equal arguments, in any order."""
    return hashlib.sha256(json.dumps([tool, arguments], sort_keys=True, default=str).encode()).hexdigest()[:16]


class Catalog:
    """Indexes by id, with a manifest that survives a restart: an index that was being built then is an error."""

    def __init__(self, folder: str | None = None):
        self.folder = Path(folder) if folder else None
        self.rows: dict[str, dict] = {}
        self.lock = threading.Lock()
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            for p in sorted(self.folder.glob("*.json")):
                row = json.loads(p.read_text())
                if row["status"] == "indexing":
                    row |= {"status": "error", "error": "ended while indexing"}
                self.rows[row["index_id"]] = row

    def _put(self, row: dict) -> None:
        self.rows[row["index_id"]] = row
        if self.folder:
            part = self.folder / f"{row['index_id']}.part"
            part.write_text(json.dumps(row, sort_keys=True))
            part.replace(self.folder / f"{row['index_id']}.json")

    def register(self, path: str, language: str, build: Callable[[], dict]) -> str:
        """Builds in a thread, unless the index is ready or being built; returns the id at once."""
        key = index_id(path, language)
        with self.lock:
            if self.rows.get(key, {}).get("status") in ("ready", "indexing"):
                return key
            self._put({"index_id": key, "root_path": path, "language": language, "status": "indexing", "started_at": time.time(), "finished_at": None, "error": None})

        def run() -> None:
            try:
                more = {"status": "ready", "summary": build()}
            except Exception as e:  # what a build raises is the index's state
                more = {"status": "error", "error": str(e)}
            with self.lock:
                if key in self.rows:
                    self._put(self.rows[key] | more | {"finished_at": time.time()})

        threading.Thread(target=run, daemon=True).start()
        return key

    def poll(self, key: str) -> dict:
        row = self.rows.get(key)
        if row is None:
            return {"status": "error", "error": f"no index {key}"}
        return row | {"elapsed": round((row["finished_at"] or time.time()) - row["started_at"], 2)}

    def list(self) -> list[dict]:
        return [self.poll(k) for k in sorted(self.rows)]

    def drop(self, key: str) -> bool:
        with self.lock:
            if self.folder:
                (self.folder / f"{key}.json").unlink(missing_ok=True)
            return self.rows.pop(key, None) is not None


class Held:
    """Tables kept in executors' memory, the least recently used dropped beyond a budget."""

    def __init__(self, budget: int = 8):
        self.budget = max(1, budget)
        self.tables: OrderedDict[str, DataFrame] = OrderedDict()
        self.hits = self.misses = self.evicted = 0

    def get(self, key: str, load: Callable[[], DataFrame]) -> DataFrame:
        if key in self.tables:
            self.hits += 1
            self.tables.move_to_end(key)
            return self.tables[key]
        self.misses += 1
        self.tables[key] = load().persist()
        while len(self.tables) > self.budget:
            _, old = self.tables.popitem(last=False)
            old.unpersist()
            self.evicted += 1
        return self.tables[key]

    def drop(self, key: str) -> bool:
        old = self.tables.pop(key, None)
        if old is not None:
            old.unpersist()
        return old is not None

    def clear(self) -> int:
        n = len(self.tables)
        for key in list(self.tables):
            self.drop(key)
        return n

    def stats(self) -> dict:
        return {"held": len(self.tables), "budget": self.budget, "hits": self.hits, "misses": self.misses, "evicted": self.evicted, "keys": list(self.tables)}


class Tasks:
    """Calls in the background. Equal calls under way are one; a call beyond its time has its Spark jobs cancelled."""

    def __init__(self, spark: SparkSession | None = None, at_once: int = 4):
        self.spark, self.pool = spark, ThreadPoolExecutor(at_once)
        self.rows: dict[str, dict] = {}
        self.under_way: dict[str, Future] = {}
        self.shared = 0
        self.lock = threading.Lock()

    def submit(self, kind: str, run: Callable[[], object], index: str | None = None) -> str:
        key = uuid.uuid4().hex[:12]
        row = self.rows[key] = {"task_id": key, "kind": kind, "index_id": index, "status": "pending", "progress_pct": 0, "result": None, "error": None, "started_at": time.time(), "finished_at": None}

        def work() -> None:
            row["status"] = "running"
            if self.spark:
                self.spark.addTag(key)
            try:
                result = run()
                bad = isinstance(result, dict) and result.get("status") == "error"
                row.update(status="error" if bad else "completed", result=result, error=result.get("error") if bad else None, progress_pct=100)
            except Exception as e:  # what a task raises is the task's state
                row.update(status="error", error=str(e))
            finally:
                row["finished_at"] = time.time()
                if self.spark:
                    self.spark.removeTag(key)

        self.pool.submit(work)
        return key

    def poll(self, key: str) -> dict:
        row = self.rows.get(key)
        if row is None:
            return {"status": "error", "error": f"no task {key}"}
        return row | {"elapsed": round((row["finished_at"] or time.time()) - row["started_at"], 2)}

    def list(self, index: str | None = None) -> list[dict]:
        return [self.poll(k) for k, r in self.rows.items() if index in (None, r["index_id"])]

    def cancel(self, key: str) -> None:
        if self.spark:
            self.spark.interruptTag(key)

    def call(self, tool: str, arguments: dict, run: Callable[..., object], timeout: float | None = None) -> object:
        """run(**arguments); an equal call that is under way is waited for instead."""
        key = call_id(tool, arguments)
        with self.lock:
            future = self.under_way.get(key)
            if future is None:
                future = self.under_way[key] = self.pool.submit(run, **arguments)
                future.add_done_callback(lambda _: self.under_way.pop(key, None))
            else:
                self.shared += 1
        try:
            return future.result(timeout)
        except TooLate:
            return {"status": "error", "error": f"{tool} took more than {timeout} s"}


def export(df: DataFrame, most: int | None = 10_000) -> DataFrame:
    """A table's rows as JSON. Refused above `most` rows, for callers that take them as one answer; with None all rows, as a table that no one process holds."""
    from pyspark.sql import functions as F

    if most is not None and (n := df.count()) > most:
        raise ValueError(f"{n} rows, and at most {most} are exported")
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a content hash: read if it was written before, else built and written."""
    path = f"{folder.rstrip('/')}/{key}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
