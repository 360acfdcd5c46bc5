"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hash, n_docs, max_doc), one row per line hash, sorted by
the hash. Each batch of documents is merge-anti-joined with the runs: keys not met before form a
new run at level 0; keys met before add their counts to increments. When a level holds FANOUT
runs they are compacted into one run of the next level. In the end the runs say which keys
enough documents hold, and which document keeps each.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.llm.store import Store

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """The trimmed line with A-Z lower-cased; lower() does that for ASCII, and is far faster than translate()."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _hash(key: Column) -> Column:
    """128 bits of two independent hashes: equal for different keys about once in 10^19 corpora of 10^9 lines."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(7), key, F.lit(11)).alias("g"))


class Runs:
    """Levelled sorted runs of keys, and increments of keys already in them.

    Runs hold disjoint keys: a batch is merge-anti-joined with them and only its new keys (met = 0) become
    a run; what it adds to known keys (met = 1) lies beside it. Runs are tables in the shared folder, dealt by hash and
    sorted within each file. A merge join moves only the hashes of the runs, 16 bytes a key.
    """

    def __init__(self, store: Store):
        self.store = store
        self.levels: list[list[str]] = [[]]
        self.tables: dict[str, DataFrame] = {}
        self.batches: list[str] = []

    def _save(self, df: DataFrame) -> str:
        name = f"run-{len(self.tables)}"
        self.tables[name] = self.store.save(df, name)
        return name

    def _keys(self) -> DataFrame | None:
        """The rows of all runs."""
        runs = [t for level in self.levels for t in level]
        return reduce(DataFrame.unionByName, (self.tables[t].where("met = 0") for t in runs)) if runs else None

    def add(self, batch: DataFrame) -> None:
        """batch: one row (h, g, n_docs, max_doc) per key."""
        keys = self._keys()
        if keys is None:
            batch = batch.withColumn("met", F.lit(0)).repartition("h", "g").sortWithinPartitions("h", "g")
        else:
            hit = keys.select("h", "g", F.lit(1).alias("hit")).hint("merge")
            batch = batch.join(hit, ["h", "g"], "left").withColumn("met", F.coalesce("hit", F.lit(0))).drop("hit")
        name = self._save(batch)
        self.batches.append(name)
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= FANOUT:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[level] = self.levels[level], []
            rows = reduce(DataFrame.unionByName, (self.tables[t].where("met = 0") for t in old))
            self.levels[level + 1].append(self._save(rows.repartition("h", "g").sortWithinPartitions("h", "g")))
            self.store.drop(*(t for t in old if t not in self.batches))
            level += 1

    def totals(self, min_docs: int) -> DataFrame:
        """(h, g, n_docs, max_doc) of the keys held by at least min_docs documents: runs, and all increments."""
        parts = reduce(DataFrame.unionByName, (self.tables[t].where("met = 1") for t in self.batches), self._keys())
        return parts.groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")).where(F.col("n_docs") >= min_docs)


def _without(lines: pd.Series, drops: pd.Series) -> pd.Series:
    """Texts without the lines at the places given; linear in the text."""

    def one(text, gone):
        if text is None or gone is None:
            return None
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([one(t, d) for t, d in zip(lines, drops)], dtype=object)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """All rows and columns of docs as the struct `row`, with new_text, n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. A key of at
    least min_chars code points that at least min_docs documents hold loses all its lines but those in the
    document of the largest doc_id among them. Null and empty texts are one empty line and
    stay as they are. Rows that share a doc_id count as one document and fare alike; those without
    a doc_id don't count. A null doc_id is the smallest. Clashing names of other columns do no harm.
    """
    spark = docs.sparkSession
    store = Store(spark, "linededup")
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(SPACES)))
    keys = F.transform(
        F.filter(F.transform(trimmed, lambda x, i: F.struct(x.alias("x"), i.alias("pos"))), lambda s: F.char_length(s["x"]) >= min_chars),
        lambda s: F.struct(s["pos"].alias("pos"), _hash(_key(s["x"])).alias("k")),
    )
    # (document, text) identifies a row for the final join; rows alike in both fare alike.
    ident = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    placed = docs.select(*ident, keys.alias("keys")).where(F.size("keys") > 0)
    placed = store.save(placed, "keys")
    # Rows of one doc_id are in one batch, so that the batches' distinct counts add up.
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    held = placed.select("doc_id", batch, F.explode(F.array_distinct(F.transform("keys", lambda s: s["k"]))).alias("k"))
    held = held.groupBy("batch", F.col("k.h").alias("h"), F.col("k.g").alias("g")).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
    staged = store.save(held, "staged")
    runs = Runs(store)
    for b in range(batches):
        runs.add(staged.where(F.col("batch") == b).drop("batch"))
    hot = store.save(runs.totals(min_docs), "hot")
    store.only("keys", "hot")
    found = placed.select("doc_id", "text_hash", F.explode("keys").alias("s")).select("doc_id", "text_hash", F.col("s.pos").alias("pos"), F.col("s.k.h").alias("h"), F.col("s.k.g").alias("g"))
    drops = (
        found.join(hot.select("h", "g", "max_doc"), ["h", "g"])
        .where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops"))
        .select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drops")
    )
    drops = store.save(drops, "drops")
    store.only("drops")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *ident)
    both = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash")), "left")
    text = F.col("row.text")
    cut = F.pandas_udf(_without, "string")(F.when(F.col("drops").isNotNull(), text), F.col("drops"))
    return both.select(
        "row",
        F.when(F.col("drops").isNull(), text).otherwise(cut).alias("new_text"),
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of what stays."""
    kept = F.sha2(F.coalesce(F.col("new_text"), F.lit("")).cast("binary"), 256)
    return dedup(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", kept.alias("kept_sha256"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines dropped; n_chars follows the text where it changed."""
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_dropped") > 0, F.char_length("new_text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return dedup(docs).select(*columns)
