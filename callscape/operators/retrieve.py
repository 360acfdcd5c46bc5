"""Lexical and vector retrieval over chunks, and their fusion by ranks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscape.operators.saved import Saved

# The usual parameters of BM25, and of rank fusion.
K1, B, FUSION = 1.2, 0.75, 60
#: Weight of the lexical ranks when none is given: for one identifier, and for other queries.
IDENTIFIER, MIXED = 0.8, 0.5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


@dataclass
class Index:
    """Postings (term, key, n) dealt and sorted by term, lengths (key, length), and one row of totals. Built once, read by many queries."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame

    @staticmethod
    def build(chunks: DataFrame, key: str, text: str = "text") -> Index:
        saved = Saved(chunks.sparkSession)
        rows = chunks.select(F.col(key).alias("key"), tokens(F.col(text)).alias("tokens"))
        lengths = saved.save(rows.select("key", F.size("tokens").alias("length")))
        postings = rows.select("key", F.explode("tokens").alias("term")).groupBy("term", "key").agg(F.count("*").alias("n"))
        # Ranges of terms, so that a term's postings lie in few files, which the files' statistics tell.
        postings = saved.save(postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key"))
        totals = lengths.agg(F.count("*").alias("chunks"), F.avg("length").alias("mean"))
        return Index(postings, lengths, saved.save(totals))


def bm25(index: Index, terms: list[str], top: int | None = None) -> DataFrame:
    """(key, score) of the chunks that hold any of the terms, the best first. Only the terms' postings are read."""
    held = index.postings.where(F.col("term").isin(*terms))
    df = held.groupBy("term").agg(F.count("*").alias("df"))  # a row a term
    rows = held.join(F.broadcast(df), "term").join(index.lengths, "key").crossJoin(F.broadcast(index.totals))  # one row
    n, d, f = F.col("chunks"), F.col("df"), F.col("n")
    part = F.log(1 + (n - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = rows.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
    return found if top is None else found.orderBy(F.desc("score"), "key").limit(top)


def _cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)


def by_vector(vectors: DataFrame, seed: DataFrame, top: int | None = None) -> DataFrame:
    """(key, score) of vectors (key, vector) by cosine to the one row of seed (vector), the best first."""
    rows = vectors.where("vector IS NOT NULL").select("key", F.col("vector").cast("array<double>").alias("a"))
    one = seed.select(F.col("vector").cast("array<double>").alias("b")).limit(1)
    found = rows.crossJoin(F.broadcast(one)).where("size(a) = size(b)").select("key", _cosine("a", "b").alias("score")).where("NOT isnan(score)")
    return found if top is None else found.orderBy(F.desc("score"), "key").limit(top)


def weight(query: str, alpha: float | None) -> float:
    """The lexical weight: alpha, else by the query's form."""
    if alpha is not None:
        return min(1.0, max(0.0, alpha))
    return IDENTIFIER if re.fullmatch(r"\s*[A-Za-z_]\w*\s*", query) else MIXED


def fuse(lexical: DataFrame, vector: DataFrame, alpha: float, top: int, depth: int = 1000) -> DataFrame:
    """(key, score): weighted sums of 1 / (FUSION + rank) over the best `depth` of either list."""

    def ranked(found: DataFrame, w: float) -> DataFrame:
        best = found.orderBy(F.desc("score"), "key").limit(depth)  # so few rows are ranked in one task
        return best.select("key", (F.lit(w) / (FUSION + F.row_number().over(W.orderBy(F.desc("score"), "key")))).alias("part"))

    both = ranked(lexical, alpha).unionByName(ranked(vector, 1 - alpha))
    return both.groupBy("key").agg(F.round(F.sum("part"), 9).alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(top)


def chunk_at(chunks: DataFrame, file: str, line: int) -> DataFrame:
    """The key of the chunk (key, file, start_line, end_line) of a file, by the end of its path, that holds the line; else the file's first one."""
    near = chunks.where((F.col("file") == file) | F.col("file").endswith("/" + file))
    inside = F.when(F.lit(line).between(F.col("start_line"), F.col("end_line")), 0).otherwise(1)
    return near.orderBy(inside, F.length("file"), "start_line", "key").limit(1).select("key")


def related(vectors: DataFrame, seed: int, top: int) -> DataFrame:
    """The vectors nearest to the seed's by cosine."""
    rows = vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    found = by_vector(rows.where(F.col("key") != seed), rows.where(F.col("key") == seed), top)
    return found.select(F.col("key").alias("vec_id"), "score")
