"""Nearest neighbours by score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

The smallest distance |q - x| is the largest q.x - |x|^2 / 2. The product q.x is estimated from
four-bit codes of pairs of dimensions, whose codebooks and codes weigh the residual's part along
the vector more than that across it, as that part is what disturbs high scores; |x|^2 / 2 is kept as it is. The
exact distances of the best RERANK of a block of rows by the estimate bound that of the last neighbour. With
y for a row's coded vector and r for the norm |x - y|, which is kept too, a row within the distance D of q has
|q - y| <= D + r and q.x <= q.y + |q| r. All rows that meet both are ranked by their exact distance,
however many, so that the result is that of a full search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscape.llm.store import Store
from callscape.llm.vectors import matrices, usable

#: Codebooks are fitted on so many vectors at most (those of the least hash); every vector is indexed.
SAMPLE = 8192
WIDTH, CODES = 2, 16
#: Scores above this cosine matter; sets the weight of parallel residuals.
THRESHOLD = 0.2
RERANK, TOP = 300, 10
QUERY_BLOCK, DATA_BLOCK = 2048, 16384
#: Blocks of longer vectors than this hold fewer rows.
DATA_WIDTH = 256


class Quantiser:
    """Anisotropic product quantiser of vectors with d dimensions."""

    def __init__(self, d: int):
        self.d, self.parts = d, -(-d // WIDTH)
        self.parts += self.parts % 2  # two codes a byte
        self.weight = max(0.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)
        self.books = np.zeros((self.parts, CODES, WIDTH))

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * WIDTH))
        wide[:, : self.d] = x
        return wide.reshape(len(x), self.parts, WIDTH)

    def _assign(self, x: np.ndarray, codes: np.ndarray, update: bool) -> None:
        """One round of coordinate descent over the parts, on the loss |r|^2 + weight (r.x)^2 / |x|^2."""
        norm = np.maximum((x**2).sum((1, 2)), 1e-300)
        part = np.arange(self.parts)
        residual = x - self.books[part, codes]
        dot = np.einsum("npw,npw->n", residual, x)
        for p in range(self.parts):
            xs = x[:, p]
            rest = dot - np.einsum("nw,nw->n", residual[:, p], xs)
            if update:
                for c in range(CODES):
                    own = codes[:, p] == c
                    if own.any():
                        y = xs[own]
                        scale = self.weight / norm[own]
                        a = np.eye(WIDTH) * own.sum() + np.einsum("n,nv,nw->vw", scale, y, y)
                        b = y.sum(0) + (scale * (rest[own] + (y**2).sum(1))) @ y
                        self.books[p, c] = np.linalg.solve(a, b)
            r = xs[:, None] - self.books[p][None]
            loss = (r**2).sum(2) + self.weight * (rest[:, None] + np.einsum("ncw,nw->nc", r, xs)) ** 2 / norm[:, None]
            codes[:, p] = loss.argmin(1)
            residual[:, p] = xs - self.books[p][codes[:, p]]
            dot = rest + np.einsum("nw,nw->n", residual[:, p], xs)

    def _plain(self, x: np.ndarray) -> np.ndarray:
        distance = ((x[:, :, None] - self.books[None]) ** 2).sum(3)
        return distance.argmin(2)

    def fit(self, sample: np.ndarray, rounds: int = 8) -> Quantiser:
        x = self._split(sample)
        rng = np.random.default_rng(11)
        start = rng.choice(len(x), CODES, replace=len(x) < CODES)
        self.books = x[start].transpose(1, 0, 2).copy()
        for _ in range(rounds):  # plain means first
            codes = self._plain(x)
            for p in range(self.parts):
                for c in range(CODES):
                    own = codes[:, p] == c
                    if own.any():
                        self.books[p, c] = x[own, p].mean(0)
        codes = self._plain(x)
        for _ in range(rounds):
            self._assign(x, codes, update=True)
        return self

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Packed four-bit codes (rows, parts / 2) of vectors in rows."""
        out = np.zeros((len(vectors), self.parts // 2), np.uint8)
        for i in range(0, len(vectors), 4096):
            x = self._split(vectors[i : i + 4096])
            codes = self._plain(x)
            self._assign(x, codes, update=False)
            self._assign(x, codes, update=False)
            out[i : i + 4096] = codes[:, ::2] | (codes[:, 1::2] << 4)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that packed codes stand for."""
        each = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)
        return self.books[np.arange(self.parts), each].reshape(len(codes), -1)[:, : self.d]

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimates of queries.vectors from tables of partial products."""
        table = np.einsum("qpw,pcw->pqc", self._split(queries), self.books).astype(np.float32)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for b in range(self.parts // 2):
            pair = (table[2 * b][:, None, :] + table[2 * b + 1][:, :, None]).reshape(len(queries), CODES * CODES)
            out += pair[:, codes[:, b]]
        return out


def _encode(quantisers: dict[int, Quantiser]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [None] * batch.num_rows
            residual = np.zeros(batch.num_rows)
            d = np.zeros(batch.num_rows, np.int64)
            for rows, x in matrices(batch.column("vector")):
                packed = quantisers[x.shape[1]].encode(x)
                for r, c in zip(rows, packed):
                    codes[r] = c.tobytes()
                residual[rows] = np.sqrt(((x - quantisers[x.shape[1]].decode(packed)) ** 2).sum(1))
                d[rows] = x.shape[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "vector")), pa.array(d), pa.array(codes, pa.binary()), pa.array(residual)], names=["row", "id", "vector", "d", "codes", "residual"])

    return run


def _distances(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of a vector from those in the columns, summed in the order of the dimensions: equal vectors have equal ones."""
    total = np.zeros(columns.shape[1])
    for a, b in zip(q, columns):
        total += (a - b) ** 2
    return np.sqrt(total)


#: Relative error that sums in doubles stay below; codes are scanned in floats, whose error is counted apart.
ROUNDING = 1e-9


def _scan(quantisers: dict[int, Quantiser], rerank: int, top: int):
    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if left.num_rows and right.num_rows:
            quantiser = quantisers[left.column("qd")[0].as_py()]
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            residual, rows, ids, queries = (t.column(c).to_numpy() for t, c in ((right, "residual"), (right, "candidate"), (right, "id"), (left, "q")))
            (_, asked), = matrices(left.column("vector"))
            (_, x), = matrices(right.column("candidate_vector"))
            norm, coded = (x**2).sum(1), (quantiser.decode(codes) ** 2).sum(1)
            float_error = quantiser.parts * 2.0**-22 * np.sqrt(coded)
            for i in range(0, len(asked), 64):
                q, own = asked[i : i + 64], queries[i : i + 64, None] == rows[None]  # the query's own row
                length = (q**2).sum(1)[:, None]
                product = quantiser.scan(q, codes).astype(np.float64)
                product[~np.isfinite(product)] = np.nan  # beyond floats: no bound holds, so the row is kept
                estimate = np.nan_to_num(product - norm / 2, nan=np.inf)
                estimate[own] = -np.inf
                n = min(rerank, estimate.shape[1])
                best = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
                last = np.full((len(q), 1), np.inf)  # distance of the last neighbour at most
                for j in range(len(q)):
                    found = best[j][~own[j, best[j]]]
                    if len(found) >= top:
                        last[j] = np.partition(np.sqrt(((x[found] - q[j]) ** 2).sum(1)), top - 1)[top - 1]
                error = np.sqrt(length) * float_error + quantiser.parts * 2.0**-148  # and what is too small for floats
                slack = error + ROUNDING * (length + norm + coded)
                far = length + coded - 2 * product - 2 * slack > (last + residual) ** 2
                far |= product + np.sqrt(length) * residual + slack < (length + norm - last**2) / 2
                near = ~far & ~own
                some = np.flatnonzero(near.any(0))
                exact = length + norm[some] - 2 * (q @ x[some].T)
                near = near[:, some] & ~(exact - ROUNDING * (length + norm[some]) > last**2)
                for j in range(len(q)):
                    at = some[near[j]]
                    # Far more than `top` may remain where the block's rows are near each other: those that the product puts clearly behind go.
                    if len(at) > top:
                        e, wide = exact[j, near[j]], ROUNDING * (length[j] + norm[at])
                        at = at[~(e - wide > np.partition(e + wide, top - 1)[top - 1])]
                    distance = _distances(q[j], x[at].T)
                    order = np.lexsort((ids[at], distance))[:top]
                    out_q.append(np.full(len(order), queries[i + j]))
                    out_id.append(ids[at][order])
                    out_s.append(distance[order])
        if not out_q:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table({"q": np.concatenate(out_q), "id": np.concatenate(out_id), "score": np.concatenate(out_s)})

    return scan


def search(vectors: DataFrame, every: int = 100, top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: the `top` nearest rows to each row whose vec_id is divisible by `every`.

    Candidates are all other rows with a vector of the same length, by Euclidean distance in
    doubles, ties to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null vec_id, take no part. A repeated row is a candidate of its own, and so a
    query's nearest. Fewer candidates than `top` are all returned. `rerank` sets only how many rows of a block
    bound the distance of the last neighbour first, not how many are ranked.
    """
    spark = vectors.sparkSession
    store = Store(spark, "ann")
    ok = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rows = store.save(ok.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "rows")
    quantisers = {}
    for (d,) in rows.groupBy(F.size("vector")).count().select(F.col("size(vector)")).collect():  # a quantiser for each length of vector
        sample = rows.where(F.size("vector") == d).orderBy(F.xxhash64("row")).limit(SAMPLE).select("vector").toArrow().column("vector")
        ((_, x),) = matrices(sample)
        quantisers[d] = Quantiser(d).fit(x)
    kind = rows.schema["vector"].dataType.simpleString()
    coded = store.save(rows.mapInArrow(_encode(quantisers), f"row long, id long, vector {kind}, d long, codes binary, residual double"), "coded")
    is_query = F.col("id") % every == 0
    sizes = coded.groupBy("d").agg(F.ceil(F.count("*") * F.greatest(F.lit(1), F.col("d") / F.lit(DATA_WIDTH)) / F.lit(DATA_BLOCK)).alias("nd"), F.greatest(F.lit(1).cast("long"), F.ceil(F.count_if(is_query) / F.lit(QUERY_BLOCK))).alias("nq"))
    sizes = F.broadcast(sizes)  # one row per vector length
    sized = coded.join(sizes, "d")
    zero = F.lit(0).cast("long")
    queries = sized.where(is_query).select(F.col("d").alias("qd"), F.pmod(F.xxhash64("row"), F.col("nq")).alias("qqb"), F.explode(F.sequence(zero, F.col("nd") - 1)).alias("qdb"), F.col("row").alias("q"), "vector")
    data = sized.select(F.col("d").alias("dd"), F.explode(F.sequence(zero, F.col("nq") - 1)).alias("dqb"), F.pmod(F.xxhash64("row", F.lit(3)), F.col("nd")).alias("ddb"), F.col("row").alias("candidate"), "id", F.col("vector").alias("candidate_vector"), "codes", "residual")
    scanned = queries.groupBy("qd", "qqb", "qdb").cogroup(data.groupBy("dd", "dqb", "ddb")).applyInArrow(_scan(quantisers, rerank, top), "q long, id long, score double")
    nth = F.row_number().over(W.partitionBy("q").orderBy("score", "id"))
    best = scanned.withColumn("rank", nth).where(F.col("rank") <= top)
    asked = coded.where(is_query).select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    return best.join(asked, "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
