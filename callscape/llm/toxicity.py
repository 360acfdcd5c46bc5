"""Toxicity by a factorization machine over hashed terms.

Terms are words (A-Z and Latin-1 capitals as small letters) and their beginnings of 4, 5 and 6 bytes, hashed. The score
is bias + sum of weights + sum over pairs of <v_i, v_j>, so that two terms together may say what neither says alone.
Fitted are the terms that say most alone, and those of the pairs that say most together however little each says alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscape.llm.labelled import remainder, sample
from callscape.llm.shingles import BYTE, U, mix, powers, slices

BITS, FACTORS, FEATURES = 22, 8, 2048
#: Of so many terms, those that the most rows hold, all pairs are looked at; the terms of the PAIRS best ones are kept besides, if they say more than PAIR_Z.
PAIRED, PAIRS, PAIR_Z = 4096, 256, 6.0
#: Bytes of texts, or of a longer text up to the end of a word, whose terms are found at once.
PIECE = 1 << 18
STEMS = (4, 5, 6)
#: Rows of either label that the model is fitted on at most.
PER_CLASS = 3000
#: Rows of the sample that must hold a term for it to count.
LEAST_ROWS = 4
FOLD, HELD, CUT = 4, 2, 0.3

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(capital, data + 0x20, data).astype(np.uint8)
    inside = LETTER[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edge] = inside[edge]
    at = np.flatnonzero(starts)
    if not len(at):
        return none, none
    where = np.flatnonzero(inside)
    within = where - at[np.cumsum(starts)[where] - 1]
    values = BYTE[data[where]] * powers(int(within.max()) + 1)[within]
    first = np.searchsorted(where, at)
    length = np.diff(np.append(first, len(where)))
    text = np.searchsorted(offsets, at, side="right") - 1
    out, owner = [mix(np.add.reduceat(values, first)) >> U(64 - BITS)], [text]
    for n in STEMS:
        long = length > n
        if long.any():
            stem = values[first[long]].copy()
            for i in range(1, n):
                stem += values[first[long] + i]
            out.append(mix(stem + U(n * 0x9E37)) >> U(64 - BITS))
            owner.append(text[long])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed term, text) for all words and beginnings, distinct within a piece: a long text is taken piece by piece, each ending with a word."""
    if len(data) <= PIECE:
        return _terms(data, offsets)
    found, begin = [], 0
    while begin < len(data):
        end = min(begin + PIECE, len(data))
        while end < len(data) and LETTER[data[end]] and LETTER[data[end - 1]]:
            rest = np.flatnonzero(~LETTER[data[end : end + PIECE]])
            end = end + int(rest[0]) if len(rest) else min(end + PIECE, len(data))
        inner = offsets[(offsets > begin) & (offsets < end)] - begin
        term, text = _terms(data[begin:end], np.concatenate([[0], inner, [end - begin]]))
        pair = np.unique(text << BITS | term)
        first = np.searchsorted(offsets, begin, side="right") - 1  # the text that the piece begins in
        skipped = np.searchsorted(offsets, begin + np.concatenate([[0], inner]), side="right") - 1
        found.append((pair & ((1 << BITS) - 1), skipped[pair >> BITS] if len(pair) else pair + first))
        begin = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Machine:
    """A fitted factorization machine; `index` holds the hashed terms it knows, in order."""

    def __init__(self, index: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.index, self.bias, self.weight, self.factor = index, bias, weight, factor
        self._table = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities for the texts between offsets; a text without known terms gets that of the bias."""
        if self._table is None:
            self._table = np.full(1 << BITS, -1, np.int32)
            self._table[self.index] = np.arange(len(self.index), dtype=np.int32)
        n = len(offsets) - 1
        term, text = terms(data, offsets)
        known = self._table[term]
        keep = known >= 0
        pair = np.unique(text[keep] * len(self.index) + known[keep]) if len(self.index) else np.zeros(0, np.int64)
        text, known = pair // max(1, len(self.index)), pair % max(1, len(self.index))
        out = np.full(n, self.bias)
        out += np.bincount(text, self.weight[known], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[known, f]
            out += 0.5 * (np.bincount(text, v, minlength=n) ** 2 - np.bincount(text, v**2, minlength=n))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    def __getstate__(self):
        return (self.index, self.bias, self.weight, self.factor)

    def __setstate__(self, state):
        self.__init__(*state)


#: Columns of the matrix of common terms that are looked at together.
COLUMNS = 512


def _together(column: np.ndarray, owner: np.ndarray, held: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The terms of pairs whose rows are toxic far more often than each one's rows are. Holds a byte for each row and common term."""
    common = np.argsort(-held, kind="stable")[:PAIRED]
    table = np.full(len(held), -1, np.int32)
    table[common] = np.arange(len(common), dtype=np.int32)
    at = table[column]
    x = np.zeros((len(y), len(common)), np.uint8)
    x[owner[at >= 0], at[at >= 0]] = 1
    rate = np.clip(toxic[common].astype(np.float32) / held[common].astype(np.float32), 1e-3, 0.999)
    y32 = y.astype(np.float32)[:, None]
    best = np.zeros((3, 0))
    for a in range(0, len(common), COLUMNS):
        left = x[:, a : a + COLUMNS].astype(np.float32)
        bad_left = left * y32
        for b in range(a, len(common), COLUMNS):
            right = x[:, b : b + COLUMNS].astype(np.float32)
            both, bad = left.T @ right, bad_left.T @ right
            expected = np.maximum(rate[a : a + COLUMNS, None], rate[None, b : b + COLUMNS])
            z = (bad - both * expected) / np.sqrt(np.maximum(both, 1) * expected * (1 - expected))
            z[both < LEAST_ROWS] = 0
            z[np.tri(*z.shape, a - b, dtype=bool)] = 0  # each pair once
            i, j = np.nonzero(z > PAIR_Z)
            best = np.concatenate([best, np.stack([z[i, j], i + a, j + b])], 1)
            best = best[:, np.lexsort((best[2], best[1], -best[0]))[:PAIRS]]
    return common[np.unique(best[1:].astype(np.int64))]


def fit(rows: list[np.ndarray], y: np.ndarray, shift: float = 0.0, rounds: int = 250) -> Machine:
    """rows: distinct hashed terms of each text. shift: log odds of the sample over those of the corpus."""
    n = len(rows)
    if not n or y.min() == y.max():
        prior = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return Machine(np.zeros(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate(rows)
    held = np.bincount(flat, minlength=1 << BITS)
    known = np.flatnonzero(held >= LEAST_ROWS)
    held = held[known]
    table = np.full(1 << BITS, -1, np.int32)
    table[known] = np.arange(len(known), dtype=np.int32)
    column = table[flat]
    del table, flat
    column, owner = column[column >= 0], owner[column >= 0]
    toxic = np.bincount(column, y[owner], minlength=len(known))
    rate = y.mean()
    z = (toxic - held * rate) / np.sqrt(held * rate * (1 - rate))
    alone = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    alone = alone[np.abs(z[alone]) > 0]
    chosen = np.union1d(alone, _together(column, owner, held, toxic, y))
    index = known[chosen]
    place = np.full(len(known), -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    column = place[column]
    x = np.zeros((n, len(index)), np.float32)
    x[owner[column >= 0], column[column >= 0]] = 1
    del column, owner
    rng = np.random.default_rng(5)
    w = np.zeros(len(index), np.float32)
    v = rng.normal(0, 0.01, (len(index), FACTORS)).astype(np.float32)
    b = np.float32(np.log(rate / (1 - rate)))
    state = [np.zeros_like(p) for p in (w, v)] + [np.zeros_like(p) for p in (w, v)]
    y32 = y.astype(np.float32)
    for t in range(1, rounds + 1):
        xv = x @ v
        s = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = (p - y32) / n
        gw = x.T @ g + 2e-4 * w
        gv = x.T @ (g[:, None] * xv) - (x.T @ g)[:, None] * v + 1e-3 * v
        b -= np.float32(0.5 * g.sum())
        for i, (param, grad, step) in enumerate(((w, gw, 0.05), (v, gv, 0.01))):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 2] = 0.999 * state[i + 2] + 0.001 * grad**2
            param -= (step * state[i] / (1 - 0.9**t) / (np.sqrt(state[i + 2] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Machine(index, float(b) - shift, w.astype(np.float64), v.astype(np.float64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in slices(batch.column("text"), PIECE):
            term, text = terms(data, offsets)
            key = np.unique(text << BITS | term)
            begin = np.searchsorted(key >> BITS, np.arange(last - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), batch.column("y").slice(first, last - first), lists], names=["id", "y", "terms"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fitted on a bounded sample (see PER_CLASS) of labelled rows outside the held-out fold."""
    chosen, shift = sample(docs, labels, "toxic", FOLD, HELD, PER_CLASS)
    got = chosen.select("id", "text", F.col("y").cast("int").alias("y")).mapInArrow(_rows, "id long, y int, terms array<int>").toArrow().sort_by("id")
    lists = got.column("terms").combine_chunks()
    rows = [lists[i].values.to_numpy() for i in range(len(lists))]
    return fit(rows, got.column("y").to_numpy().astype(np.float64), shift)


def _score(machine: Machine, nth: int | None = None):
    """A column with the scores of the texts in the last column (field nth of it, if given) beside the others (all of them, if so)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last_column = batch.column(batch.num_columns - 1)
            texts, beside = (last_column, batch.num_columns - 1) if nth is None else (last_column.field(nth), batch.num_columns)
            for first, last, data, offsets in slices(texts, PIECE):
                kept = [batch.column(i).slice(first, last - first) for i in range(beside)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(machine.score(data, offsets))], names=[*batch.schema.names[:beside], "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; null texts are empty texts, which have the score of the bias.

    A long text is taken piece by piece. Repeated rows each get a row, an empty table none; a null doc_id is not held out.
    Other columns are not read. Without labelled rows of both kinds all scores are the prior.
    """
    machine = train(docs, labels)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = source.mapInArrow(_score(machine), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not find toxic, with all columns, in one pass without a shuffle.

    Null texts are empty ones; repeated rows fare alike; an empty table stays empty. Without labelled rows of both kinds
    there is no model, and all documents stay.
    """
    machine = train(docs, labels)
    if not len(machine.index):
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kind = rows.schema["row"].dataType
    scored = rows.mapInArrow(_score(machine, docs.columns.index("text")), T.StructType([T.StructField("row", kind), T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") < CUT).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
