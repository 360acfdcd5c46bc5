"""Quality by a byte-level convolutional network in numpy.

Learned filters WIDTH bytes wide, every STRIDE bytes, respond along the whole text. Their responses are averaged over
overlapping chunks of CHUNK bytes that cover the text; a hidden layer sees each chunk's averages and their squares; its
units are max-pooled over the chunks and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.labelled import remainder, sample
from callscape.llm.shingles import slices

WIDTH, STRIDE, FILTERS = 4, 2, 16
#: Bytes of a chunk; chunks overlap by half.
CHUNK, HIDDEN = 256, 16
#: Half chunks that are scored at once.
SPAN = 2048
#: Rows of either label that the network is fitted on at most, and texts of a step.
PER_CLASS, BATCH, EPOCHS = 1500, 64, 6
FOLD, HELD, CUT = 3, 1, 0.5




def _halves(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first byte) of the half chunks that cover each text; an empty text has one, of padding."""
    n = np.maximum(1, -(-np.diff(offsets) // (CHUNK // 2)))
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, offsets[:-1][text] + nth * (CHUNK // 2)


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias1 = np.zeros(FILTERS, np.float32)
        self.hidden = rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.bias2 = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.bias3 = np.float32(0)
        self.mean, self.scale = np.zeros(2 * FILTERS, np.float32), np.ones(2 * FILTERS, np.float32)
        self.shift = 0.0

    PARAMS = ("filters", "bias1", "hidden", "bias2", "out", "bias3")

    def _responses(self, windows: np.ndarray) -> np.ndarray:
        """(rows, FILTERS) of windows (rows, WIDTH) of bytes, rectified."""
        r = self.filters[0][windows[:, 0]]
        for k in range(1, WIDTH):
            r += self.filters[k][windows[:, k]]
        r += self.bias1
        return np.maximum(r, 0, out=r)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray):
        """Averages of responses over chunks: (text of a chunk, averages, windows and chunk of each half)."""
        text, first = _halves(offsets)
        ends = offsets[1:][text]
        at = first[:, None] + np.arange(0, CHUNK // 2, STRIDE)[None]
        live = at < ends[:, None]  # a window begins inside the text; what lies beyond is zero bytes
        flat, row = at[live], np.repeat(np.arange(len(text)), live.sum(1))
        if not len(flat):
            windows = np.zeros((0, WIDTH), np.uint8)
        else:
            place = flat[:, None] + np.arange(WIDTH)[None]
            windows = np.where(place < ends[row][:, None], data[np.minimum(place, len(data) - 1)], 0)
        r = self._responses(windows)
        n = live.sum(1)
        sums = np.zeros((len(text), FILTERS), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(r, (np.cumsum(n) - n)[full], axis=0)
        # A chunk is a half and the next one of the same text, where there is one.
        pair, count = sums.copy(), n.copy()
        joined = np.flatnonzero(text[1:] == text[:-1])
        pair[joined] += sums[joined + 1]
        count[joined] += n[joined + 1]
        lone = np.ones(len(text), bool)
        lone[1:] = text[1:] != text[:-1]
        keep = np.zeros(len(text), bool)
        keep[joined] = True
        keep |= lone  # the last half is inside the chunk before it, unless it is the only one
        return text, keep, pair / np.maximum(count, 1)[:, None], count, windows, row

    def _averages(self, data: np.ndarray, offsets: np.ndarray):
        """As _chunks, SPAN halves at a time: (text, which halves stand for a chunk, averages). Little more than a text's size is held."""
        text, first = _halves(offsets)
        ends = offsets[1:][text]
        sums, count = np.zeros((len(text), FILTERS), np.float32), np.zeros(len(text), np.int64)
        steps = np.arange(0, CHUNK // 2, STRIDE)[None]
        for a in range(0, len(text) if len(data) else 0, SPAN):
            at, end = first[a : a + SPAN, None] + steps, ends[a : a + SPAN, None]
            live = at < end
            n = live.sum(1)
            flat, stop = at[live][:, None] + np.arange(WIDTH)[None], np.repeat(end[:, 0], n)[:, None]
            r = self._responses(np.where(flat < stop, data[np.minimum(flat, len(data) - 1)], 0))
            full = np.flatnonzero(n)
            if len(full):
                sums[a + full] = np.add.reduceat(r, (np.cumsum(n) - n)[full], axis=0)
            count[a : a + SPAN] = n
        follows = np.flatnonzero(text[1:] == text[:-1])
        keep = np.ones(len(text), bool)
        keep[1:] = text[1:] != text[:-1]
        keep[follows] = True
        after, n_after = sums[follows + 1], count[follows + 1]
        sums[follows] += after
        count[follows] += n_after
        return text, keep, sums / np.maximum(count, 1)[:, None]

    def _pool(self, text: np.ndarray, keep: np.ndarray, average: np.ndarray, n_texts: int):
        chunk = np.flatnonzero(keep)
        a = average[chunk]
        x = (np.concatenate([a, a * a], 1) - self.mean) / self.scale
        h = np.maximum(x @ self.hidden + self.bias2, 0)
        starts = np.searchsorted(text[chunk], np.arange(n_texts))
        return chunk, x, h, np.maximum.reduceat(h, starts, axis=0), starts

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the texts between offsets."""
        n = len(offsets) - 1
        text, keep, average = self._averages(data, offsets)
        *_, top, _ = self._pool(text, keep, average, n)
        s = (top @ self.out).astype(np.float64) + float(self.bias3) - self.shift
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray):
        n = len(offsets) - 1
        text, keep, average, count, windows, row = self._chunks(data, offsets)
        chunk, x, h, top, starts = self._pool(text, keep, average, n)
        s = top @ self.out + self.bias3
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = ((p - y) / n).astype(np.float32)
        d_out, d_bias3 = top.T @ g, g.sum()
        # The gradient of a maximum goes to the first chunk that attains it.
        d_h = np.zeros_like(h)
        ends = np.append(starts[1:], len(chunk))
        for i in range(n):
            best = h[starts[i] : ends[i]].argmax(0) + starts[i]
            d_h[best, np.arange(HIDDEN)] += g[i] * self.out
        d_h[h <= 0] = 0
        live = np.flatnonzero(d_h.any(1))
        d_hidden, d_bias2 = x[live].T @ d_h[live], d_h[live].sum(0)
        d_x = (d_h[live] @ self.hidden.T) / self.scale
        a = average[chunk[live]]
        d_a = (d_x[:, :FILTERS] + 2 * a * d_x[:, FILTERS:]) / np.maximum(count[chunk[live]], 1)[:, None]
        # Back to the halves, then to the windows of those that matter.
        d_half = np.zeros((len(text), FILTERS), np.float32)
        d_half[chunk[live]] += d_a
        after = chunk[live] + 1
        two = (after < len(text)) & (text[np.minimum(after, len(text) - 1)] == text[chunk[live]])
        np.add.at(d_half, after[two], d_a[two])
        matter = d_half.any(1)[row]
        w, d_r = windows[matter], d_half[row[matter]]
        d_r = np.where(self._responses(w) > 0, d_r, 0)
        d_filters = np.zeros_like(self.filters)
        for k in range(WIDTH):
            order = np.argsort(w[:, k], kind="stable")
            b = w[order, k]
            if len(b):
                first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                d_filters[k][b[first]] = np.add.reduceat(d_r[order], first, axis=0)
        return dict(zip(self.PARAMS, (d_filters, d_r.sum(0), d_hidden, d_bias2, d_out, d_bias3))), p


def _together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(texts: list[bytes], y: np.ndarray, shift: float = 0.0, epochs: int = EPOCHS) -> Network:
    """shift: log odds of the sample over those of the corpus. With one kind of label only the bias is fitted."""
    net = Network()
    if not len(texts) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        net.out[:] = 0
        net.bias3 = np.float32(np.log(prior / (1 - prior)))
        return net
    rng = np.random.default_rng(9)
    data, offsets = _together([texts[i] for i in rng.permutation(len(texts))[:200]])
    text, keep, average, *_ = net._chunks(data, offsets)
    a = average[keep]
    first = np.concatenate([a, a * a], 1)
    net.mean, net.scale = first.mean(0), first.std(0) + 1e-3
    first_moment = {p: np.zeros_like(getattr(net, p)) for p in net.PARAMS}
    second_moment = {p: np.zeros_like(getattr(net, p)) for p in net.PARAMS}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            grads, _ = net.gradients(*_together([texts[j] for j in own]), y[own])
            t += 1
            for p, g in grads.items():
                first_moment[p] = 0.9 * first_moment[p] + 0.1 * g
                second_moment[p] = 0.99 * second_moment[p] + 0.01 * g * g
                step = 0.01 * first_moment[p] / (1 - 0.9**t) / (np.sqrt(second_moment[p] / (1 - 0.99**t)) + 1e-8)
                setattr(net, p, (getattr(net, p) - step).astype(np.float32))
    net.shift = shift
    return net


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fitted on a bounded sample (see PER_CLASS) of labelled rows outside the held-out fold, on their whole texts."""
    chosen, shift = sample(docs, labels, "quality", FOLD, HELD, PER_CLASS)
    got = chosen.select("id", F.col("text").cast("binary").alias("text"), F.col("y").cast("int").alias("y")).toArrow().sort_by("id")
    return fit(got.column("text").to_pylist(), got.column("y").to_numpy().astype(np.float32), shift)


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(net.score(data, offsets))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; a null text is an empty one, which is one chunk of padding.

    A long text is read whole, a few times its size is held. Repeated rows each get a row, an empty table none; a null doc_id is not held out. Other columns are not read. Without labelled rows of both kinds all scores are the prior.
    """
    net = train(docs, labels)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = source.mapInArrow(_score(net), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
