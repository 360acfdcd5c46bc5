"""Word shingles of whole texts as 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240)
#: A hash value for each byte, A-Z as a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FACTOR = U(0x9E3779B97F4A7C15)
POWERS = np.concatenate([[U(1)], np.cumprod(np.full(4095, FACTOR, np.uint64))])
#: Texts of about so many bytes are worked on together.
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 255


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    """FACTOR^0 .. FACTOR^(n - 1)."""
    if n <= len(POWERS):
        return POWERS[:n]
    return np.concatenate([[U(1)], np.cumprod(np.full(n - 1, FACTOR, np.uint64))])


#: Bytes whose words are found at once: what lies around them is some 40 bytes a byte, for a piece only.
PIECE = 1 << 21


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word, for texts that lie between offsets in data.

    Works in pieces of PIECE bytes. A word's hash is that of a sum over its bytes, so a word that goes on in the next
    piece carries its sum and length.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text begins a word
    sums, places = [], []
    done, so_far = 0, U(0)  # of the word that reaches the piece's beginning: its bytes and its sum
    for begin in range(0, len(data), PIECE):
        piece = data[begin : begin + PIECE]
        inside = ~SPACE[piece]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[begin + 1 : begin + len(piece)]
        goes_on = done > 0 and bool(inside[0]) and not edge[begin]
        if done and not goes_on:
            sums.append(np.array([so_far]))
        if inside[0]:
            starts[0] = True
        at = np.flatnonzero(starts)
        if not len(at):
            done, so_far = 0, U(0)
            continue
        where = np.flatnonzero(inside)
        within = where - at[np.cumsum(starts)[where] - 1]
        value = BYTE[piece[where]] * powers(int(within.max()) + 1)[within]
        total = np.add.reduceat(value, np.searchsorted(where, at))
        if goes_on:
            total[0] = (int(so_far) + int(total[0]) * pow(int(FACTOR), done, 1 << 64)) % (1 << 64)
        fresh = at[1:] if goes_on else at
        places.append(fresh + begin)
        if inside[-1]:  # the last word may go on
            length = len(piece) - int(at[-1])
            done = length + (done if goes_on and len(at) == 1 else 0)
            so_far = total[-1]
            total = total[:-1]
        else:
            done, so_far = 0, U(0)
        sums.append(total)
    if done:
        sums.append(np.array([so_far]))
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(sums).astype(np.uint64)), np.searchsorted(offsets, np.concatenate(places), side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 56-bit shingle hashes sorted by (text, hash), and where each text's begin (n + 1 offsets).

    Takes SLICE_TEXTS texts at most. What is held is about ten times the longest text, at six bytes a word. A text of fewer than k words has its whole sequence as one; one without words has none.
    """
    n = len(offsets) - 1
    word, text = words(data, offsets)
    count = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])
    per_text = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.repeat(np.arange(n), per_text)
    at = np.arange(out[-1]) - out[owner] + begin[owner]
    length = np.minimum(count[owner], k)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    key = np.empty(len(at), np.uint64)
    for a in range(0, len(at), PIECE):
        b = min(len(at), a + PIECE)
        h = length[a:b].astype(np.uint64) * U(0xD6E8FEB86659FD93)
        for i in range(k):
            part = padded[at[a:b] + i]
            part[i >= length[a:b]] = 0
            h = mix(h + part)
        # The text in the high 8 bits, for one sort by (text, hash), so 56 bits of hash are kept.
        key[a:b] = (owner[a:b].astype(np.uint64) << U(56)) | (h >> U(8))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & U((1 << 56) - 1), np.searchsorted(key >> U(56), np.arange(n + 1, dtype=np.uint64)).astype(np.int64)


def slices(texts, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts, of `size` bytes at most or one text, from an Arrow string array; null texts are empty."""
    import pyarrow as pa

    array = texts.cast(pa.large_binary())
    n = len(array)
    if not n:
        return
    _, where, body = array.buffers()
    ends = np.frombuffer(where, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        last = min(last, n, first + SLICE_TEXTS)
        yield first, last, data[ends[first] : ends[last]], (ends[first : last + 1] - ends[first]).astype(np.int64)
        first = last
