"""SentencePiece BPE encoding and decoding, with its own exact encoder.

Encoding is by backtracking: Aho-Corasick gives the vocabulary pieces that begin at each position; from
the left the longest piece is taken that is compatible with the one before it, that is, merging the two
pieces' text afresh gives just the two. Where none fits, the position is marked as failed in a bit
field and the piece before it gives way to a shorter one. A sequence whose neighbours are all compatible is
the one that merging the whole gives. Mostly the longest matches are compatible as they are, so they are tried first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words, and pairs of pieces, that a task remembers.
REMEMBER, PAIRS = 300_000, 600_000
#: Texts of up to so many characters are merged by scanning a list instead of a queue.
SCANNED = 64
#: The score of what is no piece.
NONE = float("-inf")


class PieceBPE:
    """The pieces of a SentencePiece model file of type BPE with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("the model must be BPE with byte fallback, without normalisation or removal of spaces")
        self.prefix = norm.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        if kinds.USER_DEFINED in self.kind or kinds.UNUSED in self.kind:
            raise ValueError("user-defined and unused pieces are not handled")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, k in enumerate(self.kind) if k == kinds.CONTROL}
        self.unknown = {i for i, k in enumerate(self.kind) if k == kinds.UNKNOWN}
        self.unknown_text = train.unk_surface
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = [p.score for p in model.pieces]
        self.score_of = {p: self.score[i] for p, i in self.id.items()}
        # What has no piece of its own goes to bytes, so a longer piece with such a character would break that.
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a character of a piece is no piece itself")
        self.characters = {p for p in self.id if len(p) == 1}
        # Characters without a piece stand alone. So do words, if no piece holds a space mark after another character.
        self.by_word = SPACE in self.characters and not any(SPACE in p.lstrip(SPACE) for p in self.id)
        within = "".join(map(re.escape, sorted(self.characters - {SPACE} if self.by_word else self.characters)))
        self.stretches = re.compile(f"{SPACE}*[{within}]+|{SPACE}+|[^{within}{SPACE}]+" if self.by_word else f"[{within}]+|[^{within}]+")
        scores = [self.score[i] for i in self.id.values() if len(self.text[i]) > 1]
        tied = {s for s, n in Counter(scores).items() if n > 1}
        self.tied = {self.text[i] for i in self.id.values() if self.score[i] in tied and len(self.text[i]) > 1}
        self.tied_spaces = all(set(t) == {SPACE} for t in self.tied)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = list(map(len, self.text))
        #: The longest other piece that a piece begins with, or -1.
        self.shorter = [next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), -1) for p in self.text]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], int, str, str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], int, str, str]] = {}
        self.special = self.silent | self.unknown | set(self.byte_of)

    def merge(self, text: str) -> list[int]:
        """Ids by merging, best score first and leftmost among equals: the definition."""
        out: list[int] = []
        for p in self._scanned(text) if len(text) <= SCANNED else self._queued(text):
            k = self.id.get(p)
            out += [k] if k is not None else [self.byte[b] for b in p.encode("utf-8")]
        return out

    def _scanned(self, text: str) -> list[str]:
        """The parts of a short text: every pair's score in a list, of which the first best is merged."""
        parts, score = list(text), self.score_of.get
        offers = [score(x + y, NONE) for x, y in pairwise(parts)]
        while offers and (best := max(offers)) > NONE:
            i = offers.index(best)
            parts[i] += parts.pop(i + 1)
            del offers[i]
            if i < len(offers):
                offers[i] = score(parts[i] + parts[i + 1], NONE)
            if i:
                offers[i - 1] = score(parts[i - 1] + parts[i], NONE)
        return parts

    def _queued(self, text: str) -> list[str]:
        """The parts of any text, from a queue of offers."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := self.id.get(whole := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, whole))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, whole = heapq.heappop(queue)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[j] is None or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces gives just the two; for a = -1, whether merging the text of b gives b."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.merge(self.text[b]) == [b] if a < 0 else self.merge(self.text[a] + self.text[b]) == [a, b]
        self.pairs[a, b] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch whose every character is a piece."""
        known, size, shorter = self.pairs.get, self.size, self.shorter
        longest = [k for _, k in self.automaton.iter_long(text)]
        if known((-1, longest[0])) and all(map(known, pairwise(longest))):
            return longest
        n = len(text)
        first = [0] * n  # the longest piece that begins at each place: ends ascend, so the last one written
        for end, k in self.automaton.iter(text):
            first[end + 1 - size[k]] = k
        failed = bytearray(n + 1)
        out: list[int] = []
        at, last, k = 0, -1, first[0]
        while at < n:
            while k >= 0:
                end = at + size[k]
                if not failed[end]:
                    fit = known((last, k))
                    if fit or fit is None and self.fits(last, k):
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at, last = end, k
                if at < n:
                    k = first[at]
            elif out:
                failed[at] = 1
                k = out.pop()
                at -= size[k]
                last, k = out[-1] if out else -1, shorter[k]
            else:
                return self.merge(text)
        return out

    def _word(self, word: str) -> tuple[tuple[int, ...], int, str, str]:
        """(ids, their number, the ids written out, the text that they decode to, with space marks) of a stretch."""
        found = self.older.get(word)
        if found is None:
            if word[-1] not in self.characters:  # never part of a piece
                ids = [self.byte[b] for b in word.encode("utf-8")]
            elif self.tied and (not self.tied_spaces or SPACE * 2 in word) and any(t in word for t in self.tied):  # the order of equal scores isn't a matter of neighbours
                ids = self.merge(word)
            else:
                ids = self.backtrack(word)
            found = (tuple(ids), len(ids), ",".join(map(str, ids)), self._joined(ids))
        if len(self.words) > REMEMBER // 2:
            self.words, self.older = {}, self.words
        self.words[word] = found
        return found

    def _words(self, text: str) -> list[tuple[tuple[int, ...], int, str, str]]:
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        if self.prefix:
            marked = SPACE + marked
        return [self.words.get(w) or self._word(w) for w in self.stretches.findall(marked)]

    def encode(self, text: str) -> list[int]:
        return [i for w in self._words(text) for i in w[0]]

    def _joined(self, ids: list[int]) -> str:
        if self.special.isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids))
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i >= 0 and i not in self.silent:
                out.append(self.unknown_text if i in self.unknown else self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library's decode gives it."""
        return self._spaced(self._joined(ids))

    def _spaced(self, joined: str) -> str:
        if self.prefix and joined.startswith(SPACE):
            joined = joined[1:]
        return joined.replace(SPACE, " ")

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the ids written out, what they decode to); words remembered are not encoded or decoded again."""
        if not (words := self._words(text)):
            return 0, "", ""
        _, counts, written, joined = zip(*words)
        return sum(counts), ",".join(written), self._spaced("".join(joined))


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that is no part of a whole character is U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(1)
def _loaded(path: str) -> PieceBPE:
    """One for a Python worker, whose tasks share what it remembers."""
    return PieceBPE(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            n, ids, texts = [], [], []
            for text in batch.column(1):
                count, written, decoded = bpe.round_trip(text.as_py() or "")
                n.append(count)
                ids.append(hashlib.sha256(written.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids])], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids, decoded. A null text is empty and has no ids; every row gets a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(model), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, with no shuffle. Null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
