"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.store import Store

LENGTH = 2048
#: Pieces that a group holds, about. Groups are packed on their own.
GROUP = 20_000
END = 1
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """Ids as the tokenizers library gives them for a JSON file of its own.

    Where the file is plain byte-level BPE whose merges are in the order of their ids, tiktoken's
    faster encoder on the same vocabulary gives the same ids; else the library itself does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
        plain = (
            model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec.get("normalizer") is None and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not model.get("ignore_merges") and merged == sorted(merged) and len(merged) + 256 == len(vocabulary)
            and all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) for x in spec.get("added_tokens", []))
        )
        self.path, self.fast = path, None
        if plain:
            import tiktoken

            of = _bytes_of()
            ranks = {bytes(of[c] for c in k): v for k, v in vocabulary.items()}
            self.fast = tiktoken.Encoding("callscape", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern's stack ends at about half a million spaces in a row
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), LENGTH):
                    piece = ids[start : start + LENGTH]
                    out.append((row, doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of items in the given order, each in the first bin with room.

    A tournament tree holds at each node the most room of any bin below, so the first bin with
    room is one walk down.
    """
    n = 1
    while n < len(lengths):
        n *= 2
    room = [capacity] * (2 * n)
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        at = 1
        while at < n:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], places[i] = at - n, capacity - room[at]
        room[at] -= need
        at //= 2
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            best = left if left > right else right
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return bins, places


def _pack(table: pd.DataFrame) -> pd.DataFrame:
    table = table.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    bins, places = first_fit(table["length"].to_numpy(), LENGTH)
    table["sequence_id"] = table["group"] * (1 << 32) + bins
    table["offset"] = places
    return table[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece.

    A document is its ids and END; it is cut into pieces of LENGTH and a rest. Each group packs its pieces
    by first-fit decreasing. Null and empty texts are END alone. Rows are documents of their
    own, repeated ones too; a null doc_id stays null. An empty table gives no rows. Only doc_id and the text
    are read, so other columns may have any names. A long text is encoded whole: its ids take four bytes each.
    tokenizer: the place of a tokenizers JSON file, the same on all machines.
    """
    store = Store(docs.sparkSession, "packing")
    kind = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = store.save(source.mapInArrow(_pieces(tokenizer), kind), "pieces")
    n = max(1, round(pieces.count() / GROUP))
    # By row, not by document: many rows of one doc_id spread over the groups too.
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(n)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return grouped.groupBy("group").applyInPandas(_pack, out)
