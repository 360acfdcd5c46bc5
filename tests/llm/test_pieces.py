"""The own SentencePiece encoder against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from callscape.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.PieceBPE(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(both, text):
    own, library = both
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.round_trip(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
    assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "     ", "\n", " \n ", "▁", "a▁b", "the  cat   sat", "\x00", "漢字 😀", "é́", "x" * 500, "the " * 3000])
def test_edges(both, text):
    same(both, text)


def test_random(both):
    r = random.Random(5)
    for _ in range(3000):
        same(both, "".join(r.choice("abdeinorst  \n\t▁é漢😀.,-019") for _ in range(r.randrange(60))))


def test_both_ways_of_merging_agree(both):
    r = random.Random(6)
    for _ in range(2000):
        text = "".join(r.choice("aehinorst▁") for _ in range(r.randrange(1, 30)))
        assert both[0]._scanned(text) == both[0]._queued(text)
