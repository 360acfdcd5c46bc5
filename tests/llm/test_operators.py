import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from callscape.llm import embdedup, jaccard, packing, pieces, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("text", ["", "a  b\n c", "é😀 x<|endoftext|>y", "don't 123"])
def test_token_ids_are_the_librarys(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.ByteBPE(path).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "the  quick    fox", "é😀\n▁x", "<s>aaaaaa"])
def test_pieces_are_the_librarys(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.PieceBPE(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.encode(text) == library.encode(text)
    assert own.decode(own.encode(text)) == library.decode(library.encode(text))


def test_packing_is_gapless(spark):
    rows = packing.pack(docs(spark, [None, "", "word " * 5000, "x"]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_jaccard_links_equal_sets_and_no_empty_ones(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, [text, text.upper(), None, " ", "a b", text + " end"])).collect()}
    assert rows == {0: (37, 0), 1: (37, 0), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (38, 0)}


def test_secret_spans(spark):
    rows = {r.doc_id: r for r in secrets.scan(docs(spark, ["é token = 'abcdef0123456789'", None])).collect()}
    assert (rows[0].n_assign, rows[0].n_hex, rows[1].spans) == (1, 1, "")
    assert rows[0].spans.startswith("assign:2:")


def test_embeddings_without_a_direction_link_with_nothing(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, 0.0], None)]
    out = embdedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
