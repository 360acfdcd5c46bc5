"""The queries of this package: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from callscape.llm import ann, embdedup, jaccard, licenses, linededup, packing, pieces, quality, secrets, toxicity


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark, sf_dir):
    return quality.score(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    return linededup.digest(_docs(spark, sf_dir))


def op3_packing(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_nearest(spark, sf_dir):
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op6_sentencepiece(spark, sf_dir):
    return pieces.digest(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_embedding_dedup(spark, sf_dir):
    return embdedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(_docs(spark, sf_dir))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(_docs(spark, sf_dir))


def op10_jaccard_join(spark, sf_dir):
    return jaccard.join(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_packing, op4_nearest, op5_toxicity, op6_sentencepiece, op7_embedding_dedup, op8_license_scan, op9_secret_scan, op10_jaccard_join)}
