"""The corpus pipeline: documents through STAGES, each on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callscape.llm import jaccard, linededup, packing, secrets
from callscape.llm import toxicity as toxic
from callscape.llm.store import Store, scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents found toxic go."""
    return toxic.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    return linededup.apply(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram jaccard join", jaccard_join), ("secret scans", secret_scan), ("packing", pack)]
#: Learned scores, shingle links and token ids are beyond SQL. Which stages have tests, and which not, is in the README.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages. What a stage leaves in the shared folder goes when the next one has read it; a stage's
    own tables go when its result is written. Only what the last stage's rows are read from stays."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():
            docs = store.save(stage(spark, docs, sf_dir), str(i))
        store.only(str(i))
    packed = STAGES[-1][1](spark, docs, sf_dir)
    store.clear()  # the last stage has read its documents
    return packed
