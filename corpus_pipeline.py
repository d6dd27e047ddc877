"""The corpus pipeline: each stage applies one corpus operator to all that its predecessor kept.

In the filtering stages a decision belongs to an id: all rows that repeat a rejected id go, and rows without an id
stay. Null and empty texts are never near duplicates or in the benchmark, and as toxic as the labels' share. Extra
columns pass, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderpath.llm import common, decontaminate, minhash, mixing, token_output, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rejected(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Docs without those ids; rows without an id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below one half."""
    scored = toxicity.toxicity(docs, _read(spark, sf_dir, "labels"))
    return _rejected(docs, common.save(scored.where("predicted = 1").select("doc_id")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (five words, similarity 0.8)."""
    groups = minhash.near_duplicates(docs, k=5, percent=80)
    return _rejected(docs, common.save(groups.where("not kept").select("doc_id")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    scanned = decontaminate.scan(docs, _read(spark, sf_dir, "benchmark"), n=10)
    return _rejected(docs, common.save(scanned.where(F.size("spans") > 0).select("doc_id")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rates say."""
    return mixing.mixed_documents(docs, common.save(mixing.mix(docs, _read(spark, sf_dir, "labels"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as written and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_and_read_back(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: SQL can't express a trained network, or hash-based mixing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and reread as the next one's docs."""
    docs = _read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.save(docs)
    return docs
