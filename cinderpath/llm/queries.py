"""The operators as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, html_extract, lattice, licenses, minhash, mixing, phrases, ranked, substrings, token_output, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.encode_and_read_back(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), licenses.templates(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate_substrings(_read(spark, sf_dir, "documents")).drop("kept")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for each benchmark item; see ranked.search for nulls, ties and repeated rows."""
    return ranked.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; see bpe.encode for nulls and repeated rows."""
    import public_tokenizers

    return bpe.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language of all documents; see phrases.collocations for nulls, ties and repeated rows."""
    return phrases.collocations(_read(spark, sf_dir, "documents"), least=10, share=50, top=2000)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_id_output": op5_token_id_output,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_bpe_encoding": op12_bpe_encoding,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": licenses.oracle_sql(),
    "op11_ranked_lexical_search": ranked.oracle_sql(),
    "op13_phrase_collocations": phrases.oracle_sql(),
}
