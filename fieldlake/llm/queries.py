"""The registered query of each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlake.llm import decontam, divergence, extract, language, minhash, packing, quality, repair, secrets, tokens, toolcalls, urlfilter, vectors
from fieldlake.session import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out()
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked_conversations(table(spark, sf_dir, "conversations"))


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered_pages(table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_language, op3_token_counts, op4_vectors, op5_quality, op6_secrets, op7_tool_calls, op8_url_lists, op9_minhash,
        op10_decontamination, op11_divergence, op12_extraction, op13_repair)
}
ORACLES = {
    "op7_tool_calls": toolcalls.ORACLE, "op8_url_lists": urlfilter.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_divergence": divergence.ORACLE,
}
