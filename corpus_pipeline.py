"""A corpus pipeline: each stage is one operator over all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm import decontam, minhash, packing, quality, secrets
from fieldlake.session import table
from fieldlake.sources.store import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.score(docs, quality.fit(docs), keep_columns=COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of copies and near copies stays.

    Rows that repeat an id are one document: of them the least row stays. Rows without an id all stay.
    """
    found = minhash.near_duplicates(docs)
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "near-copies")
    repeated = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    # the ids are hashed, so texts stream past them and are not sorted
    gone, repeated = gone.hint("shuffle_hash"), repeated.hint("shuffle_hash")
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text, and every document stays."""
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage), ("minhash near-dedup", near_duplicate_stage), ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage), ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The stages learn models and tokenize, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None
