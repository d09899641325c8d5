"""Intermediate tables written to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from fieldlake.session import use_checkpoints


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the checkpoint folder and read it back.

    Cuts lineage, survives lost executors, and later reads still prune columns.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that has fewer partitions than cores; otherwise no change."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
