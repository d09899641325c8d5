"""The taxonomy as small tables, and checks that they agree with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions import vocab


def crop_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        vocab.CROPS, "id string, name_en string, name_mr string, name_hi string, crop_group string, scientific string")


def alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.crop_alias_rows(), "alias string, canonical string, ord int")


def district_dim(spark: SparkSession, state_id: str = "MH") -> DataFrame:
    return spark.createDataFrame([(state_id, d, i) for i, d in enumerate(vocab.district_names(state_id))],
                                 "state_id string, district string, ord int")


def unit_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        vocab.unit_rows(), "dimension string, alias string, factor double, canonical string, ord int")


def aliases_without_crop(spark: SparkSession) -> DataFrame:
    """Crops of the taxonomy that no alias leads to (empty when the tables agree)."""
    return crop_dim(spark).join(alias_dim(spark), F.col("name_en") == F.col("canonical"), "left_anti")


def taxonomy_summary(spark: SparkSession) -> DataFrame:
    """(item, n) counts of every taxonomy table."""
    counts = {
        "categories": len(vocab.CATEGORIES), "crops": len(vocab.CROPS), "crop_stages": len(vocab.CROP_STAGES),
        "irrigation_types": len(vocab.IRRIGATION_TYPES), "fertilizer_types": len(vocab.FERTILIZER_TYPES),
        "machinery_types": len(vocab.MACHINERY_TYPES), "schemes": len(vocab.SCHEME_CATALOG),
        "soil_types": len(vocab.SOIL_TYPES), "crop_aliases": len(vocab.CROP_ALIASES),
        "mh_districts": len(vocab.district_names()), "unit_dimensions": len(vocab.UNITS),
    }
    return spark.createDataFrame(list(counts.items()), "item string, n long")
