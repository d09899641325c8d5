"""Connected components of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.sources.store import materialize


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One step: every node's neighbours (all, or only smaller ones) move to the smallest of them."""
    sides = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    links = edges.unionByName(sides) if both else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = links.join(least, "u")
    if both:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of `edges` (u, v); the component is its smallest node.

    Nulls and loops are left out. Rows never exceed the edges by more than one per node, a node
    with very many links is summed before the shuffle and joined by a splittable join, and rounds
    (about the logarithm of the longest chain) are cut by written tables.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), label)
    state = None
    while True:
        now = materialize(_stars(_stars(now, True), False), label)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == state or not seen["n"]:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
