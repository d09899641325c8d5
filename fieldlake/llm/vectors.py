"""Near-duplicate vectors by an exact metric range join.

Unit vectors are at most r = sqrt(2 - 2t) apart when their cosine is at least t. Pivots split the
vectors into cells; a cell of many vectors is split into blocks by hash. A vector v of cell i
goes to the blocks of another cell j unless the triangle inequality forbids it: for any u of cell j,
|u-v| <= r is possible only if v lies within r of the bisector of the two pivots and within
radius(j) + r of pivot j. Both sides of a pair of cells send only such vectors. Pairs of blocks are compared apart from each other, in double precision
after a single-precision pass with a safety margin. What leaves a block pair is one count and one
link per vector, never its list of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.graph import components
from fieldlake.sources.store import materialize

#: Vectors of a block, at least and at most about; rows of a comparison held at once.
SMALL, BLOCK, STRIP = 4_096, 16_384, 512
#: Pivots at most: they and a row per cell are all that the driver and each task hold. Fuller cells
#: are split into more blocks, so every pair that may link is still compared.
PIVOTS = 1_024
#: Slack of the single-precision pass and of the cell bounds.
SLACK = 1e-4


def _matrix(column: pd.Series) -> np.ndarray:
    """Unit rows in double precision, shorter ones padded with zeros."""
    width = max((len(v) for v in column), default=0)
    if all(len(v) == width for v in column):
        x = np.array([np.asarray(v, np.float64) for v in column]).reshape(len(column), width)
    else:
        x = np.array([np.pad(np.asarray(v, np.float64), (0, width - len(v))) for v in column])
    x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, class_id, weight, emb) of every usable row; equal vectors share the smallest id as class."""
    ok = F.col("emb").isNotNull() & (F.size("emb") > 0) & F.col("vec_id").isNotNull()
    fine = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("emb", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("emb")).where(ok).where(fine)
    return rows.groupBy("emb").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows by links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(left: pd.DataFrame, right: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """(class_id, links, root) of the rows of two blocks (or of one with itself) that have links.

    links: rows linked with this one, each with its weight. root: a class of the same component.
    """
    own = right is None
    rows = left if own else pd.concat([left, right], ignore_index=True)
    if rows.empty:
        return pd.DataFrame({"class_id": [], "links": [], "root": []})
    x, weight, width = _matrix(rows["emb"]), rows["weight"].to_numpy(), np.array([len(v) for v in rows["emb"]])
    x32 = x.astype(np.float32)
    m = len(left)
    found_a, found_b = [], []
    for k in range(0, m, STRIP):
        upto = min(m, k + STRIP)
        first = k if own else m
        near = x32[k:upto] @ x32[first:].T >= cosine - SLACK
        a, b = np.nonzero(near)
        a, b = a + k, b + first
        if own:
            a, b = a[a < b], b[a < b]
        for s in range(0, len(a), 200_000):
            i, j = a[s : s + 200_000], b[s : s + 200_000]
            good = (np.einsum("ij,ij->i", x[i], x[j]) >= cosine) & (width[i] == width[j])
            found_a.append(i[good])
            found_b.append(j[good])
    a = np.concatenate(found_a) if found_a else np.zeros(0, int)
    b = np.concatenate(found_b) if found_b else np.zeros(0, int)
    links = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
    hit = np.flatnonzero(links)
    ids = rows["class_id"].to_numpy()
    return pd.DataFrame({"class_id": ids[hit], "links": links[hit].astype(np.int64), "root": ids[_local_roots(len(rows), a, b)[hit]]})


def exchange(classed: DataFrame, cosine: float, block: int | None = None) -> DataFrame | None:
    """(class_id, weight, emb, x, y, side): every vector at the pairs of blocks x <= y in which it may have links.

    side 1 are vectors of block y, side 0 of block x. None for an empty table. Without `block` there are blocks
    enough for all cores, and no more: a vector travels to a block at most once, so fewer blocks mean fewer copies.
    """
    spark = classed.sparkSession
    n = classed.count()
    block = block or min(BLOCK, max(SMALL, n // (2 * spark.sparkContext.defaultParallelism)))
    n_pivots = max(1, min(PIVOTS, -(-n // block)))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    pivots = classed.select("emb").orderBy(F.xxhash64("emb"), "emb").limit(n_pivots).toPandas()["emb"]
    if not len(pivots):
        return None
    width = max(map(len, pivots))
    pivot = spark.sparkContext.broadcast(_matrix(pivots))

    def dots(column: pd.Series) -> np.ndarray:
        x = _matrix(column)
        p = pivot.value
        w = max(x.shape[1], width)
        return np.pad(x, ((0, 0), (0, w - x.shape[1]))) @ np.pad(p, ((0, 0), (0, w - width))).T

    kind = classed.schema["class_id"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if len(b):
                d = dots(b["emb"])
                home = d.argmax(1)
                yield pd.DataFrame({"class_id": b["class_id"], "weight": b["weight"], "emb": b["emb"], "cell": home, "near": d[np.arange(len(b)), home]})

    homes = materialize(classed.mapInPandas(assign, f"class_id {kind}, weight long, emb array<double>, cell int, near double"), "cells")
    cells = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("far")).collect()  # a row per pivot
    blocks, reach = np.zeros(n_pivots, int), np.zeros(n_pivots)
    for r in cells:
        blocks[r["cell"]] = -(-r["n"] // block)
        reach[r["cell"]] = np.sqrt(max(0.0, 2 - 2 * r["far"])) + radius  # from the pivot
    first = np.concatenate([[0], np.cumsum(blocks)])
    cell_of = np.repeat(np.arange(n_pivots), blocks)  # of every block

    def deal(batches):
        p = pivot.value
        gaps = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-12))
        for b in batches:
            if not len(b):
                continue
            d, cell = dots(b["emb"]), b["cell"].to_numpy()
            near = d[np.arange(len(b)), cell]
            # distance to the bisector of pivots i and j is (v.pi - v.pj) / |pi - pj|
            meets = (near[:, None] - d) / gaps[cell] <= radius
            meets &= (np.sqrt(np.maximum(2 - 2 * d, 0)) <= reach + SLACK) & (blocks > 0)
            salt = pd.util.hash_array(b["class_id"].to_numpy()) % np.maximum(blocks[cell], 1).astype(np.uint64)
            reached = meets[:, cell_of] | (cell[:, None] == cell_of)
            yield b[["class_id", "weight", "emb"]].assign(own=first[cell] + salt.astype(int), other=[np.flatnonzero(r) for r in reached])

    # a vector passes Python once; its copies are made by the explode
    own, other = F.col("own"), F.col("other")
    placed = homes.mapInPandas(deal, f"class_id {kind}, weight long, emb array<double>, own int, other array<int>").withColumn("other", F.explode("other"))
    return placed.select(
        "class_id", "weight", "emb", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), F.when(other > own, 0).otherwise(1).alias("side"))


def range_links(classed: DataFrame, cosine: float, block: int | None = None) -> DataFrame:
    """(class_id, links, root) from all pairs of classes with at least `cosine`; a class can have several rows."""
    kind = classed.schema["class_id"].dataType.simpleString()
    dealt = exchange(classed, cosine, block)
    if dealt is None:
        return classed.sparkSession.createDataFrame([], f"class_id {kind}, links long, root {kind}")

    def meet(key, group):
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if key[0] == key[1]:
            return compare(right.reset_index(drop=True), None, cosine)
        if left.empty or right.empty:
            return pd.DataFrame({"class_id": [], "links": [], "root": []})
        return compare(left.reset_index(drop=True), right.reset_index(drop=True), cosine)

    return dealt.groupBy("x", "y").applyInPandas(meet, f"class_id {kind}, links long, root {kind}")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without an
    id, link with nothing: n_links 0, their own component. Vectors of different lengths never
    link. Repeated rows are vectors of their own that link with each other. An empty table gives
    an empty one; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("emb"))
    classed = materialize(classes(vectors, vec_id, embedding), "vector-classes")
    met = materialize(range_links(classed, cosine, block), "vector-links")
    joined = components(met.select(F.col("class_id").alias("u"), F.col("root").alias("v")), "vector-components")
    # the smallest row of a block is not always the smallest id: components() settles that
    links = met.groupBy("class_id").agg(F.sum("links").alias("links"))
    per_class = (
        classed.join(links, "class_id", "left").join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("emb", (F.coalesce(F.col("links"), F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    )
    return (
        rows.join(per_class, "emb", "left")
        .withColumn("usable", F.col("component_id").isNotNull() & F.col("vec_id").isNotNull())
        .select(
            "vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
            F.coalesce(F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")) == F.col("vec_id"), F.lit(False)).alias("kept"),
        )
    )
