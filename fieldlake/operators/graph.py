"""A property graph as two tables: nodes (id, label, properties) and edges (source, target,
relation). Results stay in long form, so a node with a third of all edges is just many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.operators.retrieval import contains_join
from fieldlake.sources.store import materialize

# Role of a neighbour by relation.
ROLES = {
    "AFFECTED_BY": "pests_and_diseases",
    "GROWS_IN": "soil_types",
    "REQUIRES_FERTILIZER": "recommended_fertilizers",
    "COVERED_BY": "applicable_schemes",
    "BENEFITS_FROM": "applicable_schemes",
}


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed graph from declared nodes (id, label, properties, ord) and edges (source,
    target, relation, ord).

    The last declaration of a node or of a (source, target) pair wins; edge ends that were
    never declared become nodes without a label.
    """
    unique_edges = edges.groupBy("source", "target").agg(
        F.max_by("relation", "ord").alias("relation"), F.min("ord").alias("ord"))
    declared = nodes.groupBy("id").agg(
        F.max_by(F.struct("label", "properties"), "ord").alias("d"), F.min("ord").alias("ord"))
    declared = declared.select("id", "d.label", "d.properties", "ord")
    ends = unique_edges.select(F.col("source").alias("id")).union(unique_edges.select(F.col("target").alias("id")))
    added = ends.distinct().join(declared, "id", "left_anti").select(
        "id", F.lit(None).cast("string").alias("label"),
        F.lit(None).cast(declared.schema["properties"].dataType).alias("properties"),
        F.lit(None).cast(declared.schema["ord"].dataType).alias("ord"))
    return declared.unionByName(added), unique_edges


def match_entities(names: DataFrame, nodes: DataFrame, name: str = "entity") -> DataFrame:
    """(entity, id): for every name the first node whose id contains it, case ignored."""
    wanted = names.select(name, F.lower(name).alias("_low"))
    blobs = nodes.select("id", F.lower("id").alias("_blob"), "ord")
    needles = wanted.select(F.col("_low").alias("_key"), "_low").distinct()
    hits = contains_join(needles, "_key", "_low", blobs, "id", "_blob").select("_low", "id").join(
        blobs.select("id", "ord"), "id")
    # Undeclared nodes have no position and come after all declared ones.
    first = hits.groupBy("_low").agg(F.min_by("id", F.struct(F.col("ord").isNull(), "ord", "id")).alias("id"))
    return wanted.join(first, "_low").select(name, "id")


def neighbors(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop around each `id` of targets: direction, relation, neighbour and its node facts."""
    out = targets.join(edges.withColumnRenamed("source", "id"), "id").select(
        "id", F.lit("outgoing").alias("direction"), "relation", F.col("target").alias("neighbor"))
    into = targets.join(edges.withColumnRenamed("target", "id"), "id").select(
        "id", F.lit("incoming").alias("direction"), "relation", F.col("source").alias("neighbor"))
    facts = nodes.select(F.col("id").alias("neighbor"), "label", "properties")
    return out.unionByName(into).join(facts, "neighbor", "left").select(
        "id", "direction", "relation", "neighbor", "label", "properties")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, direction, relation, neighbor): each edge seen from both of its ends, in one pass."""
    out = F.struct(F.col("source").alias("id"), F.lit("outgoing").alias("direction"), "relation", F.col("target").alias("neighbor"))
    into = F.struct(F.col("target").alias("id"), F.lit("incoming").alias("direction"), "relation", F.col("source").alias("neighbor"))
    return edges.select(F.explode(F.array(out, into)).alias("e")).select("e.*")


def all_neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`neighbors` of every edge end. Each of them is a node, so only the neighbour's facts are joined."""
    # a node without facts adds nothing to a left join
    facts = nodes.where("label IS NOT NULL OR properties IS NOT NULL").select(F.col("id").alias("neighbor"), "label", "properties")
    return both_ways(edges).join(facts, "neighbor", "left").select("id", "direction", "relation", "neighbor", "label", "properties")


def ecosystem(around: DataFrame) -> DataFrame:
    """(id, role, neighbor) rows: pests, soils, fertilisers and schemes of an entity."""
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return around.select("id", F.try_element_at(roles, F.col("relation")).alias("role"), "neighbor").filter(
        "role IS NOT NULL")


def ecosystem_counts(around: DataFrame) -> DataFrame:
    """One row per entity with the number of neighbours in each role."""
    eco = ecosystem(around)
    names = list(dict.fromkeys(ROLES.values()))
    return eco.groupBy("id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in names])


def within_hops(targets: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, hop, node, via, path) of every node within `hops` of each `id` of targets, both directions.

    `hop` is the least number of edges, `via` the node before, `path` the relations from the target,
    outgoing as >RELATION and incoming as <RELATION; of several ways the least (path, via) is kept. The
    frontier of each hop is expanded by a splittable join, reduced to one row per target and node,
    and freed of what earlier hops have reached before it is written.
    """
    steps = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), F.concat(F.lit(">"), "relation").alias("step")).unionByName(
        edges.select(F.col("target").alias("at"), F.col("source").alias("to"), F.concat(F.lit("<"), "relation").alias("step")))
    steps = materialize(steps, "graph-steps")
    frontier = targets.select("id", F.col("id").alias("node"), F.lit("").alias("path")).distinct()
    reached = frontier.select("id", "node")
    found = None
    for hop in range(1, hops + 1):
        met = frontier.join(steps, F.col("node") == F.col("at")).select(
            "id", F.col("to").alias("node"), F.struct(F.concat("path", "step").alias("path"), F.col("at").alias("via")).alias("way"))
        fresh = met.groupBy("id", "node").agg(F.min("way").alias("way")).join(reached, ["id", "node"], "left_anti")
        frontier = materialize(fresh.select("id", F.lit(hop).alias("hop"), "node", "way.via", "way.path"), "graph-frontier")
        found = frontier if found is None else found.unionByName(frontier)
        reached = reached.unionByName(frontier.select("id", "node"))
    return found
