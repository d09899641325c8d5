"""Domain folders, mergeable profiles and catalogue search of an empty query."""

import random

from pyspark.sql import functions as F

from fieldlake.operators import coverage, queryplan, synth
from fieldlake.sources import lake


def test_lake_flow_reads_asked_folders(spark, tmp_path):
    rows = [("crop", '{"doc_id": 1, "text": "<b>One</b>  two"}'), ("crop", '{"doc_id": 2, "text": "one two"}'), ("crop", '{"doc_id": 3, "text": " "}'),
            ("crop", "{broken"), ("crop", "[1, 2"), ("soil", '{"doc_id": 4, "text": null}'), ("soil", '{"doc_id": 5, "text": "One two", "more": 1}'), ("market", '{"doc_id": 6, "text": "x"}')]
    root = str(tmp_path)
    lake.write_domain_lines(spark.createDataFrame(rows, "domain string, line string"), root)
    counters, kept = lake.lake_flow(spark, root, "doc_id", "text", domains=["crop", "soil"])
    got = {r["domain"]: tuple(r)[1:] for r in counters.collect()}
    assert got == {"crop": (5, 2, 3, 1, 1), "soil": (2, 1, 1, 1, 0)}
    assert {(r["domain"], r["doc_id"]) for r in kept.collect()} == {("crop", 1), ("soil", 5)}
    plan = lake.read_domain_records(spark, root, "doc_id long", ["crop"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "crop" in plan.split("PartitionFilters")[1]
    nothing, none = lake.lake_flow(spark, root, "doc_id", "text", domains=["absent"])
    assert nothing.count() == none.count() == 0


def test_merged_profiles_are_profiles_of_the_whole(spark):
    rng = random.Random(1)
    rows = [(f"s{k % 7}", f"text {rng.randint(0, 900)} " + "x" * rng.randint(0, 300)) for k in range(6000)] + [("s0", None), ("none", None)]
    records = spark.createDataFrame(rows, "source string, text string")
    parts = coverage.profile_parts(records, "text", "source")
    merged = coverage.profile_estimates(coverage.merge_profiles(parts)).first()
    whole = coverage.profile_estimates(coverage.profile_parts(records, "text")).first()
    assert merged["n"] == whole["n"] == 6002 and merged["distinct"] == whole["distinct"]
    exact = len({t for _, t in rows if t})
    assert abs(merged["distinct"] - exact) <= 0.06 * exact
    lens = sorted(len(t) for _, t in rows if t)
    for p, rank in (("p50", 0.5), ("p90", 0.9)):
        below, upto = (sum(x < merged[p] for x in lens) / len(lens), sum(x <= merged[p] for x in lens) / len(lens))
        assert below - 0.04 <= rank <= upto + 0.04
    of = {r["source"]: r for r in coverage.profile_estimates(parts).collect()}
    assert of["none"]["n"] == 1 and of["none"]["distinct"] == 0 and of["none"]["p50"] is None
    again = coverage.merge_profiles(coverage.merge_profiles(parts.where("source < 's3'")).unionByName(coverage.merge_profiles(parts.where("source >= 's3'"))))
    assert coverage.profile_estimates(again).first()["distinct"] == whole["distinct"]  # merges of merges
    assert coverage.profile_parts(records.limit(0), "text", "source").count() == 0


def test_an_empty_query_matches_every_item(spark):
    items = spark.createDataFrame([(k, f"item{k} alpha") for k in range(12)], "id int, name string")
    queries = spark.createDataFrame([(1, ""), (2, None), (3, "a of"), (4, "item7 xx")], "qid int, query string")
    got = queryplan.search_catalog(queries, items, "id", F.col("name")).collect()
    by = {q: sorted((r["rank"], r["id"], r["matched"]) for r in got if r["qid"] == q) for q in (1, 2, 3, 4)}
    assert by[1] == by[2] == [(k + 1, k, True) for k in range(8)]
    assert by[3] == [(k + 1, k, False) for k in range(5)] and by[4] == [(1, 7, True)]


def test_rollup_counts_null_values_where_they_belong(spark):
    rows = [("a", None, "p", "train"), ("a", "en", None, "val")]
    got = {(r["dimension"], r["value"], r["n"]) for r in synth.rollup(spark.createDataFrame(rows, "category string, language string, pack string, split string")).collect()}
    assert got == {("category", "a", 2), ("language", None, 1), ("language", "en", 1), ("pack", "p", 1), ("pack", None, 1), ("split", "train", 1), ("split", "val", 1)}
