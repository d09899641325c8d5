"""Keyed manifest, per-field upserts, state over streams and graph hops against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldlake.operators import farm, graph
from fieldlake.sources.manifest import Manifest, slot_of
from fieldlake.streaming import feeds

FILES = "run string, seq int, dest string, sha256 string, bytes long, domain string, source_id string"


def run_files(run, rows):
    return [(run, k, d, h, 1, domain, "s") for k, (d, h, domain) in enumerate(rows)]


def test_manifest_goes_back_and_forth(spark, tmp_path):
    rng = random.Random(1)
    held = Manifest(spark, str(tmp_path / "m"), 8)
    content: dict[str, str] = {}
    runs = [[("p", "A", "crop"), ("q", "A", "crop")], [("p", "B", "crop"), ("p", "B", "crop"), ("p", "A", "crop"), ("x", "A", "nowhere"), ("x", None, "crop"), ("q", "A", "crop")],
            [("p", "A", "crop"), ("q", "B", "crop"), ("q", "A", "crop")], []]
    runs += [[(f"d{rng.randint(0, 9)}", rng.choice("AB"), "soil") for _ in range(25)] for _ in range(2)]
    for k, rows in enumerate(runs):
        run = f"{k:03}"
        plan = held.plan(spark.createDataFrame(run_files(run, rows), FILES), "seq")
        want = []
        for d, h, domain in rows:
            action = "missing" if h is None else "error" if domain == "nowhere" else "skipped_identical" if content.get(d) == h else "copied"
            if action == "copied":
                content[d] = h
            want.append(action)
        assert [r["action"] for r in plan.orderBy("seq").collect()] == want
        for _ in range(2 if k == 1 else 1):  # a run that is repeated writes the same
            held.commit(plan, "seq", run)
        assert {r["dest"]: r["sha256"] for r in held.read().collect()} == content


def test_manifest_reads_touched_slots(spark, tmp_path):
    held = Manifest(spark, str(tmp_path / "m"), 8)
    rows = run_files("0", [(f"d{k}", "A", "crop") for k in range(40)])
    held.commit(held.plan(spark.createDataFrame(rows, FILES), "seq"), "seq", "0")
    one = spark.createDataFrame([("d1",)], "dest string").select(slot_of(slots=8)).first()[0]
    plan = held.read([one])._jdf.queryExecution().executedPlan().toString()
    assert "slot#" in plan and "PartitionFilters" in plan and str(one) in plan.split("PartitionFilters")[1]
    assert {r[0] for r in held.read([one]).select(slot_of(slots=8)).collect()} == {one}


def updates(seed, n=60):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.randint(0, 5), start + dt.timedelta(hours=rng.randint(0, 30)), k, rng.choice([None, 1.0, 2.0]), rng.choice([None, "a", "b"])) for k in range(n)]


UPDATE = "farm_id int, ts timestamp, tie int, area double, crop string"


def merged(rows):
    out = {}
    for farm_id, _, _, area, crop in sorted(rows, key=lambda r: (r[1], r[2])):
        old = out.get(farm_id, (None, None))
        out[farm_id] = (old[0] if area is None else area, old[1] if crop is None else crop)
    return out


def test_updates_merge_field_by_field(spark):
    rows = updates(2) + [(9, dt.datetime(2024, 1, 1), 99, None, None)]
    got = farm.latest_fields(spark.createDataFrame(rows, UPDATE), "farm_id", "ts", "tie", "area", "crop").collect()
    assert {r["farm_id"]: (r["area"], r["crop"]) for r in got} == merged(rows)


def test_stream_upsert_in_batches(spark, tmp_path):
    rows = updates(3)
    for k in range(3):  # batches not in the order of time
        spark.createDataFrame(rows[k::3], UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.upsert_fields(stream, "farm_id", "ts", "tie", ["area", "crop"], str(tmp_path / "state"), str(tmp_path / "progress"))
    got = feeds.read_fields(spark, str(tmp_path / "state"), "farm_id", ["area", "crop"]).collect()
    assert {r["farm_id"]: (r["area"], r["crop"]) for r in got} == merged(rows)


def in_batches(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_answers_hold_from_the_first_one(spark, tmp_path):
    # 8 is within ten minutes of 0 and 12 is not, whatever the calendar's periods; 11 comes late but in time
    batches = [[("k", at(8)), ("k", at(0)), ("m", at(19))], [("k", at(12)), ("k", at(12)), ("k", at(21)), ("m", at(29))], [("k", at(11)), ("k", at(40)), ("m", at(300))],
               [("k", at(1)), ("k", at(301))], [("z", at(900))]]  # at(1) is beyond the watermark
    stream = in_batches(spark, str(tmp_path / "in"), batches, "key string, ts timestamp")
    out = feeds.first_answers(stream, ["key"], "ts", 600, "15 minutes")
    got = feeds.run_once(out, str(tmp_path / "out")).collect()
    assert sorted((r["key"], r["answered_at"]) for r in got) == [
        ("k", at(0)), ("k", at(11)), ("k", at(21)), ("k", at(40)), ("k", at(301)), ("m", at(19)), ("m", at(29)), ("m", at(300))]


def test_answers_of_many_keys_share_their_state(spark, tmp_path):
    rng = random.Random(4)
    keys = [(None, "a\"b"), (2**60 + 1, None), *((k, "x") for k in range(40))]
    rows = [(*rng.choice(keys), at(rng.randint(0, 400))) for _ in range(600)]
    rows = sorted(rows, key=lambda r: r[2]) + [(7, "x", None), (7, "x", at(9000))]
    stream = in_batches(spark, str(tmp_path / "in"), [rows[:200], rows[200:450], rows[450:]], "k long, s string, ts timestamp")
    out = feeds.first_answers(stream, ["k", "s"], "ts", 3600, "15 minutes", groups=3)
    query = out.writeStream.format("memory").queryName("shared").outputMode("append").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    want, last = set(), {}
    for k, s, t in rows[:-2]:
        if (k, s) not in last or t >= last[k, s] + dt.timedelta(hours=1):
            last[k, s] = t
            want.add((k, s, t))
    got = [tuple(r) for r in spark.table("shared").collect()]
    assert len(got) == len(want) and set(got) == want
    # a state row per group of keys, not per key
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3


def test_spells_of_high_readings(spark, tmp_path):
    day = 24 * 60
    rows = [("a", at(k * day // 2), 50.0) for k in range(6)] + [("b", at(k * 2 * day), 50.0) for k in range(4)] + [("c", at(k * day // 2), 50.0 if k not in (2, 3) else 1.0) for k in range(6)]
    batches = [rows[:7], [*rows[7:], ("d", at(12 * day), 0.0)], [("d", at(12 * day + 1), 0.0)], [("a", at(3 * day), 60.0), ("d", at(13 * day), 0.0)]]  # the late row is dropped
    stream = in_batches(spark, str(tmp_path / "in"), batches, "key string, ts timestamp, value double")
    got = feeds.run_once(feeds.sustained_runs(stream, "key", "ts", "value", 10.0), str(tmp_path / "out")).collect()
    assert [(r["key"], r["first"], r["last"], r["n"], r["min_value"]) for r in got] == [("a", at(0), at(5 * day // 2), 6, 50.0)]


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_hops_against_breadth_first_search(spark, hops):
    rng = random.Random(hops)
    edges = [(f"n{rng.randint(0, 12)}", f"n{rng.randint(0, 12)}", rng.choice("RS")) for _ in range(18)] + [("n0", "n0", "R")]
    nodes = [f"n{k}" for k in range(14)]
    steps = [(a, b, ">" + r) for a, b, r in edges] + [(b, a, "<" + r) for a, b, r in edges]
    want = set()
    for start in nodes:
        seen, frontier = {start}, {start: ""}
        for hop in range(1, hops + 1):
            found = {}
            for a, b, s in steps:
                if a in frontier and b not in seen:
                    found[b] = min(found.get(b, ("~", "~")), (frontier[a] + s, a))
            want |= {(start, hop, n, via, path) for n, (path, via) in found.items()}
            frontier = {n: path for n, (path, _) in found.items()}
            seen |= set(found)
    got = graph.within_hops(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string, relation string"), hops)
    assert {tuple(r) for r in got.select("id", "hop", "node", "via", "path").collect()} == want


def test_all_neighbors_join_only_facts(spark):
    nodes = spark.createDataFrame([("a", "A", {"name": "a"}, 1), ("b", None, None, 2), ("z", "Z", None, 3)], "id string, label string, properties map<string,string>, ord long")
    raw = [("a", "b", "AFFECTED_BY", 1), ("a", "b", "GROWS_IN", 2), ("b", "a", "COVERED_BY", 1), ("b", "c", "ODD", 1), ("c", "c", "GROWS_IN", 1)]
    nodes, edges = graph.build_graph(nodes, spark.createDataFrame(raw, "source string, target string, relation string, ord long"))
    found = graph.all_neighbors(nodes, edges)
    columns = ["id", "direction", "relation", "neighbor", "label", "properties"]
    assert sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, graph.neighbors(nodes.select("id"), nodes, edges).select(columns).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    counts = graph.ecosystem_counts(graph.both_ways(edges))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, graph.ecosystem_counts(graph.neighbors(nodes.select("id"), nodes, edges)).collect()))
    assert "Join " not in counts._jdf.queryExecution().optimizedPlan().toString()
