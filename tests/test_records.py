import json

import pytest
from pyspark.sql import functions as F

from fieldlake.functions import vocab
from fieldlake.operators import coverage, quality, standardize, synth
from fieldlake.sources import knowledge, lake


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "path string, domain string, payload string, suffix string")
    return {r["path"]: r for r in quality.validate(df, suffix="suffix").collect()}


def test_validation_of_payloads(spark):
    v = verdicts(spark, [
        ("a", "crop", '{"crops": [{"x": 1}, {}]}', ".json"), ("b", "crop", "{}", ".json"), ("c", "crop", "[]", ".json"),
        ("d", "market", '{"markets": []}', ".json"), ("e", "crop", '{"foo": 1}', ".json"), ("f", "crop", '{"foo": [1]}', ".json"),
        ("g", "crop", "{broken", ".json"), ("h", "crop", "", ".json"), ("i", "crop", "null", ".json"), ("j", "crop", "5", ".json"),
        ("k", "crop", "plain", ".txt"), ("l", "crop", "  ", ".csv"), ("m", "images", '{"any": 1}', ".json"), ("n", "crop", "[1, 2, 3]", ".json"),
    ])
    ok = {k for k, r in v.items() if r["ok"]}
    assert ok == {"a", "d", "f", "k", "m", "n"}
    assert [v[k]["record_estimate"] for k in "adfkn"] == [2, 0, 1, 1, 3]
    assert v["b"]["errors"] == ["empty object payload"] and v["h"]["errors"] == ["empty file"]
    assert v["g"]["errors"] == ["invalid JSON"] and v["i"]["errors"] == ["payload is null"]


def test_quarantine_and_report(spark):
    df = spark.createDataFrame([("a", "crop", '{"crops": []}'), ("b", "crop", "{")], "path string, domain string, payload string")
    checked = quality.validate(df)
    valid, bad = quality.quarantine_split(checked)
    assert [r["path"] for r in valid.collect()] == ["a"]
    assert [(r["path"], r["reason"]) for r in bad.collect()] == [("b", "invalid JSON")]
    r = quality.validation_report(checked).first()
    assert (r["files_scanned"], r["valid"], r["invalid"], r["ok"]) == (2, 1, 1, True)


def test_standardize_families(spark):
    items = spark.createDataFrame([("Cotton", "कापूस", "Kharif", ["black"], "p", "crop")],
                                  "name_en string, name_mr string, season string, ideal_soil array<string>, source_path string, domain string")
    rows = standardize.standardize(items, "crops").orderBy("question").collect()
    assert [r["question"] for r in rows] == ["What should I know about growing Cotton?", "कापूस पीक माहिती काय आहे?"]
    assert rows[0]["answer"] == "Crop Cotton (कापूस). Season: Kharif. Soil: black. Pests: . Diseases: . Source: platform KB."
    assert rows[0]["category"] == "crop" and rows[0]["crop"] == "Cotton" and rows[0]["id"].startswith("std_")
    other = spark.createDataFrame([("v", "p", "soil")], "k string, source_path string, domain string")
    r = standardize.standardize(other, "records").first()
    assert r["answer"] == '{"k":"v"}' and r["category"] == "soil" and r["confidence"] == 0.4
    adv = spark.createDataFrame([("Rain", None, "Wait.", "थांबा रे", "p", "general")],
                                "title_en string, title_mr string, content_en string, content_mr string, source_path string, domain string")
    assert {r["question"] for r in standardize.standardize(adv, "advisories").collect()} == {"Advisory: Rain?", "Rain (MR)"}


def test_coverage_metrics(spark):
    recs = spark.createDataFrame([
        ("1", "crop", "Cotton", "en", "What is it?", "Answer one here", "train", 0.5),
        ("2", "crop", None, "en", "what is it? ", "answer one HERE", "val", 0.7),
        ("3", "finance", "", None, "", "x" * 60, "train", None),
    ], "id string, category string, crop string, language string, question string, answer string, split string, confidence double")
    missing = {r["field"]: r["missing"] for r in coverage.missingness(recs).collect()}
    assert missing["crop"] == 2 and missing["language"] == 1 and missing["question"] == 1 and missing["id"] == 0
    assert coverage.duplicate_rate(recs).first()["exact_qa_duplicates"] == 1
    hist = {(r["field"], r["bin"]): r["n"] for r in coverage.histogram(recs, ["answer"]).collect()}
    assert hist[("answer", "0-49")] == 2 and hist[("answer", "50-99")] == 1 and hist[("answer", "10000+")] == 0 and len(hist) == 8
    conf = coverage.confidence_stats(recs).first()
    assert (conf["mean"], conf["min"], conf["max"]) == (0.4, 0.0, 0.7)
    cats = spark.createDataFrame([(c,) for c in vocab.CATEGORIES], "id string")
    lost = coverage.gaps(cats, recs.select(F.col("category").alias("id")), "category", "high")
    assert lost.count() == len(vocab.CATEGORIES) - 2
    assert coverage.volume_gap(recs, "category", "finance", 5).count() == 1
    stats = coverage.coverage_stats(recs).first()
    assert stats["language_pct"] == 66.67 and stats["ok"] is False


def test_synthesis_volume_and_no_leakage(spark):
    crops = synth.taxonomy_facts(spark)
    packs = [synth.synthesize(crops, p) for p in ("crop", "paraphrase", "safety", "finance", "machinery", "seed")]
    packs += [synth.synthesize(f(crops), p) for p, f in [
        ("stage", synth.with_stages), ("irrigation", synth.with_districts), ("weather", synth.with_districts),
        ("soil", synth.with_soils), ("calendar", synth.with_months), ("practice", synth.with_practices)]]
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p)
    n = {r["pack"]: r["count"] for r in out.groupBy("pack").count().collect()}
    assert n["crop"] == 22 * 19 and n["practice"] == 22 * 12 * 7 and n["calendar"] == 22 * 12 * 3
    assert n["irrigation"] == 22 * len(vocab.district_names()) * 4 and n["soil"] == 22 * 6 * 4
    assert coverage.leakage(out).count() == 0
    assert out.select("id").distinct().count() == out.count()
    assert out.filter("crop IS NULL").count() == 0
    r = out.filter("template_id = 'en_overview' and crop = 'Cotton'").first()
    assert r["question"] == "What should a farmer know about growing Cotton?" and r["confidence"] == 0.77
    t = synth.targets(out).first()
    assert t["total"] == t["train"] + t["val"] + t["test"] and t["train"] / t["total"] == pytest.approx(0.8, abs=0.05)


def test_first_per_id_and_review_sample(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "x")], "id string, ord int, category string")
    assert {(r["id"], r["category"]) for r in synth.first_per_id(df, "ord").collect()} == {("a", "y"), ("b", "x")}
    many = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 90, "p").otherwise("q").alias("category"))
    got = {r["category"]: r["count"] for r in coverage.review_sample(many, "category", "id", 20).groupBy("category").count().collect()}
    assert got == {"p": 10, "q": 10}


@pytest.fixture()
def lake_root(tmp_path):
    raw = tmp_path / "raw" / "crop" / "s1"
    raw.mkdir(parents=True)
    (raw / "good.json").write_text('﻿{"crops": [{"name_en": "Cotton"}, {"name_en": "Cotton"}]}', encoding="utf-8")
    (raw / "broken.json").write_text("{", encoding="utf-8")
    (raw / "good.json.meta.json").write_text("{}", encoding="utf-8")
    (raw / "skip.bin").write_text("x", encoding="utf-8")
    (tmp_path / "raw" / "nowhere").mkdir()
    (tmp_path / "raw" / "nowhere" / "x.json").write_text("[1]", encoding="utf-8")
    done = tmp_path / "processed" / "soil"
    done.mkdir(parents=True)
    (done / "p.json").write_text("[1]", encoding="utf-8")
    (done / "p.json.clean.meta.json").write_text("{}", encoding="utf-8")
    return tmp_path


def test_raw_and_processed_scans(spark, lake_root):
    files = lake.read_lake(spark, str(lake_root))
    rows = {r["file_name"]: r for r in files.collect()}
    assert set(rows) == {"good.json", "broken.json"} and rows["good.json"]["domain"] == "crop"
    assert rows["good.json"]["payload"].startswith("{") and len(rows["good.json"]["sha256"]) == 64
    checked = quality.validate(files, suffix="suffix")
    assert {r["file_name"]: r["ok"] for r in checked.collect()} == {"good.json": True, "broken.json": False}
    items = lake.lake_items(checked.filter("ok")).select("list_key", "pos", F.to_json("item").alias("i")).collect()
    assert [(r["list_key"], r["pos"]) for r in items] == [("crops", 0), ("crops", 1)]
    assert [r["file_name"] for r in lake.read_processed(spark, str(lake_root)).collect()] == ["p.json"]
    staged = {r["file_name"]: r["action"] for r in quality.clean_stage(checked).collect()}
    assert staged == {"good.json": "cleaned", "broken.json": "skipped_invalid"}


def test_ingest_is_idempotent(spark, lake_root, tmp_path):
    files = lake.read_lake(spark, str(lake_root)).select(
        F.lit("s1").alias("source_id"), "domain", F.col("path").alias("dest"), "sha256", "bytes")
    manifest = str(tmp_path / "manifest" / "files")
    (tmp_path / "manifest").mkdir()
    for run, copied in (("r1", 2), ("r2", 0)):
        plan = lake.ingest_plan(files, lake.read_manifest(spark, manifest))
        assert lake.ingest_counters(plan).first()["copied"] == copied
        lake.append_manifest(plan, manifest, run)


def test_ingest_copies_before_it_records(spark, tmp_path):
    (tmp_path / "out").mkdir()
    manifest, store = str(tmp_path / "out" / "files"), str(tmp_path / "out" / "store")
    seen = []
    # a run that ends between copy and manifest is repeated; then one file changes, and changes back
    for run, text, recorded in (("r1", "one", False), ("r1", "one", True), ("r2", "two", True), ("r3", "one", True)):
        files = spark.createDataFrame([("s", "crop", "raw/a", text), ("s", "crop", "raw/b", "same"), ("s", "outside", "raw/c", "bad"), ("s", "crop", "raw/d", None)],
                                      "source_id string, domain string, dest string, payload string").select("*", F.sha2("payload", 256).alias("sha256"), F.length("payload").alias("bytes"))
        plan = lake.ingest_plan(files, lake.read_manifest(spark, manifest))
        lake.copy_files(plan, store, run)
        if recorded:
            lake.append_manifest(plan, manifest, run)
        got = {r["dest"]: r for r in lake.read_store(spark, store).collect()}
        assert {k: r["payload"] for k, r in got.items()} == {"raw/a": text, "raw/b": "same"} and got["raw/b"]["run_id"] == "r1"
        seen.append(spark.read.parquet(store).count())
    assert seen == [2, 2, 3, 4]


def test_registry(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({"sources": [
        {"id": "a", "type": "local_file", "domain": "crop", "also_domains": ["disease", "crop", "pest"], "enabled": True},
        {"id": "b", "type": "http_api", "domain": "market", "enabled": True, "requires_env": ["KEY"]},
        {"id": "c", "type": "web", "domain": "general", "enabled": False}]}))
    reg = lake.read_registry(spark, str(path))
    assert [r["id"] for r in lake.enabled_sources(reg, ["http_api"]).collect()] == ["b"]
    fan = lake.fan_out(reg.filter("id = 'a'")).orderBy("domain_pos").collect()
    assert [r["lake_domain"] for r in fan] == ["crop", "disease", "pest"]
    s = {(r["dimension"], r["value"]): r["n"] for r in lake.registry_summary(reg).collect()}
    assert s[("sources", "total")] == 3 and s[("sources", "enabled")] == 2 and s[("domain", "pest")] == 1
    ready = lambda env: {r["id"] for r in reg.filter(lake.env_ready(F.col("requires_env"), env)).collect()}
    assert ready({}) == {"a", "c"} and ready({"KEY": "demo"}) == {"a", "c"} and ready({"KEY": "k1"}) == {"a", "b", "c"}


def test_knowledge_base_files(spark, tmp_path):
    (tmp_path / "climate_zones.json").write_text(json.dumps({"zones": [
        {"zone": "Vidarbha", "districts": ["Nagpur", "Akola"], "rainfall_mm": "900", "recommended_crops": ["Cotton"], "notes": "dry"}]}))
    kb = knowledge.load_knowledge_base(spark, str(tmp_path))
    assert kb["crops"].count() == 0
    d = knowledge.documents(kb).collect()
    assert len(d) == 1 and d[0]["id"] == "zone_0"
    assert d[0]["content"] == "Climate zone Vidarbha. Districts: Nagpur, Akola. Rainfall: 900 mm. Recommended crops: Cotton. Notes: dry."


def test_lake_from_files_to_records(spark, lake_root):
    """Raw files to standard records: validate, clean, de-duplicate per list, standardise."""
    dirty = {"schemes": [
        {"name_en": "PM-KISAN <b>income</b> support", "benefits_en": "Six thousand &amp; more", "x": [1, {"raw": "a"}]},
        {"name_en": "PM-KISAN <i>income</i>  support", "benefits_en": "Six thousand & more", "x": [2]},
        {"name_en": "PMFBY", "benefits_en": "Crop insurance"}]}
    (lake_root / "raw" / "government").mkdir()
    (lake_root / "raw" / "government" / "dirty.json").write_text(json.dumps(dirty))
    staged = quality.clean_stage(quality.validate(lake.read_lake(spark, str(lake_root)), suffix="suffix"))
    cleaned = staged.filter("action = 'cleaned'").drop("payload").withColumnRenamed("cleaned", "payload")
    status = lake.dedup_items(lake.lake_items(cleaned))
    got = {(r["list_key"], r["pos"]): r["status"] for r in status.collect()}
    assert got == {("crops", 0): "kept", ("crops", 1): "exact_removed", ("schemes", 0): "kept", ("schemes", 1): "near_removed", ("schemes", 2): "kept"}
    recs = standardize.standardize(lake.typed_items(status.filter("status = 'kept'"), "schemes"), "schemes")
    assert sorted(r["question"] for r in recs.collect()) == [
        "What is the PM-KISAN income support government scheme?", "What is the PMFBY government scheme?"]


def test_dimensions(spark):
    from fieldlake.operators import dimensions as dim

    assert dim.aliases_without_crop(spark).count() == 0
    assert quality.integrity(dim.crop_dim(spark), "id", ["name_en", "name_mr", "name_hi", "crop_group"], 20).filter("NOT ok").count() == 0
    assert {r["item"]: r["n"] for r in dim.taxonomy_summary(spark).collect()}["mh_districts"] == 37 == dim.district_dim(spark).count()
    assert dim.unit_dim(spark).filter("alias = 'quintal'").first()["factor"] == 100.0


def test_synthesis_uses_all_cores(spark):
    from fieldlake.functions import text as T

    crops = synth.taxonomy_facts(spark).coalesce(1)
    for pack in ("crop", "safety"):
        out = synth.synthesize(crops, pack)
        assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # the split of a fact is found before it becomes a row per template, once per kind of key
        above, below = plan.split("Generate ", 1)
        assert "md5(" not in above and "md5(" in below
        assert out.where(F.col("split") != T.assign_split(F.col("fact_key"))).count() == 0
