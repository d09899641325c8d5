"""Lake scans, the source registry, idempotent ingest and dataset sinks."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from fieldlake.functions import text as T
from fieldlake.functions import vocab
from fieldlake.operators.coverage import coverage_stats
from fieldlake.operators.dedup import dedup_near
from fieldlake.operators.standardize import explode_lists
from fieldlake.sources.knowledge import FILES, struct_type
from fieldlake.sources.store import materialize

RAW_SUFFIXES = [".json", ".jsonl", ".txt", ".csv"]
PLACEHOLDER_KEYS = ("YOUR_API_KEY", "demo", "changeme")

REGISTRY_SCHEMA = ty.StructType([
    ty.StructField("id", ty.StringType()),
    ty.StructField("name", ty.StringType()),
    ty.StructField("type", ty.StringType()),
    ty.StructField("path", ty.StringType()),
    ty.StructField("url", ty.StringType()),
    ty.StructField("domain", ty.StringType()),
    ty.StructField("also_domains", ty.ArrayType(ty.StringType())),
    ty.StructField("format", ty.StringType()),
    ty.StructField("license", ty.StringType()),
    ty.StructField("origin", ty.StringType()),
    ty.StructField("enabled", ty.BooleanType()),
    ty.StructField("requires_env", ty.ArrayType(ty.StringType())),
    ty.StructField("notes", ty.StringType()),
])
MANIFEST_SCHEMA = "dest string, sha256 string, bytes bigint, domain string, source_id string, run_id string"
STORE_SCHEMA = "dest string, sha256 string, payload string, bytes bigint, domain string, source_id string, run_id string, ingested_at timestamp"


# --- scans ------------------------------------------------------------------------------


def _located(files: DataFrame) -> DataFrame:
    """Add domain (folder below raw/ or processed/), file name and suffix from `path`."""
    return files.select(
        "*",
        F.regexp_extract("path", r"/(?:raw|processed)/([^/]+)/", 1).alias("domain"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"),
    )


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """Raw files below root/raw/<domain>/: path, domain, suffix, bytes, sha256, payload.

    Side files (`*.meta.json`, `.gitkeep`) and other suffixes are left out before any
    content is hashed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/raw")
    listed = _located(files.select(F.regexp_replace("path", r"\\", "/").alias("path"), "length", "content"))
    kept = listed.filter(
        F.col("suffix").isin(RAW_SUFFIXES) & ~F.col("file_name").endswith(".meta.json")
        & F.col("domain").isin(vocab.LAKE_DOMAINS)
    )
    return kept.select(
        "path", "domain", "file_name", "suffix", F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.regexp_replace(F.col("content").cast("string"), "^\uFEFF", "").alias("payload"),
    )


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    """Processed JSON files without side files, one row per file with its text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(
        f"{root}/processed", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return _located(files).filter(~F.contains("file_name", F.lit(".meta.")))


def read_records(spark: SparkSession, path: str, schema: str | ty.StructType) -> DataFrame:
    """JSON lines; a line that does not parse is skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_domain_lines(rows: DataFrame, root: str, domain: str = "domain", line: str = "line") -> None:
    """Lines of text as files of root/raw/domain=<domain>/."""
    rows.select(F.col(line).alias("value"), F.col(domain).alias("domain")).write.mode("append").partitionBy("domain").text(f"{root}/raw")


def read_domain_records(spark: SparkSession, root: str, schema: str, domains: list[str] | None = None) -> DataFrame:
    """JSON lines below root/raw/domain=<domain>/ with `domain` and `_corrupt`, the text of a line that is no record.

    Folders of other domains are not listed and other columns not parsed out of the lines.
    """
    reader = spark.read.schema(f"{schema}, _corrupt string, domain string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.json(f"{root}/raw")
    return rows.filter(F.col("domain").isin(domains)) if domains else rows


def lake_flow(spark: SparkSession, root: str, id_col: str, text_col: str, id_type: str = "long", domains: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(counters per domain, kept records) of scan, validation, cleaning and exact de-duplication of a lake's text records.

    A line is invalid if it is no JSON object, or its text is blank after cleaning. Of records of a
    domain with the same cleaned text, case ignored, the one with the smallest id is kept.
    """
    rows = read_domain_records(spark, root, f"{id_col} {id_type}, {text_col} string", domains)
    cleaned = materialize(rows.withColumn("cleaned", T.clean_text(F.col(text_col))).select(
        "domain", id_col, "cleaned", (F.col("_corrupt").isNull() & (F.coalesce("cleaned", F.lit("")) != "")).alias("ok")), "lake-cleaned")
    first = cleaned.filter("ok").groupBy("domain", F.sha2(F.lower("cleaned"), 256).alias("text_hash")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))
    first = materialize(first, "lake-kept")
    counts = cleaned.groupBy("domain").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("ok").alias("valid"))
    kept = first.groupBy("domain").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("copies") - 1).alias("exact_removed"))
    counters = counts.join(kept, "domain", "left").select(
        "domain", "scanned", "valid", (F.col("scanned") - F.col("valid")).alias("invalid"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("exact_removed", F.lit(0)).alias("exact_removed"))
    return counters, first.select("domain", id_col, "text_hash")


def tree_summary(files: DataFrame, per_domain: int = 20, order_col: str = "path") -> DataFrame:
    """The first files of every domain with the domain's full count."""
    totals = files.groupBy("domain").agg(F.count(F.lit(1)).alias("domain_files"))
    w = Window.partitionBy("domain").orderBy(order_col)
    first = files.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_domain)
    return first.join(totals, "domain").select("domain", "rank", order_col, "bytes", "domain_files")


def layer_stats(files: DataFrame, layer: Column) -> DataFrame:
    return files.groupBy(layer.alias("layer")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


# --- registry ------------------------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.schema(ty.StructType([ty.StructField("sources", ty.ArrayType(REGISTRY_SCHEMA))]))
    return whole.option("multiLine", True).json(path).select(F.explode("sources").alias("s")).select("s.*")


def env_ready(requires: Column, env: dict[str, str] | None = None) -> Column:
    """All named settings are present and no placeholder; names come from the driver's environment."""
    env = dict(os.environ) if env is None else env
    good = [k for k, v in env.items() if v and v not in PLACEHOLDER_KEYS]
    have = F.array(*[F.lit(k) for k in good]).cast("array<string>")
    return F.size(F.array_except(F.coalesce(requires, F.array().cast("array<string>")), have)) == 0


def enabled_sources(registry: DataFrame, types: list[str] | None = None) -> DataFrame:
    rows = registry.filter("enabled")
    return rows.filter(F.col("type").isin(types)) if types else rows


def fan_out(registry: DataFrame) -> DataFrame:
    """One row per source and domain: its own domain first, others once each in order."""
    also = F.coalesce("also_domains", F.array().cast("array<string>"))
    return registry.select(
        "*", F.posexplode(F.array_distinct(F.concat(F.array("domain"), also))).alias("domain_pos", "lake_domain"))


def registry_summary(registry: DataFrame) -> DataFrame:
    """(dimension, value, n): sources by type, by exploded domain, enabled and in total."""
    by_type = registry.groupBy(F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    by_domain = fan_out(registry).groupBy(F.col("lake_domain").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = registry.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled")).unpivot(
        [], ["total", "enabled"], "value", "n")
    parts = [("type", by_type), ("domain", by_domain), ("sources", totals)]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("dimension"), "value", "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- ingest ---------------------------------------------------------------------------------


def ingest_plan(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Action per (source_id, domain, dest) file against the manifest of earlier runs.

    files: source_id, domain, dest, sha256 (null if the source file is missing), bytes.
    A file is skipped if the latest run that wrote its place left the same hash there; run ids sort
    in the order of runs. An unknown domain is an error.
    """
    run = F.col("run_id") if "run_id" in manifest.columns else F.lit("")
    # New column names, because manifest and files may share their lineage.
    known = manifest.groupBy(F.col("dest").alias("_dest")).agg(F.max_by("sha256", run).alias("_sha256"))
    joined = files.join(known, F.col("dest") == F.col("_dest"), "left").withColumn("_seen", F.col("sha256") == F.col("_sha256"))
    action = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(~F.col("domain").isin(vocab.LAKE_DOMAINS), "error")
        .when(F.col("_seen"), "skipped_identical")
        .otherwise("copied")
    )
    return joined.withColumn("action", action).drop("_dest", "_sha256", "_seen")


def ingest_counters(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("action").isin("copied", "fetched")).alias("copied"),
        F.count_if(F.col("action").startswith("skipped")).alias("skipped"),
        F.count_if(F.col("action").isin("missing", "error")).alias("failed"),
        F.count_distinct("source_id").alias("sources_considered"),
    ).withColumn("ok", F.col("failed") == 0)


def copy_files(plan: DataFrame, store: str, run_id: str) -> None:
    """Write payload and meta row of every copied file to the Parquet store below the destination.

    plan: the columns of `ingest_plan` and `payload`. What this run has stored already is not stored
    again, so a repeat after a failure adds nothing. It comes before `append_manifest`: a file that
    the manifest names is in the store.
    """
    rows = plan.filter(F.col("action") == "copied").select(
        "dest", "sha256", F.col("payload").cast("string").alias("payload"), F.col("bytes").cast("bigint").alias("bytes"), "domain", "source_id",
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ingested_at"))
    stored = read_parquet_or_empty(plan.sparkSession, store, STORE_SCHEMA).filter(F.col("run_id") == run_id).select("dest", "sha256")
    rows.join(stored, ["dest", "sha256"], "left_anti").select(*[c.split()[0] for c in STORE_SCHEMA.split(", ")]).write.mode("append").parquet(store)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The latest content and meta row of every place; run ids sort in the order of runs."""
    rows = read_parquet_or_empty(spark, store, STORE_SCHEMA)
    return rows.groupBy("dest").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "dest"]), "run_id").alias("r")).select("dest", "r.*")


def append_manifest(plan: DataFrame, path: str, run_id: str) -> None:
    """Append the copied rows; the next run's plan skips them."""
    rows = plan.filter(F.col("action") == "copied").select(
        "dest", "sha256", F.col("bytes").cast("bigint"), "domain", "source_id", F.lit(run_id).alias("run_id"))
    rows.write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest so far; an absent one is empty."""
    return read_parquet_or_empty(spark, path, MANIFEST_SCHEMA)


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of a folder; an absent one is empty."""
    folder, _, name = path.rstrip("/").rpartition("/")
    try:
        known = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.parquet").load(folder).filter(F.contains("path", F.lit(f"/{name}/"))).select("path")
        absent = known.isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        absent = True
    if absent:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# --- sinks ------------------------------------------------------------------------------------


def write_jsonl(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder per split."""
    records.write.mode(mode).partitionBy("split").json(path)


def flatten_records(records: DataFrame) -> DataFrame:
    """Region to plain columns, metadata to a JSON string."""
    meta = F.to_json(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return records.select(
        *[c for c in records.columns if c not in ("region", "metadata")],
        F.col("region.state").alias("region_state"), F.col("region.district").alias("region_district"),
        meta.alias("metadata"))


def write_parquet(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    flatten_records(records).write.mode(mode).partitionBy("split").parquet(path)


def write_review_queue(sample: DataFrame, path: str) -> None:
    """Review queue as CSV with a header and an empty notes column."""
    sample.select(
        "id", "category", F.coalesce("crop", F.lit("")).alias("crop"), "language", "question",
        F.substring("answer", 1, 500).alias("answer"), "confidence", "split", "template_id",
        F.lit("false").alias("verified"), F.lit("").alias("reviewer_notes"),
    ).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def export_dataset(records: DataFrame, root: str, version: str | None = None) -> DataFrame:
    """Write one dataset version (JSON lines and Parquet per split), its manifest row and the
    pointer to the latest version; returns the manifest row."""
    version = version or datetime.now(timezone.utc).strftime("v%Y%m%dT%H%M%SZ")
    base = f"{root}/versions/{version}"
    write_jsonl(records, f"{base}/jsonl")
    write_parquet(records, f"{base}/parquet")
    written = records.sparkSession.read.schema(flatten_records(records).schema).parquet(f"{base}/parquet")
    counts = written.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
    )
    cover = coverage_stats(written).select("language_pct", "category_pct", "ok")
    manifest = counts.select(
        F.lit(version).alias("version"), F.lit(vocab.SCHEMA_VERSION).alias("schema_version"), "*",
        *[cover.select(c).scalar().alias(c) for c in cover.columns],
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    manifest.select("version", "total", "train", "val", "test").coalesce(1).write.mode("overwrite").json(f"{root}/LATEST")
    return records.sparkSession.read.schema(manifest.schema).json(f"{base}/manifest")


def lake_items(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Record items of payloads: path, domain, list_key, pos, item (variant) and a unique `row`."""
    items = explode_lists(files.select("path", "domain", payload), payload)
    return items.withColumn("row", F.concat_ws("#", "path", "list_key", F.lpad(F.col("pos").cast("string"), 10, "0")))


def dedup_items(items: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Status per item; only items of one file and list are compared."""
    return dedup_near(items, "row", ["item"], threshold, scope=["path", "list_key"])


def typed_items(items: DataFrame, list_key: str) -> DataFrame:
    """Items of one known list with their fields as columns, ready for `standardize`."""
    fields = next((lists[list_key] for lists in FILES.values() if list_key in lists), None)
    mine = items.filter(F.col("list_key") == list_key).select(
        F.col("path").alias("source_path"), F.col("domain").alias("domain"), "item")
    if fields is None:
        return mine
    return mine.select("source_path", "domain", F.try_variant_get("item", "$", struct_type(fields)).alias("v")).select(
        "source_path", "domain", "v.*")
