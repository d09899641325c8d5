"""Continuous versions of the telemetry, audit and ingest jobs.

All transformations take and return (streaming) DataFrames; `run_once` drives one to
completion over the files that exist now.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from fieldlake.operators import farm
from fieldlake.session import use_checkpoints

# How long a feed answer stays valid, in seconds.
PRICE_TTL, SEARCH_TTL = 600, 300
# Groups of keys that keep their answers in one state row.
GROUPS = 1_024


def read_feed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream.

    The pattern in the last character matches the path itself; without it the file source
    insists on a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def telemetry_alerts(readings: DataFrame) -> DataFrame:
    """Alert rows of a telemetry stream: weather rules and the dry-soil trigger."""
    banded = farm.band_telemetry(readings)
    alerts = F.array(
        F.when((F.col("humidity_pct") > 80) & (F.col("temperature_c") > 25), "fungal_risk"),
        F.when(F.col("rainfall_mm") > 20, "heavy_rain"),
        F.when(F.col("irrigation_trigger"), "dry_soil"),
    )
    return banded.select("*", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("alert"))


def audit_stream(readings: DataFrame, farms: DataFrame) -> DataFrame:
    """Stream of readings joined with the static farm table, as audit action rows."""
    return farm.audit_rows(readings.join(farms, "farm_id"))


def sustained(
    readings: DataFrame, key: str, ts: str, value: str, threshold: float,
    window: str = "2 days", slide: str = "1 day", late: str = "1 day",
) -> DataFrame:
    """Windows in which the average stays above the threshold; late rows drop past the watermark.

    A hot key costs one state row per window: partial aggregates combine before the shuffle.
    """
    out = (
        readings.withWatermark(ts, late)
        .groupBy(key, F.window(ts, window, slide).alias("w"))
        .agg(F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.count(F.lit(1)).alias("n"))
    )
    return out.filter(F.col("avg_value") > threshold).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_value", "min_value", "n")


def fresh_answers(requests: DataFrame, keys: list[str], ts: str, ttl_seconds: int = PRICE_TTL) -> DataFrame:
    """One request per key and validity period; repeats within the period are answered already."""
    period = F.floor(F.unix_timestamp(ts) / ttl_seconds).alias("period")
    rows = requests.withWatermark(ts, f"{ttl_seconds} seconds").select(*keys, ts, period)
    return rows.dropDuplicatesWithinWatermark([*keys, "period"])


def sustained_runs(readings: DataFrame, key: str, ts: str, value: str, threshold: float, least: str = "2 days", gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """Spells of at least `least` in which a key's readings above the threshold follow each other within `gap`.

    Session windows: a spell has any length, is closed by a gap without high readings, and is given
    out once the watermark has passed its end; later rows are dropped. A hot key costs a state row per spell.
    """
    # a reading with no gap is in no session, and unlike a filter this leaves it to move the watermark
    gaps = F.when(F.col(value) > threshold, F.lit(gap)).otherwise(F.lit("0 seconds"))
    spells = (
        readings.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gaps).alias("w"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.min(value).alias("min_value"), F.count(F.lit(1)).alias("n")))
    return spells.where(F.col("last") >= F.col("first") + F.expr(f"interval {least}")).select(key, "first", "last", "min_value", "n")


def first_answers(requests: DataFrame, keys: list[str], ts: str, ttl_seconds: int = PRICE_TTL, late: str = "600 seconds", groups: int = GROUPS) -> DataFrame:
    """(keys, answered_at): requests that have to be answered anew, because the key's last answer is `ttl_seconds` old.

    The keys are dealt to `groups` by hash, and a group's state holds its keys' last answers and the
    requests that wait for the watermark; a timer wakes it when the watermark passes the next one. So a key
    costs a few values instead of a call of its own, and the order in which requests arrive within `late`
    changes nothing; later ones are dropped. One waiting time stands for all its repeats.
    """
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    ttl = ttl_seconds * 1_000_000

    def answer(group, frames, state):
        held, last, asked, waiting = state.get if state.exists else ([], [], [], [])
        last = dict(zip(held, last, strict=True))
        now = state.getCurrentWatermarkMs() * 1000
        rows = pd.concat([pd.DataFrame({"_key": pd.Series(asked, dtype=object), "_at": pd.Series(waiting, dtype="int64")}), *(f[["_key", "_at"]] for f in frames)])
        rows = rows.drop_duplicates().sort_values("_at")
        due = rows["_at"] <= now
        answered = []
        for k, t in zip(rows["_key"][due].tolist(), rows["_at"][due].tolist(), strict=True):
            if k not in last or t >= last[k] + ttl:
                last[k] = t
                answered.append((k, t))
        last = {k: t for k, t in last.items() if now < t + ttl}  # after that the next request is answered anyway
        left = rows[~due]
        if last or len(left):
            state.update((list(last), list(last.values()), left["_key"].tolist(), left["_at"].tolist()))
            wake = min([*(t + ttl for t in last.values()), *left["_at"].head(1).tolist()])
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if answered:
            yield pd.DataFrame(answered, columns=["_key", "_at"])

    # a group's rows carry their key as one string, which is exact and may hold nulls
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    rows = requests.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), F.to_json(F.struct(*keys), exact).alias("_key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), ts)
    found = rows.groupBy("_group").applyInPandasWithState(
        answer, "_key string, _at long", "held array<string>, last array<long>, asked array<string>, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        F.from_json("_key", ", ".join(f"`{k}` {types[k]}" for k in keys), exact).alias("_key"),
        F.timestamp_micros("_at").cast(types[ts]).alias("answered_at")).select("_key.*", "answered_at")


def upsert_fields(updates: DataFrame, key: str, ts: str, tie: str, fields: list[str], state: str, progress: str) -> None:
    """Merge a stream of updates field by field into the table at `state`, see `read_fields`.

    The table holds every field's newest given value with its time, so updates may come in any order.
    A batch writes its own version from the one before, so a replayed batch writes the same again.
    """
    def stamped(rows: DataFrame) -> DataFrame:
        return rows.select(key, *[F.when(F.col(f).isNotNull(), F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(f).alias("value"))).alias(f) for f in fields])

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = stamped(batch)
        if batch_id:
            fresh = fresh.unionByName(batch.sparkSession.read.parquet(f"{state}/version={batch_id - 1:012d}"))
        # stamps are compared field by field, so the newest struct is the newest value
        fresh.groupBy(key).agg(*[F.max(f).alias(f) for f in fields]).write.mode("overwrite").parquet(f"{state}/version={batch_id:012d}")

    run_batches(updates, progress, handle)


def read_fields(spark: SparkSession, state: str, key: str, fields: list[str]) -> DataFrame:
    """The last version of an `upsert_fields` table: one row per key."""
    rows = spark.read.option("basePath", state).option("dataSource.partitionColumnTypeInference.enabled", "false").parquet(state)
    last = rows.select(F.max("version")).scalar()
    return rows.where(F.col("version") == last).select(key, *[F.col(f"{f}.value").alias(f) for f in fields])


def replayed(rows: DataFrame, ts: str, files: int, label: str) -> DataFrame:
    """`rows` as a stream of several batches in time order: written as folders, one per batch."""
    spark = rows.sparkSession
    base = sink_folder(spark, label)
    cuts = rows.select(F.percentile_approx(ts, [k / files for k in range(1, files)])).first()[0] if files > 1 else []
    number = sum((F.when(F.col(ts) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(files):  # one write per file keeps their order in time; all cores read, one task writes
        rows.where(F.coalesce(number, F.lit(0)) == k).repartition(1).write.mode("append").parquet(base)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base)


def run_once(df: DataFrame, sink: str, schema: StructType | None = None) -> DataFrame:
    """Process everything available into Parquet at `sink` and return what was written."""
    spark = df.sparkSession
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", f"{sink}/data").option("checkpointLocation", f"{sink}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema or df.schema).parquet(f"{sink}/data")


def run_batches(df: DataFrame, progress: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything available through a batch function."""
    query = (
        df.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest_new(files: DataFrame, manifest_path: str, progress: str, store: str) -> None:
    """Copy new (dest, sha256, payload) rows of a file stream to the store, then append them to the manifest.

    The batch id is stored with the rows, so a batch replayed after a failure adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        from fieldlake.sources.lake import append_manifest, copy_files, ingest_plan, read_manifest

        plan = ingest_plan(batch, read_manifest(batch.sparkSession, manifest_path))
        copy_files(plan, store, f"stream-{batch_id:012d}")
        append_manifest(plan, manifest_path, f"stream-{batch_id:012d}")

    run_batches(files, progress, handle)


def append_log(entries: DataFrame, log_path: str, progress: str) -> None:
    """Append an action log stream; each batch owns one folder and a replay overwrites it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    run_batches(entries, progress, handle)


def sink_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
