"""The ingest manifest as a keyed table: one row per place, in slots by a hash of the place.

A run reads the slots that its files fall into, not the history of runs, and writes those slots anew
(`slots/slot=<s>/run=<id>`); a row per slot in `log`, appended last, says which run's folder holds a
slot now. A run that failed before its log rows changes nothing, and its repeat writes the same folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlake.functions import vocab
from fieldlake.sources.lake import read_parquet_or_empty
from fieldlake.sources.store import materialize

SLOTS = 64
_ROW = "dest string, sha256 string, bytes long, domain string, source_id string"
_KEPT = [c.split()[0] for c in _ROW.split(", ")]


def slot_of(dest: str = "dest", slots: int = SLOTS):
    return F.pmod(F.xxhash64(dest), F.lit(slots)).cast("int")


class Manifest:
    """The manifest at `path`; run ids sort in the order of runs."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def _log(self) -> DataFrame:
        return read_parquet_or_empty(self.spark, f"{self.path}/log", "slot int, run string")

    def read(self, slots: list[int] | None = None) -> DataFrame:
        """The latest row of every place, of some slots or of all; other slots' folders are not listed into the scan."""
        current = self._log().groupBy("slot").agg(F.max("run").alias("run"))
        rows = read_parquet_or_empty(self.spark, f"{self.path}/slots", f"{_ROW}, slot int, run string")
        if slots is not None:
            current, rows = current.where(F.col("slot").isin(slots)), rows.where(F.col("slot").isin(slots))
        return rows.join(current, ["slot", "run"], "left_semi").select(*_KEPT)

    def plan(self, files: DataFrame, order: str) -> DataFrame:
        """`files` with an action each; of several contents of a place in a run, `order` says which came first.

        files: source_id, domain, dest, sha256 (null if the source file is missing), bytes. A file is
        skipped if the content before it at its place, in this run or at the end of the last one, is
        the same; going back to an older content is a copy.
        """
        fit = F.col("sha256").isNotNull() & F.col("domain").isin(vocab.LAKE_DOMAINS)
        marked = files.withColumn("_slot", slot_of(slots=self.slots)).withColumn("_fit", F.coalesce(fit, F.lit(False)))
        touched = sorted(r[0] for r in marked.where("dest is not null").select("_slot").distinct().collect())  # at most `slots`
        known = self.read(touched).select(F.col("dest").alias("_dest"), F.col("sha256").alias("_known"))
        # files that were not copied leave no content behind
        before = Window.partitionBy("dest").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(F.col("_fit"), F.col("sha256")), ignorenulls=True).over(before)
        joined = marked.withColumn("_last", last).join(known, F.col("dest") == F.col("_dest"), "left")
        same = F.col("sha256") == F.coalesce("_last", "_known")
        action = (
            F.when(F.col("sha256").isNull(), "missing").when(~F.col("_fit"), "error")
            .when(same, "skipped_identical").otherwise("copied"))
        return joined.withColumn("action", action).drop("_slot", "_fit", "_last", "_dest", "_known")

    def commit(self, plan: DataFrame, order: str, run: str) -> None:
        """Record a run's copies: the last content of each place replaces the place's row."""
        kept = [c for c in _KEPT if c != "dest"]
        rows = plan.where("action = 'copied'").groupBy("dest").agg(F.max_by(F.struct(*[F.col(c) for c in kept]), order).alias("r"))
        fresh = materialize(rows.select("dest", F.col("r.sha256"), F.col("r.bytes").cast("long").alias("bytes"), "r.domain", "r.source_id", slot_of(slots=self.slots).alias("slot")), "manifest-run")
        touched = sorted(r[0] for r in fresh.select("slot").distinct().collect())  # at most `slots`
        if not touched:
            return
        held = self.read(touched).join(fresh.select("dest"), "dest", "left_anti").withColumn("slot", slot_of(slots=self.slots))
        merged = materialize(held.unionByName(fresh), "manifest-slots").withColumn("run", F.lit(run))
        writer = merged.repartition("slot").write.partitionBy("slot", "run").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(f"{self.path}/slots")
        log = self.spark.range(self.slots).select(F.col("id").cast("int").alias("slot"), F.lit(run).alias("run")).where(F.col("slot").isin(touched))
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
