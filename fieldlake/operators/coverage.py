"""Coverage statistics of standard records. Every statistic is an aggregation with a
map-side partial step; nothing groups raw rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from fieldlake.functions import text as T
from fieldlake.sources.store import materialize

# The lower ends of the length bins; the last one is open.
LENGTH_BINS = [0, 50, 100, 200, 400, 800, 1600, 10_000]
RECORD_FIELDS = [
    "id", "category", "subcategory", "crop", "language", "question", "answer", "source",
    "split", "schema_version", "region", "confidence", "verified",
]


def is_missing(name: str, dt: ty.DataType) -> Column:
    """Null, empty string, empty list or empty object; False and 0 are values."""
    c = F.col(name)
    if isinstance(dt, ty.StringType):
        return c.isNull() | (c == "")
    if isinstance(dt, (ty.ArrayType, ty.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def missingness(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, missing, missing_pct) in one pass over the records."""
    types = {f.name: f.dataType for f in records.schema.fields}
    fields = fields or [f for f in RECORD_FIELDS if f in types]
    wide = records.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(is_missing(f, types[f])).alias(f) for f in fields]
    )
    return wide.unpivot(["_n"], fields, "field", "missing").select(
        "field", "missing",
        F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("missing"), F.col("_n")), 2), F.lit(0.0)).alias("missing_pct"),
    )


def value_counts(records: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    value = F.col(column).cast("string")
    return records.groupBy(
        F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value).alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))


def balance(records: DataFrame, columns: list[str], default: str = "unknown") -> DataFrame:
    """(dimension, value, n) for several columns in one pass (grouping sets)."""
    def val(c):
        v = F.col(c).cast("string")
        return F.when(F.coalesce(v, F.lit("")) == "", default).otherwise(v).alias(c)

    base = records.select(*[val(c) for c in columns])
    grouped = base.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    top = (1 << len(columns)) - 1
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        gid = top ^ (1 << (len(columns) - 1 - i))
        dimension = F.when(F.col("g") == gid, c).otherwise(dimension)
        value = F.when(F.col("g") == gid, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def length_frequencies(records: DataFrame, columns: list[str]) -> DataFrame:
    """(field, len, freq): how often each length occurs; all length statistics start here."""
    lens = records.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.length(F.coalesce(F.col(c), F.lit(""))).alias("len"))
        for c in columns
    ])).alias("x")).select("x.*")
    return lens.groupBy("field", "len").agg(F.count(F.lit(1)).alias("freq"))


def length_stats(records: DataFrame, columns: list[str]) -> DataFrame:
    """min / max / mean / p50 / p90 per field; percentiles interpolate and are exact.

    Percentiles run over the length frequencies, whose number of rows is bounded by the
    longest text and not by the number of records.
    """
    f = length_frequencies(records, columns)
    return f.groupBy("field").agg(
        F.min("len").alias("min"), F.max("len").alias("max"),
        F.round(F.sum(F.col("len") * F.col("freq")) / F.sum("freq"), 1).alias("mean"),
        F.percentile("len", 0.5, F.col("freq")).alias("p50"),
        F.percentile("len", 0.9, F.col("freq")).alias("p90"),
    )


def histogram(records: DataFrame, columns: list[str], bins: list[int] | None = None) -> DataFrame:
    """(field, bin, n) with a row for every bin, also for empty ones; values outside count
    in the last, open bin."""
    bins = bins or LENGTH_BINS
    labels = [f"{a}-{b - 1}" for a, b in zip(bins, bins[1:])] + [f"{bins[-1]}+"]
    f = length_frequencies(records, columns)
    hits = [
        F.coalesce(
            F.sum(F.when((F.col("len") >= a) & (F.col("len") < b), F.col("freq"))), F.lit(0)
        ).alias(label)
        for a, b, label in zip(bins, bins[1:], labels)
    ]
    outside = (F.col("len") < bins[0]) | (F.col("len") >= bins[-1])
    hits.append(F.coalesce(F.sum(F.when(outside, F.col("freq"))), F.lit(0)).alias(labels[-1]))
    return f.groupBy("field").agg(*hits).unpivot(["field"], labels, "bin", "n")


#: Accuracy of profiles: 2^HLL_BITS registers, KLL_SIZE items a level.
HLL_BITS, KLL_SIZE = 12, 200


def profile_parts(records: DataFrame, column: str, *by: str) -> DataFrame:
    """Mergeable profile of a text column per part: rows, a sketch of its values and one of its lengths.

    A part's row has a bounded size whatever its number of records, so parts (a day, a source) are
    kept and merged later instead of being read again. Nulls count as rows only.
    """
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(column, HLL_BITS).alias("values"),
        F.kll_sketch_agg_bigint(F.length(column).cast("long"), KLL_SIZE).alias("lengths"))


def merge_profiles(parts: DataFrame, *by: str) -> DataFrame:
    """Profiles of the unions of parts, per `by` or of everything."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_bigint("lengths").alias("lengths"))


def profile_estimates(profiles: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """n, distinct values and length quantiles (p50, p90, ...) that profiles estimate; quantiles are null without lengths."""
    kept = [c for c in profiles.columns if c not in ("values", "lengths", "n")]
    some = F.kll_sketch_get_n_bigint("lengths") > 0
    return profiles.select(
        *kept, "n", F.hll_sketch_estimate("values").alias("distinct"),
        *[F.when(some, F.kll_sketch_get_quantile_bigint("lengths", F.lit(r))).alias(f"p{round(r * 100)}") for r in ranks])


def top_values(records: DataFrame, column: str, n: int, default: str = "(none)") -> DataFrame:
    """The n most frequent values, ties by value."""
    return value_counts(records, column, default).orderBy(F.desc("n"), "value").limit(n)


def distinct_values(records: DataFrame, column: str, default: str = "(none)") -> DataFrame:
    return value_counts(records, column, default).agg(F.count(F.lit(1)).alias("distinct_values"))


def confidence_stats(records: DataFrame, column: str = "confidence") -> DataFrame:
    """mean / min / max; a value that is no number counts as 0."""
    v = F.coalesce(F.col(column).try_cast("double"), F.lit(0.0))
    return records.agg(
        F.round(F.avg(v), 3).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def duplicate_rate(records: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Exact question+answer repeats, white space and case ignored."""
    def norm(c):
        return F.lower(T.strip(F.coalesce(F.col(c), F.lit(""))))

    key = F.sha2(F.to_json(F.struct(norm(answer).alias("a"), norm(question).alias("q"))), 256)
    per_key = records.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_qa")
    ).select(
        "total", "unique_qa",
        (F.col("total") - F.col("unique_qa")).alias("exact_qa_duplicates"),
        F.coalesce(
            F.round(F.try_divide(100.0 * (F.col("total") - F.col("unique_qa")), F.col("total")), 2), F.lit(0.0)
        ).alias("duplicate_rate_pct"),
    )


def language_distribution(records: DataFrame) -> DataFrame:
    """Counts by language tag; rows without one are detected from question and answer."""
    both = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))
    tag = F.when(F.coalesce("language", F.lit("")) != "", F.col("language")).otherwise(T.detect_language(both))
    return records.groupBy(tag.alias("language")).agg(F.count(F.lit(1)).alias("n"))


def coverage_stats(records: DataFrame) -> DataFrame:
    """Share of records with a known language and a category, and the export gate."""
    pct = lambda c: F.coalesce(F.round(F.try_divide(100.0 * F.col(c), F.col("total")), 2), F.lit(0.0))
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("language", F.lit("unknown")) != "unknown").alias("with_language"),
        F.count_if(F.coalesce("category", F.lit("")) != "").alias("with_category"),
    ).select(
        "*", pct("with_language").alias("language_pct"), pct("with_category").alias("category_pct")
    ).withColumn("ok", (F.col("total") > 0) & (F.col("language_pct") >= 90) & (F.col("category_pct") >= 90))


def normalize_metrics(records: DataFrame) -> DataFrame:
    """Records and records with a crop, per category."""
    return records.groupBy("category").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.coalesce("crop", F.lit("")) != "").alias("with_crop"),
    )


def gaps(
    wanted: DataFrame, present: DataFrame, kind: str, severity: str, limit: int | None = None
) -> DataFrame:
    """Catalogue ids that no record carries, as (type, id, severity) rows.

    Both inputs have one `id` column. `limit` reports only the first ids in order.
    """
    lost = wanted.select("id").distinct().join(present.select("id"), "id", "left_anti")
    if limit is not None:
        lost = lost.orderBy("id").limit(limit)
    return lost.select(F.lit(kind).alias("type"), "id", F.lit(severity).alias("severity"))


def extras(wanted: DataFrame, present: DataFrame, kind: str) -> DataFrame:
    """Ids that occur in records but not in the catalogue."""
    more = present.select("id").filter("id IS NOT NULL").distinct().join(wanted.select("id"), "id", "left_anti")
    return more.select(F.lit(kind).alias("type"), "id", F.lit("extra").alias("severity"))


def volume_gap(records: DataFrame, column: str, value: str, at_least: int) -> DataFrame:
    """One gap row when fewer than `at_least` records carry `value`."""
    n = records.agg(F.count_if(F.col(column) == value).alias("n"))
    return n.filter(F.col("n") < at_least).select(
        F.lit("volume").alias("type"), F.lit(value).alias("id"), F.lit("medium").alias("severity")
    )


def leakage(records: DataFrame, fact_key: str = "fact_key", split: str = "split") -> DataFrame:
    """Fact families that occur in more than one split; an empty result means no leakage."""
    return records.groupBy(fact_key).agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count(F.lit(1)).alias("n")
    ).filter("first_split <> last_split")


def review_sample(records: DataFrame, stratum: str, order_col: str, sample_n: int) -> DataFrame:
    """The first max(1, sample_n div strata) rows of every stratum, at most sample_n in all.

    row_number with an upper bound is a group limit: each task keeps sample_n rows per
    stratum before the shuffle. What remains is small and still has every stratum, so the
    share per stratum is counted there and the records are read once.
    """
    w = Window.partitionBy(stratum).orderBy(order_col)
    ranked = records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample_n)
    ranked = materialize(ranked, "review")
    share = ranked.agg(F.count_distinct(stratum).alias("n")).select(
        F.greatest(F.lit(1), F.floor(F.lit(sample_n) / F.greatest(F.lit(1), "n"))).alias("per")
    )
    return ranked.filter(F.col("_rn") <= share.scalar()).drop("_rn").orderBy(stratum, order_col).limit(sample_n)


def analysis_report(records: DataFrame, wanted_crops: DataFrame, wanted_categories: DataFrame) -> DataFrame:
    """The assembled report in long form: (section, item, value), ready to write as JSON."""
    def section(df: DataFrame, name: str, item: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))

    crops = records.select(F.col("crop").alias("id")).filter("id IS NOT NULL")
    cats = records.select(F.col("category").alias("id"))
    lost = gaps(wanted_crops, crops, "crop", "medium").unionByName(gaps(wanted_categories, cats, "category", "high"))
    balanced = balance(records, ["language", "category", "split"])
    lengths = length_stats(records, ["question", "answer"]).unpivot(
        ["field"], [F.col(c).cast("double").alias(c) for c in ("min", "max", "mean", "p50", "p90")], "stat", "value")
    duplicates = duplicate_rate(records).select(F.col("exact_qa_duplicates").cast("double").alias("n"), "total")
    parts = [
        section(duplicates, "records", F.lit("total"), F.col("total")),
        section(duplicates, "duplicates", F.lit("exact_qa_duplicates"), F.col("n")),
        section(missingness(records), "missing", F.col("field"), F.col("missing")),
        section(balanced, "balance", F.concat_ws(":", "dimension", "value"), F.col("n")),
        section(lengths, "length", F.concat_ws(":", "field", "stat"), F.col("value")),
        section(lost, "gap", F.concat_ws(":", "type", "id"), F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
