"""Market price rows: normalisation, filters with fallback, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which feeds carry a field, best first.
PRICE_FIELDS = {
    "commodity": ["commodity", "crop"],
    "market": ["market", "mandi"],
    "state": ["state"],
    "district": ["district"],
    "variety": ["variety"],
    "arrival_date": ["arrival_date", "date"],
    "min_price_rs_quintal": ["min_price", "min_price_rs_quintal"],
    "max_price_rs_quintal": ["max_price", "max_price_rs_quintal"],
    "modal_price_rs_quintal": ["modal_price", "modal_price_rs_quintal"],
}


def parse_number(c: Column) -> Column:
    """A number with thousands commas; anything else is null."""
    return F.btrim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def normalize_prices(rows: DataFrame) -> DataFrame:
    """Feed rows with any column casing to fixed names; rows naming neither commodity nor
    market are dropped."""
    by_low = {c.lower(): c for c in rows.columns}
    out = []
    for name, options in PRICE_FIELDS.items():
        found = next((by_low[o] for o in options if o in by_low), None)
        c = F.col(found).cast("string") if found else F.lit(None).cast("string")
        out.append((parse_number(c) if name.endswith("_quintal") else c).alias(name))
    named = (F.coalesce("commodity", F.lit("")) != "") | (F.coalesce("market", F.lit("")) != "")
    return rows.select(*out).filter(named).withColumn("source", F.lit("data.gov.in"))


def filter_prices(prices: DataFrame, crop: str | None = None, district: str | None = None) -> DataFrame:
    """Rows by crop and district substring; a filter without any match returns all rows.

    The miss test is a scalar subquery inside the plan: no second job, no driver round trip.
    """
    hit = F.lit(True)
    if crop:
        hit = hit & F.contains(F.lower("crop"), F.lit(crop.lower()))
    if district:
        hit = hit & F.contains(F.lower("district"), F.lit(district.lower()))
    if not crop and not district:
        return prices
    matches = prices.filter(hit).agg(F.count(F.lit(1)).alias("n"))
    return prices.filter(hit | (matches.scalar() == 0))


def local_fallback(
    prices: DataFrame, order_col: str, state: str | None = None, district: str | None = None,
    commodity: str | None = None,
) -> DataFrame:
    """Rows by state, district and crop substring, else the first ten rows.

    A state filter for Maharashtra (or "all") never excludes rows.
    """
    hit = F.lit(True)
    if state and state.lower() not in ("maharashtra", "all"):
        hit = hit & F.contains(F.lower("state"), F.lit(state.lower()))
    if district:
        hit = hit & F.contains(F.lower("district"), F.lit(district.lower()))
    if commodity:
        hit = hit & F.contains(F.lower("crop"), F.lit(commodity.lower()))
    matched = prices.filter(hit)
    heads = prices.orderBy(order_col).limit(10)
    misses = matched.agg(F.count(F.lit(1)).alias("n"))
    return matched.unionByName(heads.filter(misses.scalar() == 0))


def price_summary(prices: DataFrame, *by: str) -> DataFrame:
    """Average modal, highest and lowest price, rows and source mode per crop."""
    modal = F.col("modal_price_rs_quintal")
    p = prices.filter(modal.isNotNull())
    return p.groupBy(*(by or ("crop",))).agg(
        F.round(F.avg(modal), 2).alias("average_modal_price"),
        F.max(F.coalesce(F.nullif("max_price_rs_quintal", F.lit(0.0)), modal)).alias("highest_price"),
        F.min(F.coalesce(F.nullif("min_price_rs_quintal", F.lit(0.0)), modal)).alias("lowest_price"),
        F.count(F.lit(1)).alias("records"),
        F.when(F.bool_or(F.col("source") == "data.gov.in"), "live").otherwise("local_or_fallback").alias("source_mode"),
    )


def reporting_mandis(prices: DataFrame) -> DataFrame:
    """(crop, mandi, reports): which markets report a crop, as rows instead of one list."""
    return prices.filter("modal_price_rs_quintal IS NOT NULL").groupBy("crop", "mandi").agg(
        F.count(F.lit(1)).alias("reports"))
