"""Registered queries: market, farm scoring, telemetry, farm memory, ingest and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.operators import farm, market
from fieldlake.plans.record_plans import _market_rows
from fieldlake.plans.sql import query
from fieldlake.session import table
from fieldlake.sources import lake, manifest
from fieldlake.sources.store import materialize, spread
from fieldlake.streaming import feeds

# --- market ---------------------------------------------------------------------------------


def _prices(spark, sf):
    m = _market_rows(spark, sf)
    modal = F.col("modal_price_rs_quintal")
    return m.select(
        "crop", "mandi", "district", modal,
        F.when(F.col("trend") == "A", modal * (1 + F.col("l_tax"))).alias("max_price_rs_quintal"),
        F.when(F.col("trend") == "N", modal * (1 - F.col("l_tax"))).alias("min_price_rs_quintal"),
        F.when((F.col("trend") == "R") & (F.col("crop") == "red ring"), "data.gov.in").otherwise("local").alias("source"))


PRICES_SQL = """
WITH m AS (SELECT p_name AS crop, s_name AS mandi, n_name AS district, l_extendedprice / l_quantity AS modal, l_tax, l_returnflag AS f,
  l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


@query("q_price_summary", PRICES_SQL + """
SELECT crop, round(avg(modal), 2) AS average_modal_price, max(CASE WHEN f = 'A' THEN modal * (1 + l_tax) ELSE modal END) AS highest_price,
  min(CASE WHEN f = 'N' THEN modal * (1 - l_tax) ELSE modal END) AS lowest_price, count(*) AS records,
  CASE WHEN bool_or(f = 'R' AND crop = 'red ring') THEN 'live' ELSE 'local_or_fallback' END AS source_mode FROM m GROUP BY crop""")
def price_summary(spark, sf):
    return market.price_summary(_prices(spark, sf))


@query("q_reporting_mandis", PRICES_SQL + " SELECT crop, mandi, count(*) AS reports FROM m GROUP BY ALL")
def reporting_mandis(spark, sf):
    return market.reporting_mandis(_prices(spark, sf))


@query("q_price_filter", PRICES_SQL + """
SELECT crop, district, count(*) AS n, round(min(modal), 4) AS low FROM m WHERE contains(crop, 'ring') AND contains(lower(district), 'nation_1') GROUP BY ALL""")
def price_filter(spark, sf):
    hit = market.filter_prices(_prices(spark, sf), "Ring", "NATION_1")
    return hit.groupBy("crop", "district").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("modal_price_rs_quintal"), 4).alias("low"))


@query("q_price_fallback", PRICES_SQL + " SELECT crop, count(*) AS n FROM m GROUP BY crop")
def price_fallback(spark, sf):
    hit = market.filter_prices(_prices(spark, sf), "pomegranate")
    return hit.groupBy("crop").agg(F.count(F.lit(1)).alias("n"))


@query("q_local_fallback", """
WITH s AS (SELECT s_suppkey, s_name AS mandi, n_name AS district, 'Region ' || n_regionkey AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'hit' AS kind, s_suppkey, mandi FROM s WHERE contains(lower(district), 'nation_2')
UNION ALL SELECT 'miss', s_suppkey, mandi FROM (SELECT * FROM s ORDER BY s_suppkey LIMIT 10)""")
def local_fallback(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("s_name").alias("mandi"), F.col("n_name").alias("district"), F.lit("onion").alias("crop"),
        F.concat(F.lit("Region "), "n_regionkey").alias("state"))
    hit = market.local_fallback(s, "s_suppkey", state="Maharashtra", district="nation_2")
    miss = market.local_fallback(s, "s_suppkey", state="Goa")
    return hit.select(F.lit("hit").alias("kind"), "s_suppkey", "mandi").unionByName(
        miss.select(F.lit("miss").alias("kind"), "s_suppkey", "mandi"))


@query("q_normalize_prices", """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS commodity,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE round(o_totalprice, 2) END AS modal FROM orders)
SELECT commodity, count(*) AS n, count(modal) AS priced, round(sum(modal), 1) AS total FROM n WHERE commodity IS NOT NULL GROUP BY 1""")
def normalize_prices(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("Commodity"),
        F.when(F.col("o_orderstatus") == "F", "NR").otherwise(F.format_number("o_totalprice", 2)).alias("Modal_Price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Arrival_Date"))
    n = market.normalize_prices(raw)
    return n.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("n"), F.count("modal_price_rs_quintal").alias("priced"),
        F.round(F.sum("modal_price_rs_quintal"), 1).alias("total"))


# --- scoring: customers as farms ---------------------------------------------------------------

CROP_OF = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Cotton' WHEN 'AUTOMOBILE' THEN 'Soybean' WHEN 'MACHINERY' THEN 'Pomegranate' WHEN 'HOUSEHOLD' THEN 'Onion' ELSE 'Millet' END"
FARM_SQL = f"""
WITH f AS (SELECT c_custkey AS farm_id, {CROP_OF} AS crop, abs(c_acctbal) / 1000 AS acreage, c_nationkey AS nk, c_nationkey + 20.0::DOUBLE AS t,
  c_nationkey * 4.0::DOUBLE AS h, c_nationkey * 1.5::DOUBLE AS r FROM customer)"""


def _tenth(x: str) -> str:
    """A double that is not negative to one place, half-even by its shortest decimal form; whole numbers count steps of 1e-18."""
    u = f"CAST(replace(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)) AS VARCHAR), '.', '') AS HUGEINT)"
    step, half = 10**17, 5 * 10**16
    return f"({u} // {step} + CASE WHEN {u} % {step} > {half} OR ({u} % {step} = {half} AND {u} // {step} % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE"


def _farms(spark, sf):
    seg, nk = F.col("c_mktsegment"), F.col("c_nationkey")
    crop = F.when(seg == "BUILDING", "Cotton").when(seg == "AUTOMOBILE", "Soybean").when(seg == "MACHINERY", "Pomegranate").when(
        seg == "HOUSEHOLD", "Onion").otherwise("Millet")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("farm_id"), crop.alias("crop"), (F.abs("c_acctbal") / 1000).alias("acreage"), nk.alias("nk"),
        (nk + 20.0).alias("temperature_c"), (nk * 4.0).alias("humidity_pct"), (nk * 1.5).alias("rainfall_mm"))


@query("q_yield", FARM_SQL + """,
g AS (SELECT farm_id, crop, acreage, CASE crop WHEN 'Cotton' THEN 12.0::DOUBLE WHEN 'Soybean' THEN 10.0 WHEN 'Pomegranate' THEN 60.0 WHEN 'Onion' THEN 120.0 ELSE 15.0 END AS base,
  1.0::DOUBLE + (CASE WHEN nk < 8 THEN -0.12::DOUBLE WHEN nk > 16 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN nk = 10 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN nk > 20 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN nk = 5 THEN 0.15::DOUBLE WHEN nk = 6 THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END) AS m, nk FROM f)
SELECT farm_id, crop, round_even(base * m, 2) AS yield_per_acre, round_even(round_even(base * m, 2) * acreage, 2) AS total_yield,
  CASE WHEN nk < 8 THEN 'Negative' ELSE 'Optimal' END AS nitrogen_impact FROM g""")
def yield_score(spark, sf):
    nk = F.col("nk")
    f = _farms(spark, sf).select(
        "*", F.when(nk < 8, "Deficient").when(nk > 16, "High").otherwise("Medium").alias("n_status"),
        F.when(nk == 10, "Deficient").otherwise("Medium").alias("p_status"), F.when(nk > 20, "High").otherwise("Medium").alias("k_status"),
        F.when(nk == 5, "Excellent Drip").when(nk == 6, "Rainfed").otherwise("Good").alias("irrigation"))
    return farm.score_yield(f).select("farm_id", "crop", "yield_per_acre", "total_yield", "nitrogen_impact")


@query("q_pest", FARM_SQL + """,
s AS (SELECT *, (CASE WHEN t BETWEEN 25 AND 35 THEN 35 ELSE 0 END) + (CASE WHEN h > 75 THEN 45 ELSE 0 END) + (CASE WHEN r > 5 THEN 20 ELSE 0 END) AS b,
  (CASE WHEN t BETWEEN 22 AND 32 THEN 30 ELSE 0 END) + (CASE WHEN h > 70 THEN 40 ELSE 0 END) AS w, least(95, CAST(trunc(h / 100.0 * 60 + r / 30.0 * 35) AS INTEGER)) AS g FROM f)
SELECT farm_id, 'Bacterial Blight (Telyat) / तेल्या रोग' AS disease_pest, CAST(least(98, b) AS INTEGER) AS risk_percentage,
  CASE WHEN b >= 70 THEN 'CRITICAL / HIGH RISK' WHEN b >= 40 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM s WHERE crop = 'Pomegranate'
UNION ALL SELECT farm_id, 'Pink Bollworm / गुलाबी बोंड अळी', least(95, w), CASE WHEN w >= 60 THEN 'HIGH RISK' WHEN w >= 35 THEN 'MODERATE' ELSE 'LOW' END FROM s WHERE crop = 'Cotton'
UNION ALL SELECT farm_id, 'General Fungal / Foliar Blight Risk', g, CASE WHEN g > 65 THEN 'HIGH' WHEN g > 35 THEN 'MODERATE' ELSE 'LOW' END FROM s""")
def pest_score(spark, sf):
    return farm.score_pest(_farms(spark, sf)).select("farm_id", "disease_pest", "risk_percentage", "risk_level")


@query("q_irrigation", FARM_SQL + """,
e AS (SELECT *, CASE WHEN h = 0 THEN NULL ELSE greatest(3.0, least(8.5, 0.0023::DOUBLE * (t + 17.8::DOUBLE) * sqrt(greatest(0, 35.0 - t)) * 10 / (h / 50.0::DOUBLE))) END AS eto FROM f),
c AS (SELECT *, eto * (CASE crop WHEN 'Cotton' THEN 0.85::DOUBLE WHEN 'Soybean' THEN 0.9::DOUBLE WHEN 'Pomegranate' THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END) AS etc FROM e)
SELECT farm_id, round_even(eto, 2) AS eto_mm_day, round_even(etc, 2) AS etc_mm_day, round_even(etc * 4046.86::DOUBLE, 1) AS litres_per_acre_day,
  round_even(etc * 4046.86::DOUBLE * acreage, 1) AS total_litres_day, round_even(etc * 4046.86::DOUBLE / 1600.0::DOUBLE, 2) AS drip_hours_day FROM c""")
def irrigation_score(spark, sf):
    return farm.score_irrigation(_farms(spark, sf)).select(
        "farm_id", "eto_mm_day", "etc_mm_day", "litres_per_acre_day", "total_litres_day", "drip_hours_day")


@query("q_fertilizer", FARM_SQL + """,
n AS (SELECT *, (CASE crop WHEN 'Cotton' THEN 40 WHEN 'Soybean' THEN 12 WHEN 'Pomegranate' THEN 60 WHEN 'Onion' THEN 40 ELSE 35 END)::DOUBLE
    * (CASE WHEN nk * 20 < 200 THEN 1.15::DOUBLE WHEN nk * 20 > 300 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * acreage AS n,
  (CASE crop WHEN 'Soybean' THEN 24 WHEN 'Pomegranate' THEN 25 ELSE 20 END)::DOUBLE * (CASE WHEN nk * 2 < 20 THEN 1.15::DOUBLE WHEN nk * 2 > 35 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * acreage AS p,
  (CASE crop WHEN 'Soybean' THEN 16 WHEN 'Pomegranate' THEN 50 ELSE 20 END)::DOUBLE * (CASE WHEN nk * 15 < 150 THEN 1.15::DOUBLE WHEN nk * 15 > 280 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * acreage AS k FROM f)
SELECT farm_id, """ + _tenth("n") + """ AS need_n, """ + _tenth("greatest(0.0::DOUBLE, n - p / 0.46::DOUBLE * 0.18::DOUBLE) / 0.46::DOUBLE / 45.0::DOUBLE") + """ AS urea_bags,
  """ + _tenth("p / 0.46::DOUBLE / 50.0::DOUBLE") + """ AS dap_bags, """ + _tenth("k / 0.6::DOUBLE / 50.0::DOUBLE") + """ AS mop_bags, CAST(trunc(acreage * 2.5) AS INTEGER) AS fym_tonnes FROM n""")
def fertilizer_score(spark, sf):
    nk = F.col("nk")
    f = _farms(spark, sf).select("*", (nk * 20).alias("n_kg_ha"), (nk * 2).alias("p_kg_ha"), (nk * 15).alias("k_kg_ha"))
    return farm.score_fertilizer(f).select("farm_id", "need_n", "urea_bags", "dap_bags", "mop_bags", "fym_tonnes")


@query("q_finance", """
WITH o AS (SELECT o_custkey, avg(o_totalprice) / 10 AS price, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT c_custkey AS farm_id, """ + CROP_OF + """ AS crop, abs(c_acctbal) / 1000 AS acreage, price, CASE WHEN n > 8 THEN n * 10.0::DOUBLE END AS y FROM customer LEFT JOIN o ON c_custkey = o_custkey),
g AS (SELECT *, (CASE crop WHEN 'Pomegranate' THEN 35000 WHEN 'Cotton' THEN 22000 ELSE 18000 END)::DOUBLE * acreage AS cost,
  coalesce(y, 60.0::DOUBLE * acreage) / 10.0::DOUBLE * coalesce(price, 8000.0) AS revenue FROM f)
SELECT farm_id, CAST(round_even(CAST(CAST(cost AS VARCHAR) AS DECIMAL(30, 12)), 2) AS DOUBLE) AS input_cost, CAST(round_even(CAST(CAST(revenue AS VARCHAR) AS DECIMAL(30, 12)), 2) AS DOUBLE) AS gross_revenue, CAST(round_even(CAST(CAST(revenue - cost AS VARCHAR) AS DECIMAL(30, 12)), 2) AS DOUBLE) AS net_profit FROM g""")
def finance_score(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("farm_id")).agg(
        (F.avg("o_totalprice") / 10).alias("avg_price"), F.count(F.lit(1)).alias("n"))
    f = _farms(spark, sf).join(o, "farm_id", "left").withColumn("predicted_yield", F.when(F.col("n") > 8, F.col("n") * 10.0))
    return farm.score_finance(f).select("farm_id", "input_cost", "gross_revenue", "net_profit")


# --- telemetry: events as readings ----------------------------------------------------------------

READINGS = """
WITH r AS (SELECT event_id, user_id, ts, event_type, value, least(100.0, value) AS humidity_pct, value / 4 AS moisture_pct, value / 10 + 20 AS temperature_c, value / 8 AS rainfall_mm FROM events)"""


def _with_readings(e):
    v = F.col("value")
    return e.select("event_id", "user_id", "ts", "event_type", "value", F.least(F.lit(100.0), v).alias("humidity_pct"),
                    (v / 4).alias("moisture_pct"), (v / 10 + 20).alias("temperature_c"), (v / 8).alias("rainfall_mm"))


def _readings(spark, sf):
    return _with_readings(table(spark, sf, "events"))


@query("q_telemetry_bands", READINGS + """
SELECT CASE WHEN moisture_pct < 25 THEN 'Dry (Needs Irrigation)' WHEN moisture_pct <= 35 THEN 'Optimal' ELSE 'Saturated' END AS moisture_status,
  moisture_pct < 25 AS irrigation_trigger, CASE WHEN value / 100 > 0.7 THEN 'Vigorous Healthy Vegetation' WHEN value / 100 > 0.5 THEN 'Moderate Canopy Growth / Moderate Stress'
  ELSE 'High Chlorophyll Deficit / Severe Stress' END AS crop_vigor, CASE WHEN value / 300 > 0.15 THEN 'Low' ELSE 'Moderate to High Water Deficit' END AS water_stress,
  count(*) AS n FROM r GROUP BY ALL""")
def telemetry_bands(spark, sf):
    r = _readings(spark, sf).select("*", (F.col("value") / 100).alias("ndvi"), (F.col("value") / 300).alias("ndwi"))
    b = farm.band_vegetation(farm.band_telemetry(r))
    return b.groupBy("moisture_status", "irrigation_trigger", "crop_vigor", "water_stress").agg(F.count(F.lit(1)).alias("n"))


@query("q_alerts", READINGS + """
SELECT user_id, 'IMD Advisory' AS alert, count(*) AS n FROM r WHERE humidity_pct > 80 AND temperature_c > 25 GROUP BY 1
UNION ALL SELECT user_id, 'IMD Warning', count(*) FROM r WHERE rainfall_mm > 20 GROUP BY 1""")
def alerts(spark, sf):
    a = farm.weather_alerts(_readings(spark, sf))
    return a.groupBy("user_id", F.split("alert", ":")[0].alias("alert")).agg(F.count(F.lit(1)).alias("n"))


@query("q_audit", READINGS + f""",
w AS (SELECT c_nationkey AS district, arg_max(humidity_pct, [epoch_us(ts), event_id]) AS humidity_pct FROM r JOIN customer ON user_id = c_custkey WHERE event_type = 'view' GROUP BY 1),
t AS (SELECT user_id AS farm_id, arg_max(moisture_pct, [epoch_us(ts), event_id]) AS moisture_pct FROM r WHERE event_type = 'click' GROUP BY 1),
f AS (SELECT c_custkey AS farm_id, c_nationkey AS district, {CROP_OF} AS crop FROM customer)
SELECT farm_id, 'AUTOMATED_ALERT_DISPATCH' AS action, 'HIGH' AS priority, round(humidity_pct, 4) AS level FROM f JOIN w USING (district) WHERE humidity_pct > 80
UNION ALL SELECT farm_id, 'IRRIGATION_PUMP_TRIGGER', 'MEDIUM', round(moisture_pct, 4) FROM f JOIN t USING (farm_id) WHERE moisture_pct < 25""")
def audit(spark, sf):
    r = _readings(spark, sf)
    c = table(spark, sf, "customer")
    placed = r.filter("event_type = 'view'").join(c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("district")), "user_id")
    weather = farm.latest_by(placed, "district", "ts", "event_id", "humidity_pct")
    telemetry = farm.latest_by(r.filter("event_type = 'click'").withColumnRenamed("user_id", "farm_id"), "farm_id", "ts", "event_id", "moisture_pct")
    farms = _farms(spark, sf).select("farm_id", "crop", F.col("nk").alias("district"))
    out = farm.audit(farms, weather, telemetry)
    level = F.when(F.col("priority") == "HIGH", F.col("humidity_pct")).otherwise(F.col("moisture_pct"))
    return out.select("farm_id", "action", "priority", F.round(level, 4).alias("level"))


@query("q_soil_card", r"""
WITH s AS (SELECT event_id, event_type, round(value, 1) AS v FROM events), k AS (SELECT event_id, CASE event_type WHEN 'click' THEN 7.2 ELSE v / 50 END::DOUBLE AS ph0,
  CASE event_type WHEN 'view' THEN 180.0 ELSE v END::DOUBLE AS nitrogen, v, event_type FROM s)
SELECT event_id, nitrogen, CASE WHEN nitrogen < 280 THEN 'Deficient' ELSE 'Sufficient' END AS nitrogen_status,
  CASE WHEN event_type = 'error' THEN 'Medium' WHEN v BETWEEN 11 AND 25 THEN 'Medium' WHEN v < 11 THEN 'Deficient' ELSE 'High' END AS phosphorus_status,
  'Medium' AS potassium_status, 'Neutral / Ideal' AS ph_status FROM k""")
def soil_card(spark, sf):
    e = table(spark, sf, "events")
    v = F.round("value", 1).cast("string")
    card = F.concat(
        F.lit("PH: 7.1; "), F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("nitrogen: "), v)),
        F.when(F.col("event_type") == "error", " Phosphorus: 1.2.3").otherwise(F.concat(F.lit(" kg, Phosphorus  "), v)))
    return farm.read_soil_cards(e.select("event_id", card.alias("card"))).select(
        "event_id", "nitrogen", "nitrogen_status", "phosphorus_status", "potassium_status", "ph_status")


# --- farm memory -------------------------------------------------------------------------------------

@query("q_farm_upsert", """
WITH u AS (SELECT o_custkey * 2 AS farm_id, arg_max(o_totalprice, [epoch_us(o_orderdate), o_orderkey]) AS acres, arg_max(o_orderpriority, [epoch_us(o_orderdate), o_orderkey]) FILTER (o_orderpriority <> '5-LOW') AS crop
  FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, farm_id) AS farm_id, coalesce(c_name, 'Unknown Farmer') AS farmer_name, CASE WHEN c_custkey IS NULL THEN 'Maharashtra' ELSE 'nation ' || c_nationkey END AS district,
  coalesce(acres, c_acctbal, 1.0) AS land_area_acres, coalesce(crop, c_mktsegment, '') AS current_crop
FROM customer FULL OUTER JOIN u ON c_custkey = farm_id""")
def farm_upsert(spark, sf):
    current = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("farm_id"), F.col("c_name").alias("farmer_name"), F.concat(F.lit("nation "), "c_nationkey").alias("district"),
        F.col("c_acctbal").alias("land_area_acres"), F.col("c_mktsegment").alias("current_crop"))
    updates = farm.latest_fields(_farm_updates(spark, sf), "farm_id", "o_orderdate", "o_orderkey", "land_area_acres", "current_crop")
    return farm.upsert_farms(current, updates, {
        "farmer_name": F.lit("Unknown Farmer"), "district": F.lit("Maharashtra"), "land_area_acres": F.lit(1.0), "current_crop": F.lit("")})


def _farm_updates(spark, sf):
    """Orders as farm updates; those of the lowest priority do not give a crop."""
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("farm_id"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("land_area_acres"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("current_crop"))


@query("q_stream_upsert", """
SELECT o_custkey * 2 AS farm_id, arg_max(o_totalprice, [epoch_us(o_orderdate), o_orderkey]) AS land_area_acres,
  arg_max(o_orderpriority, [epoch_us(o_orderdate), o_orderkey]) FILTER (o_orderpriority <> '5-LOW') AS current_crop FROM orders GROUP BY 1""")
def stream_upsert(spark, sf):
    base, fields = feeds.sink_folder(spark, "upsert"), ["land_area_acres", "current_crop"]
    updates = feeds.replayed(_farm_updates(spark, sf), "o_orderdate", 3, "orders")
    feeds.upsert_fields(updates, "farm_id", "o_orderdate", "o_orderkey", fields, f"{base}/state", f"{base}/progress")
    return feeds.read_fields(spark, f"{base}/state", "farm_id", fields)


@query("q_action_log", """
SELECT o_custkey AS farm_id, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS date, o_orderpriority AS type, 'Order ' || o_orderkey AS details
FROM orders JOIN customer ON c_custkey = o_custkey""")
def action_log(spark, sf):
    o = table(spark, sf, "orders").withColumn("farm_id", F.col("o_custkey"))
    log = farm.log_entries(o, F.col("o_orderdate"), F.col("o_orderpriority"), F.concat(F.lit("Order "), "o_orderkey"))
    return farm.read_log(log, table(spark, sf, "customer").select(F.col("c_custkey").alias("farm_id")))


# --- registry and ingest: a source of documents as a registry row, a document as a file ------------------

LANG_DOMAIN = "CASE lang WHEN 'en' THEN 'crop' WHEN 'fr' THEN 'soil' WHEN 'de' THEN 'market' ELSE 'outside' END"


def _domain():
    lang = F.col("lang")
    return F.when(lang == "en", "crop").when(lang == "fr", "soil").when(lang == "de", "market").otherwise("outside")


def _registry(spark, sf):
    d = table(spark, sf, "documents").select("source", _domain().alias("domain"))
    # At most four domains per source, so the collected set is bounded.
    grouped = d.groupBy(F.col("source").alias("id")).agg(
        F.max("domain").alias("domain"), F.array_sort(F.collect_set("domain")).alias("also_domains"))
    return grouped.withColumns({
        "type": F.when(F.col("id").endswith("9"), "http_api").otherwise("local_file"), "enabled": ~F.col("id").endswith("5")})


REG = f"reg AS (SELECT source AS id, max({LANG_DOMAIN}) AS domain, list_sort(list(DISTINCT {LANG_DOMAIN})) AS also, CASE WHEN source LIKE '%9' THEN 'http_api' ELSE 'local_file' END AS type, source NOT LIKE '%5' AS enabled FROM documents GROUP BY 1)"


@query("q_registry_fanout", f"""WITH {REG}, x AS (SELECT id, domain, unnest(also) AS lake_domain FROM reg WHERE enabled)
SELECT id, lake_domain, CAST(CASE WHEN lake_domain = domain THEN 0 ELSE row_number() OVER (PARTITION BY id, lake_domain = domain ORDER BY lake_domain) END AS INTEGER) AS domain_pos FROM x""")
def registry_fanout(spark, sf):
    return lake.fan_out(lake.enabled_sources(_registry(spark, sf))).select("id", "lake_domain", "domain_pos")


@query("q_registry_summary", f"""WITH {REG}
SELECT 'type' AS dimension, type AS value, count(*) AS n FROM reg GROUP BY 2
UNION ALL SELECT 'domain', d, count(*) FROM (SELECT unnest(also) AS d FROM reg) GROUP BY 2
UNION ALL SELECT 'sources', 'total', count(*) FROM reg UNION ALL SELECT 'sources', 'enabled', count(*) FILTER (enabled) FROM reg""")
def registry_summary(spark, sf):
    return lake.registry_summary(_registry(spark, sf))


def _plan(spark, sf):
    d = spread(table(spark, sf, "documents")).select(
        F.col("source").alias("source_id"), _domain().alias("domain"), F.concat(F.lit("raw/"), "doc_id").alias("dest"), "doc_id",
        F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"),
        F.col("text").alias("payload"))
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    known = d.join(lab, "doc_id").select("dest", F.when(F.col("quality") == 1, F.col("sha256")).otherwise("old").alias("sha256"))
    return lake.ingest_plan(d, known)


PLAN = f"""plan AS (SELECT d.doc_id, source, CASE WHEN text IS NULL THEN 'missing' WHEN {LANG_DOMAIN} = 'outside' THEN 'error'
  WHEN l.quality = 1 THEN 'skipped_identical' ELSE 'copied' END AS action, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("q_ingest_plan", f"WITH {PLAN} SELECT doc_id, source AS source_id, action FROM plan")
def ingest_plan(spark, sf):
    return _plan(spark, sf).select("doc_id", "source_id", "action")


@query("q_ingest_counters", f"""WITH {PLAN} SELECT count(*) FILTER (action = 'copied') AS copied, count(*) FILTER (action = 'skipped_identical') AS skipped,
  count(*) FILTER (action IN ('missing', 'error')) AS failed, count(DISTINCT source) AS sources_considered, FALSE AS ok FROM plan""")
def ingest_counters(spark, sf):
    return lake.ingest_counters(_plan(spark, sf))


@query("q_manifest_rerun", f"""WITH {PLAN} SELECT CASE WHEN action = 'copied' THEN 'skipped_identical' WHEN action = 'skipped_identical' THEN 'copied' ELSE action END AS action, count(*) AS n
FROM plan GROUP BY 1""")
def manifest_rerun(spark, sf):
    """Copy the files of a run, append its manifest and plan again: what was copied is now skipped."""
    base = feeds.sink_folder(spark, "manifest")
    path = f"{base}/files"
    plan = _plan(spark, sf)
    lake.copy_files(plan, f"{base}/payloads", "first")
    lake.append_manifest(plan, path, "first")
    again = lake.ingest_plan(_plan(spark, sf).drop("action"), lake.read_manifest(spark, path))
    return again.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("q_tree_summary", f"""WITH f AS (SELECT {LANG_DOMAIN} AS domain, doc_id, n_chars AS bytes, row_number() OVER (PARTITION BY {LANG_DOMAIN} ORDER BY doc_id) AS rank,
  count(*) OVER (PARTITION BY {LANG_DOMAIN}) AS domain_files FROM documents) SELECT domain, CAST(rank AS INTEGER) AS rank, doc_id, bytes, domain_files FROM f WHERE rank <= 20""")
def tree_summary(spark, sf):
    files = table(spark, sf, "documents").select(_domain().alias("domain"), "doc_id", F.col("n_chars").alias("bytes"))
    return lake.tree_summary(files, 20, "doc_id")


@query("q_layer_stats", """SELECT CASE WHEN l.doc_id IS NULL THEN 'raw' WHEN quality = 1 THEN 'processed' ELSE 'quarantine' END AS layer, count(*) AS files,
  CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def layer_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("bytes"))
    j = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    layer = F.when(F.col("quality").isNull(), "raw").when(F.col("quality") == 1, "processed").otherwise("quarantine")
    return lake.layer_stats(j, layer)


RUN = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10"


@query("q_ingest_revert", f"""
WITH f AS (SELECT {RUN} AS run, event_type || '/' || user_id AS dest, event_id, sha256(props) AS h FROM events),
a AS (SELECT *, CASE WHEN h = lag(h) OVER (PARTITION BY dest ORDER BY run, event_id) THEN 'skipped_identical' ELSE 'copied' END AS action FROM f)
SELECT CAST(run AS VARCHAR) AS run, dest, count(*) FILTER (action = 'copied') AS copied, count(*) FILTER (action = 'skipped_identical') AS skipped,
  arg_max(h, event_id) AS sha256 FROM a GROUP BY ALL""")
def ingest_revert(spark, sf):
    """Events as versions of files in three runs, several contents of a place in a run; the manifest after each."""
    run = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 10).cast("string")
    files = table(spark, sf, "events").select(
        run.alias("run"), F.lit("events").alias("source_id"), F.lit("general").alias("domain"), F.concat_ws("/", "event_type", "user_id").alias("dest"),
        F.sha2("props", 256).alias("sha256"), F.length("props").alias("bytes"), "event_id")
    held = manifest.Manifest(spark, feeds.sink_folder(spark, "keyed-manifest"))
    out = None
    for name in sorted(r[0] for r in files.select("run").distinct().collect()):  # one per ten days
        plan = materialize(held.plan(files.where(F.col("run") == name), "event_id"), "ingest-plan")
        held.commit(plan, "event_id", name)
        counts = plan.groupBy("run", "dest").agg(F.count_if(F.col("action") == "copied").alias("copied"), F.count_if(F.col("action") == "skipped_identical").alias("skipped"))
        after = counts.join(materialize(held.read().select("dest", "sha256"), "manifest-now"), "dest")
        out = after if out is None else out.unionByName(after)
    return out.select("run", "dest", "copied", "skipped", "sha256")


# --- streams over the event files -----------------------------------------------------------------------


def _stream(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    return feeds.read_feed(spark, path, spark.read.parquet(path).schema)


@query("q_stream_alerts", READINGS + """
SELECT event_id, 'fungal_risk' AS alert FROM r WHERE humidity_pct > 80 AND temperature_c > 25
UNION ALL SELECT event_id, 'heavy_rain' FROM r WHERE rainfall_mm > 20 UNION ALL SELECT event_id, 'dry_soil' FROM r WHERE moisture_pct < 25""")
def stream_alerts(spark, sf):
    out = feeds.telemetry_alerts(_with_readings(_stream(spark, sf))).select("event_id", "alert")
    return feeds.run_once(out, feeds.sink_folder(spark, "alerts"))


@query("q_stream_audit", READINGS + """
SELECT event_id, 'AUTOMATED_ALERT_DISPATCH' AS action FROM r JOIN customer ON c_custkey = user_id WHERE humidity_pct > 80
UNION ALL SELECT event_id, 'IRRIGATION_PUMP_TRIGGER' FROM r JOIN customer ON c_custkey = user_id WHERE moisture_pct < 25""")
def stream_audit(spark, sf):
    r = _with_readings(_stream(spark, sf)).withColumnRenamed("user_id", "farm_id")
    out = feeds.audit_stream(r, _farms(spark, sf).select("farm_id", "crop")).select("event_id", "action")
    return feeds.run_once(out, feeds.sink_folder(spark, "audit"))


@query("q_stream_windows", """
WITH w AS (SELECT user_id, TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(28, 6)) AS v, time_bucket(INTERVAL 1 DAY, ts) - to_days(k) AS s FROM events, (VALUES (0), (1)) v(k)),
g AS (SELECT user_id, s, count(*) AS n, count(v) AS m, CAST(replace(CAST(sum(v) AS VARCHAR), '.', '') AS HUGEINT) AS u FROM w
  WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id, s),
a AS (SELECT *, sign(u) * ((20000 * abs(u) + m) // (2 * m)) AS x FROM g WHERE m > 0)
SELECT user_id, strftime(s, '%Y-%m-%d') AS day, n, sign(x) * ((abs(x) + 5000) // 10000) / 1e6::DOUBLE AS avg_value FROM a WHERE x > 40 * 10000000000""")
def stream_windows(spark, sf):
    """Readings count in millionths, so sums are exact and an average's ties go up on every run; ten places of it are compared with 40."""
    e = _stream(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.col("value").try_cast("decimal(28, 6)")})
    out = feeds.sustained(e, "user_id", "ts", "value", 40.0)
    done = feeds.run_once(out, feeds.sink_folder(spark, "windows"))
    return done.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", F.round("avg_value", 6).cast("double").alias("avg_value"))


@query("q_stream_ttl", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, ts FROM events),
a AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL
  UNION ALL SELECT a.user_id, a.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 1 DAY)
  FROM a WHERE a.ts IS NOT NULL)
SELECT user_id, event_type, epoch_us(ts) AS answered_us FROM a WHERE ts <= (SELECT epoch_ms(epoch_ms(max(ts))) FROM events) - INTERVAL 1 HOUR""")
def stream_ttl(spark, sf):
    """Each answer holds for a day from when it was given; requests of the last hour still wait for late ones."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = feeds.first_answers(feeds.replayed(e, "ts", 3, "requests"), ["user_id", "event_type"], "ts", 86_400, "1 hour")
    done = feeds.run_once(out, feeds.sink_folder(spark, "ttl"))
    return done.select("user_id", "event_type", F.unix_micros("answered_at").alias("answered_us"))


@query("q_stream_sustained", """
WITH h AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE value > 10),
g AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > INTERVAL 1 DAY) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM h),
s AS (SELECT user_id, min(ts) AS a, max(ts) AS b, min(value) AS min_value, count(*) AS n FROM g GROUP BY user_id, spell)
SELECT user_id, epoch_us(a) AS first_us, epoch_us(b) AS last_us, min_value, n FROM s
WHERE b >= a + INTERVAL 2 DAY AND b + INTERVAL 1 DAY <= (SELECT epoch_ms(epoch_ms(max(ts))) FROM events) - INTERVAL 1 DAY""")
def stream_sustained(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = feeds.sustained_runs(feeds.replayed(e, "ts", 3, "readings"), "user_id", "ts", "value", 10.0)
    done = feeds.run_once(out, feeds.sink_folder(spark, "sustained"))
    return done.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "min_value", "n")


@query("q_stream_ingest", """SELECT event_type AS domain, count(*) AS files FROM (SELECT DISTINCT event_type, user_id, sha256(props) AS h FROM events) GROUP BY 1""")
def stream_ingest(spark, sf):
    """Files arriving as a stream land in the manifest once per place and content."""
    base = feeds.sink_folder(spark, "stream-ingest")
    files = _stream(spark, sf).select(
        F.lit("events").alias("source_id"), F.lit("general").alias("domain"),
        F.concat_ws("/", "event_type", "user_id").alias("dest"), F.sha2("props", 256).alias("sha256"),
        F.length("props").alias("bytes"), F.col("props").alias("payload")).dropDuplicates(["dest", "sha256"])
    feeds.ingest_new(files, f"{base}/manifest", f"{base}/progress", f"{base}/payloads")
    m = lake.read_manifest(spark, f"{base}/manifest")
    return m.groupBy(F.split("dest", "/")[0].alias("domain")).agg(F.count(F.lit(1)).alias("files"))


@query("q_stream_log", "SELECT user_id AS farm_id, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def stream_log(spark, sf):
    base = feeds.sink_folder(spark, "stream-log")
    e = _stream(spark, sf).withColumnRenamed("user_id", "farm_id")
    entries = farm.log_entries(e, F.col("ts"), F.col("event_type"), F.col("props"))
    feeds.append_log(entries, f"{base}/log", f"{base}/progress")
    return spark.read.parquet(f"{base}/log").groupBy("farm_id", "type").agg(F.count(F.lit(1)).alias("n"))
