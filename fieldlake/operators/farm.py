"""Farm scoring, telemetry rules, audits and farm memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.operators.synth import render

# Base yield per acre and unit by crop.
BASE_YIELD = {
    "cotton": (12.0, "Quintals"),
    "soybean": (10.0, "Quintals"),
    "sugarcane": (450.0, "Quintals (45 Tonnes)"),
    "pomegranate": (60.0, "Quintals (6 Tonnes)"),
    "onion": (120.0, "Quintals (12 Tonnes)"),
}
DEFAULT_YIELD = (15.0, "Quintals")
# Crop coefficients, N/P/K need per acre, cost per acre.
CROP_COEFFICIENT = {"cotton": 0.85, "soybean": 0.90, "sugarcane": 1.15, "pomegranate": 0.75, "onion": 0.80}
NPK_NEED = {
    "cotton": (40, 20, 20), "soybean": (12, 24, 16), "sugarcane": (100, 45, 45),
    "pomegranate": (60, 25, 50), "onion": (40, 20, 20),
}
DEFAULT_NPK = (35, 20, 20)
LITRES_PER_MM_ACRE = 4046.86


def _by_crop(values: dict, default) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.lower("crop")), F.lit(default))


def score_yield(farms: DataFrame) -> DataFrame:
    """Yield from crop, acreage, n_status, p_status, k_status and irrigation."""
    factor = (
        F.lit(1.0)
        + F.when(F.col("n_status") == "Deficient", -0.12).when(F.col("n_status") == "High", 0.05).otherwise(0.0)
        + F.when(F.col("p_status") == "Deficient", -0.10).otherwise(0.0)
        + F.when(F.col("k_status") == "High", 0.08).otherwise(0.0)
        + F.when(F.col("irrigation") == "Excellent Drip", 0.15).when(F.col("irrigation") == "Rainfed", -0.25)
        .otherwise(0.0)
    )
    base = _by_crop({k: v[0] for k, v in BASE_YIELD.items()}, DEFAULT_YIELD[0])
    unit = _by_crop({k: v[1] for k, v in BASE_YIELD.items()}, DEFAULT_YIELD[1])
    return farms.withColumn("yield_per_acre", F.bround(base * factor, 2)).select(
        "*",
        F.bround(F.col("yield_per_acre") * F.col("acreage"), 2).alias("total_yield"),
        unit.alias("unit"),
        F.when(F.col("n_status") == "Deficient", "Negative").otherwise("Optimal").alias("nitrogen_impact"),
    )


def _level(score: Column, high: int, moderate: int, name: str) -> Column:
    return F.when(score >= high, name).when(score >= moderate, "MODERATE").otherwise("LOW")


def score_pest(readings: DataFrame) -> DataFrame:
    """1..2 risk rows per reading (crop, temperature_c, humidity_pct, rainfall_mm)."""
    temp, hum, rain = F.col("temperature_c"), F.col("humidity_pct"), F.col("rainfall_mm")
    crop = F.lower("crop")

    def points(cond, n):
        return F.when(cond, n).otherwise(0)

    blight = points(temp.between(25, 35), 35) + points(hum > 75, 45) + points(rain > 5.0, 20)
    worm = points(temp.between(22, 32), 30) + points(hum > 70, 40)
    fungal = F.least(F.lit(95), (hum / 100.0 * 60 + rain / 30.0 * 35).cast("int"))

    def risk(name, pct, level, advice):
        return F.struct(
            F.lit(name).alias("disease_pest"), pct.alias("risk_percentage"), level.alias("risk_level"),
            F.lit(advice).alias("advisory"))

    rows = F.array(
        F.when(F.contains(crop, F.lit("pomegranate")), risk(
            "Bacterial Blight (Telyat) / तेल्या रोग", F.least(F.lit(98), blight),
            _level(blight, 70, 40, "CRITICAL / HIGH RISK"),
            "Perform preventative spray of Copper Oxychloride (2g/L) + Streptocycline immediately if humidity stays >80%.")),
        F.when(F.contains(crop, F.lit("cotton")), risk(
            "Pink Bollworm / गुलाबी बोंड अळी", F.least(F.lit(95), worm), _level(worm, 60, 35, "HIGH RISK"),
            "Install Pheromone Traps (5/acre) to monitor moth counts.")),
        risk("General Fungal / Foliar Blight Risk", fungal,
             F.when(fungal > 65, "HIGH").when(fungal > 35, "MODERATE").otherwise("LOW"),
             "Ensure clear field drainage and avoid overhead foliage wetting."),
    )
    return readings.select("*", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("*", "r.*").drop("r")


def score_irrigation(farms: DataFrame, litres_per_plant: float = 4.0, plants_per_acre: int = 400) -> DataFrame:
    """Evapotranspiration, litres and drip hours from crop, acreage, temperature and humidity.

    Zero humidity gives nulls. Above 35 degrees the temperature span counts as zero.
    """
    t = F.col("temperature_c")
    raw = F.try_divide(
        0.0023 * (t + 17.8) * F.sqrt(F.greatest(F.lit(0.0), 35.0 - t)) * 10, F.col("humidity_pct") / 50.0)
    eto = F.when(raw.isNotNull(), F.greatest(F.lit(3.0), F.least(F.lit(8.5), raw)))
    df = farms.withColumn("_eto", eto).withColumn("_etc", F.col("_eto") * _by_crop(CROP_COEFFICIENT, 0.80))
    litres = F.col("_etc") * LITRES_PER_MM_ACRE
    return df.select(
        "*",
        F.bround("_eto", 2).alias("eto_mm_day"), F.bround("_etc", 2).alias("etc_mm_day"),
        F.bround(litres, 1).alias("litres_per_acre_day"),
        F.bround(litres * F.col("acreage"), 1).alias("total_litres_day"),
        F.bround(litres / (plants_per_acre * litres_per_plant), 2).alias("drip_hours_day"),
    ).drop("_eto", "_etc")


def score_fertilizer(farms: DataFrame) -> DataFrame:
    """Bags of urea, DAP and MOP from crop, acreage and soil N/P/K per hectare."""
    def need(i, soil, low, high):
        rate = _by_crop({k: float(v[i]) for k, v in NPK_NEED.items()}, float(DEFAULT_NPK[i]))
        credit = F.when(F.col(soil) < low, 1.15).when(F.col(soil) > high, 0.85).otherwise(1.0)
        return rate * credit * F.col("acreage")

    df = farms.withColumns({
        "_n": need(0, "n_kg_ha", 200, 300), "_p": need(1, "p_kg_ha", 20, 35), "_k": need(2, "k_kg_ha", 150, 280),
    })
    dap = F.col("_p") / 0.46
    urea = F.greatest(F.lit(0.0), F.col("_n") - dap * 0.18) / 0.46
    return df.select(
        "*",
        F.bround("_n", 1).alias("need_n"), F.bround("_p", 1).alias("need_p"), F.bround("_k", 1).alias("need_k"),
        F.bround(urea / 45.0, 1).alias("urea_bags"), F.bround(dap / 50.0, 1).alias("dap_bags"),
        F.bround(F.col("_k") / 0.60 / 50.0, 1).alias("mop_bags"),
        (F.col("acreage") * 2.5).cast("int").alias("fym_tonnes"),
        F.col("acreage").cast("int").alias("vermicompost_tonnes"),
    ).drop("_n", "_p", "_k")


def score_finance(farms: DataFrame) -> DataFrame:
    """Cost, revenue and profit from crop, acreage, predicted_yield (or null) and avg_price."""
    crop = F.lower("crop")
    per_acre = F.when(F.contains(crop, F.lit("pomegranate")), 35000.0).when(
        F.contains(crop, F.lit("cotton")), 22000.0).otherwise(18000.0)
    cost = per_acre * F.col("acreage")
    produce = F.coalesce("predicted_yield", 60.0 * F.col("acreage"))
    revenue = produce / 10.0 * F.coalesce("avg_price", F.lit(8000.0))
    return farms.select(
        "*", F.bround(cost, 2).alias("input_cost"), F.bround(revenue, 2).alias("gross_revenue"),
        F.bround(revenue - cost, 2).alias("net_profit"))


def moisture_status(moisture: Column) -> Column:
    return F.when(moisture < 25.0, "Dry (Needs Irrigation)").when(moisture <= 35.0, "Optimal").otherwise("Saturated")


def band_telemetry(readings: DataFrame) -> DataFrame:
    """Moisture band and irrigation flag."""
    m = F.col("moisture_pct")
    return readings.select("*", moisture_status(m).alias("moisture_status"), (m < 25.0).alias("irrigation_trigger"))


def band_vegetation(readings: DataFrame) -> DataFrame:
    """Crop vigour, water stress and canopy from ndvi and ndwi."""
    return readings.select(
        "*", F.bround(F.col("ndvi") * 100, 1).alias("canopy_pct"),
        F.when(F.col("ndvi") > 0.70, "Vigorous Healthy Vegetation")
        .when(F.col("ndvi") > 0.50, "Moderate Canopy Growth / Moderate Stress")
        .otherwise("High Chlorophyll Deficit / Severe Stress").alias("crop_vigor"),
        F.when(F.col("ndwi") > 0.15, "Low").otherwise("Moderate to High Water Deficit").alias("water_stress"),
    )


def weather_alerts(readings: DataFrame) -> DataFrame:
    """0..2 alert rows per weather reading."""
    alerts = F.array(
        F.when((F.col("humidity_pct") > 80) & (F.col("temperature_c") > 25),
               "IMD Advisory: High humidity and warm temperatures create high risk for fungal blights and bacterial infection."),
        F.when(F.col("rainfall_mm") > 20,
               "IMD Warning: Moderate to heavy rain expected. Suspend spraying operations and ensure proper field drainage."),
    )
    return readings.select("*", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("alert"))


def audit(farms: DataFrame, weather: DataFrame, telemetry: DataFrame) -> DataFrame:
    """0..2 action rows per farm from its district's weather and its own latest telemetry.

    farms (farm_id, district, crop); weather (district, humidity_pct); telemetry (farm_id,
    moisture_pct), one row per key.
    """
    joined = farms.join(weather, "district", "left").join(telemetry, "farm_id", "left")
    return audit_rows(joined)


def audit_rows(joined: DataFrame) -> DataFrame:
    def action(name, priority, trigger, en, mr):
        return F.struct(
            F.lit(name).alias("action"), F.lit(priority).alias("priority"), render(trigger).alias("trigger"),
            render(en).alias("message_en"), render(mr).alias("message_mr"))

    rows = F.array(
        F.when(F.col("humidity_pct") > 80, action(
            "AUTOMATED_ALERT_DISPATCH", "HIGH", "High Ambient Humidity (>80%)",
            "Humidity reached {humidity_pct}%. Increased fungal outbreak risk for {crop}. "
            "Plan preventative fungicide spray.",
            "हवामानात आर्द्रता {humidity_pct}% आहे. {crop} पिकावर बुरशीजन्य रोगाचा धोका वाढला आहे. "
            "प्रतिबंधात्मक फवारणीचे नियोजन करा.")),
        F.when(F.col("moisture_pct") < 25.0, action(
            "IRRIGATION_PUMP_TRIGGER", "MEDIUM", "Soil Moisture dropped to {moisture_pct}%",
            "Soil moisture dropped to {moisture_pct}%. Turn on drip irrigation for 2 hours.",
            "मातीतील ओलावा {moisture_pct}% वर आला आहे. ठिबक सिंचन २ तासांसाठी चालू करण्याची शिफारस आहे.")),
    )
    return joined.select("*", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("*", "r.*").drop("r")


def latest_by(readings: DataFrame, key: str, ts: str, tie: str, *values: str) -> DataFrame:
    """The newest reading per key, by a partially aggregated maximum."""
    return readings.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(ts, tie)).alias("r")).select(key, "r.*")


def latest_fields(updates: DataFrame, key: str, ts: str, tie: str, *fields: str) -> DataFrame:
    """Per key every field's newest given value: updates are merged one after another, and one that
    does not give a field leaves what an earlier one gave. Partially aggregated per field."""
    def newest(f: str) -> Column:
        return F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(ts, tie))).alias(f)

    return updates.groupBy(key).agg(*[newest(f) for f in fields])


def upsert_farms(current: DataFrame, updates: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Insert unknown farms with defaults; overwrite only the given fields of known ones.

    Both inputs hold one row per farm_id; a null field in `updates` means "not given".
    """
    fields = [c for c in current.columns if c != "farm_id"]
    c = current.withColumn("_known", F.lit(True)).alias("c")
    u = updates.alias("u")
    joined = c.join(u, F.col("c.farm_id") == F.col("u.farm_id"), "full_outer")
    out = []
    for f in fields:
        given = F.col(f"u.{f}") if f in updates.columns else F.lit(None)
        fresh = F.coalesce(given, defaults[f]) if f in defaults else given
        out.append(F.when(F.col("c._known"), F.coalesce(given, F.col(f"c.{f}"))).otherwise(fresh).alias(f))
    return joined.select(F.coalesce(F.col("c.farm_id"), F.col("u.farm_id")).alias("farm_id"), *out)


def log_entries(events: DataFrame, ts: Column, kind: Column, details: Column) -> DataFrame:
    """Action log rows ready to append: farm_id, date to the minute, type, details."""
    return events.select(
        "farm_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("date"), kind.alias("type"), details.alias("details"))


def read_log(log: DataFrame, farms: DataFrame) -> DataFrame:
    """History of known farms in order; range partitioning splits a farm with a huge history."""
    return log.join(farms.select("farm_id"), "farm_id", "left_semi").orderBy("farm_id", "date", "details")


# Fields of a soil health card, their patterns and defaults.
SOIL_CARD = {
    "ph": (r"(?i)pH[:\s]+([\d\.]+)", 7.2),
    "ec": (r"(?i)EC[:\s]+([\d\.]+)", 0.45),
    "organic_carbon": (r"(?i)Organic Carbon[:\s]+([\d\.]+)", 0.52),
    "nitrogen": (r"(?i)Nitrogen[:\s]+([\d\.]+)", 180.0),
    "phosphorus": (r"(?i)Phosphorus[:\s]+([\d\.]+)", 22.0),
    "potassium": (r"(?i)Potassium[:\s]+([\d\.]+)", 280.0),
}


def read_soil_cards(cards: DataFrame, text: str = "card") -> DataFrame:
    """Soil parameters from card text with defaults, and their bands."""
    values = {
        name: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(default))
        for name, (pattern, default) in SOIL_CARD.items()
    }
    n, p, k, ph = (F.col(c) for c in ("nitrogen", "phosphorus", "potassium", "ph"))
    return cards.withColumns(values).select(
        "*",
        F.when(n < 280, "Deficient").otherwise("Sufficient").alias("nitrogen_status"),
        F.when(p.between(11, 25), "Medium").when(p < 11, "Deficient").otherwise("High").alias("phosphorus_status"),
        F.when(k > 280, "High").when(k >= 110, "Medium").otherwise("Deficient").alias("potassium_status"),
        F.when(ph > 7.5, "Slightly Alkaline").when(ph >= 6.5, "Neutral / Ideal").otherwise("Acidic").alias("ph_status"),
    )
