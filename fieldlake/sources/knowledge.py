"""The knowledge base: ten JSON files, flattened into one document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.operators.synth import render

# File -> record list -> item type.
RANGE = "struct<min:double,max:double>"
FILES = {
    "crops_and_diseases.json": {
        "crops": "crop_id string, name_en string, name_mr string, scientific_name string, season string, "
                 f"ideal_soil array<string>, ideal_temp_c {RANGE}, ideal_rainfall_mm {RANGE}, duration_days string, "
                 "growth_stages array<string>, major_pests array<string>, major_diseases array<string>, source string",
        "diseases_and_pests": "id string, name_en string, name_mr string, crop_en string, crop_mr string, "
                              "symptoms_en string, symptoms_mr string, organic_control_en string, "
                              "organic_control_mr string, chemical_control_en string, chemical_control_mr string, "
                              "source string",
    },
    "soil_and_fertilizers.json": {
        "soil_types": "type string, type_mr string, characteristics_en string, characteristics_mr string, "
                      "suitable_crops array<string>",
        "fertilizer_recommendations": "crop_en string, crop_mr string, "
                                      "recommended_npk_kg_per_acre struct<N:string,P:string,K:string>, "
                                      "basal_dose string, basal_dose_mr string, top_dressing string, "
                                      "top_dressing_mr string, micronutrients string, source string",
    },
    "government_schemes.json": {
        "schemes": "scheme_id string, name_en string, name_mr string, benefits_en string, benefits_mr string, "
                   "eligibility_en string, eligibility_mr string, documents_required array<string>, portal string, "
                   "source string",
    },
    "market_prices.json": {
        "markets": "mandi string, district string, state string, crop string, crop_mr string, variety string, "
                   "min_price_rs_quintal string, max_price_rs_quintal string, modal_price_rs_quintal string, "
                   "arrival_tonnes string, date string, trend string, source string",
    },
    "agri_advisories.json": {
        "advisories": "id string, title_en string, title_mr string, content_en string, content_mr string, "
                      "category string, source string",
    },
    "seed_varieties.json": {
        "varieties": "crop_en string, variety string, notes_mr string, agro_climatic_fit string, source string",
    },
    "irrigation_practices.json": {
        "practices": "id string, title string, content string, crops array<string>, source string",
    },
    "climate_zones.json": {
        "zones": "zone string, districts array<string>, rainfall_mm string, recommended_crops array<string>, "
                 "notes string",
    },
    "open_source_catalog.json": {"sources": "name string, url string, type string, use string"},
    "knowledge_graph.json": {
        "nodes": "id string, label string, properties map<string,string>",
        "edges": "source string, target string, relation string",
    },
}


def struct_type(ddl: str) -> str:
    """A column list as a struct type, with `name type` rewritten to `name:type`."""
    depth, item, parts = 0, "", []
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = item.strip().partition(" ")
            parts.append(f"{name}:{kind}")
            item = ""
        else:
            item += ch
    return f"struct<{','.join(parts)}>"


def load_knowledge_base(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One table per record list with its position `ord`; a missing file is an empty table."""
    out = {}
    for name, lists in FILES.items():
        schema = ", ".join(f"{k} array<{struct_type(ddl)}>" for k, ddl in lists.items())
        whole = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", name).json(folder)
        for k in lists:
            out[k] = whole.select(F.posexplode(k).alias("ord", "r")).select("ord", "r.*")
    return out


def _text(c: str | Column, default: str = "") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(default))


def _list(c: str) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit(""))


def documents(kb: dict[str, DataFrame]) -> DataFrame:
    """(id, category, title, content, metadata, source) of all eleven entity lists."""

    def docs(name, category, doc_id, title, content, source, default_source, **fields):
        rows = kb[name].withColumn("_meta", F.to_json(F.struct(*[c for c in kb[name].columns if c != "ord"])))
        rows = rows.withColumn("_source", _text(source, default_source) if source else F.lit(default_source))
        rows = rows.withColumns(fields) if fields else rows
        return rows.select(
            doc_id.alias("id"), F.lit(category).alias("category"), render(title).alias("title"),
            render(content).alias("content"), F.col("_meta").alias("metadata"), F.col("_source").alias("source"))

    def prefixed(prefix, c):
        return F.concat(F.lit(prefix), c)

    npk = F.col("recommended_npk_kg_per_acre")
    underscored = F.replace(F.lower("type"), F.lit(" "), F.lit("_"))
    fert_id = F.translate(F.lower("crop_en"), " ()", "_")
    parts = [
        docs("crops", "Crop", prefixed("crop_", F.col("crop_id")), "Crop Guide: {name_en} ({name_mr})",
             "Crop: {name_en} ({name_mr}). Scientific: {sci}. Season: {season}. Ideal soil: {soil}. "
             "Ideal temp: {t0}-{t1}°C. Ideal rainfall: {r0}-{r1} mm. Duration: {duration_days} days. "
             "Stages: {stages}. Major pests: {pests}. Major diseases: {diseases}. Source: {src}.",
             "source", "local_kb", sci=_text("scientific_name"), soil=_list("ideal_soil"),
             t0=F.col("ideal_temp_c.min"), t1=F.col("ideal_temp_c.max"), r0=F.col("ideal_rainfall_mm.min"),
             r1=F.col("ideal_rainfall_mm.max"), stages=_list("growth_stages"), pests=_list("major_pests"),
             diseases=_list("major_diseases"), src=_text("source", "ICAR/SAU open advisory")),
        docs("diseases_and_pests", "Disease", prefixed("disease_", F.col("id")),
             "Disease & Pest: {name_en} ({mr}) in {crop_en}",
             "Disease/Pest: {name_en} ({mr}) affecting {crop_en}. Symptoms (English): {se}. "
             "Symptoms (Marathi): {sm}. Organic Control: {oe} / {om}. Chemical Control: {ce} / {cm}. Source: {src}.",
             "source", "local_kb", mr=_text("name_mr"), se=_text("symptoms_en"), sm=_text("symptoms_mr"),
             oe=_text("organic_control_en"), om=_text("organic_control_mr"), ce=_text("chemical_control_en"),
             cm=_text("chemical_control_mr"), src=_text("source", "ICAR IPM")),
        docs("soil_types", "Soil", prefixed("soil_", F.substring(underscored, 1, 40)), "Soil Type: {type} ({mr})",
             "Soil: {type}. {ce} ({cm}). Suitable crops: {crops}.", None, "soil_kb", mr=_text("type_mr"),
             ce=_text("characteristics_en"), cm=_text("characteristics_mr"), crops=_list("suitable_crops")),
        docs("fertilizer_recommendations", "Fertilizer", prefixed("fert_", fert_id),
             "Fertilizer Guide: {crop_en} ({mr})",
             "Fertilizer guide for {crop_en} ({mr}). Recommended NPK per acre: N={n}kg, P={p}kg, K={k}kg. "
             "Basal Dose: {b} ({bm}). Top Dressing: {t} ({tm}). Micronutrients: {micro}. Source: {src}.",
             "source", "local_kb", mr=_text("crop_mr"), n=npk["N"], p=npk["P"], k=npk["K"], b=_text("basal_dose"),
             bm=_text("basal_dose_mr"), t=_text("top_dressing"), tm=_text("top_dressing_mr"),
             micro=_text("micronutrients"), src=_text("source", "SAU PoP")),
        docs("schemes", "Government Scheme", prefixed("scheme_", F.col("scheme_id")),
             "Government Scheme: {name_en} ({mr})",
             "Government Scheme: {name_en} ({mr}). Benefits: {be} ({bm}). Eligibility: {ee} ({em}). "
             "Documents required: {papers}. Portal: {link}. Source: {src}.", "source", "gov_kb", mr=_text("name_mr"),
             be=_text("benefits_en"), bm=_text("benefits_mr"), ee=_text("eligibility_en"), em=_text("eligibility_mr"),
             papers=_list("documents_required"), link=_text("portal", "n/a"), src=_text("source", "gov open info")),
        docs("markets", "Market",
             F.concat(F.lit("market_"), "ord", F.lit("_"), F.replace(_text("mandi"), F.lit(" "), F.lit("_"))),
             "Mandi Price: {crop} @ {mandi}",
             "Market price for {crop} ({mr}) variety {variety} at {mandi}, {district}, {state}. "
             "Min ₹{min_price_rs_quintal}, Modal ₹{modal_price_rs_quintal}, Max ₹{max_price_rs_quintal} per quintal. "
             "Arrivals {arrival_tonnes} tonnes. Trend: {trend}. Date: {date}. Source: {src}.",
             "source", "market_kb", mr=_text("crop_mr"), src=_text("source", "Agmarknet-style")),
        docs("advisories", "Advisory", prefixed("adv_", F.col("id")), "{head}",
             "{te} / {tm}. {ce} {cm}. Category: {cat}. Source: {src}.", "source", "advisory_kb",
             head=_text("title_en", "Advisory"), te=_text("title_en"), tm=_text("title_mr"), ce=_text("content_en"),
             cm=_text("content_mr"), cat=_text("category", "Advisory"), src=_text("source", "open advisory")),
        docs("varieties", "Seed Variety",
             F.concat(F.lit("seed_"), "ord", F.lit("_"), F.replace(_text("crop_en"), F.lit(" "), F.lit("_"))),
             "Variety: {variety} ({crop_en})",
             "Seed variety {variety} for {crop_en}. Notes: {notes}. Agro-climatic fit: {fit}. Source: {src}.",
             "source", "seed_kb", notes=_text("notes_mr"), fit=_text("agro_climatic_fit"),
             src=_text("source", "variety notes")),
        docs("practices", "Irrigation", prefixed("irr_", F.col("id")), "{head}",
             "{t}. {c} Crops: {list}. Source: {src}.", "source", "irrigation_kb",
             head=_text("title", "Irrigation practice"), t=_text("title"), c=_text("content"), list=_list("crops"),
             src=_text("source", "irrigation open knowledge")),
        docs("zones", "Climate Zone", prefixed("zone_", F.col("ord")), "Agro-climate: {zone}",
             "Climate zone {zone}. Districts: {ds}. Rainfall: {rainfall_mm} mm. Recommended crops: {crops}. "
             "Notes: {n}.", None, "climate_zone_kb", ds=_list("districts"), crops=_list("recommended_crops"),
             n=_text("notes")),
        docs("sources", "Open Source Catalog", prefixed("catalog_", F.col("ord")), "Open Source: {name}",
             "Open data source {name} ({type}). Use for: {use}. URL: {url}.", None, "open_catalog"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knowledge_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
