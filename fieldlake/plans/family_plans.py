"""Registered queries: record lists of eleven families to standard records, one query each.

A family's items are columns of one table, written in SQL that Spark and DuckDB share; its check
query spells the expected questions and answers out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from fieldlake.operators import standardize
from fieldlake.plans import sql as S
from fieldlake.plans.sql import query
from fieldlake.session import table


@dataclass(frozen=True)
class Family:
    """A record list: its table and key, its lake domain and category, item fields, and the expected records."""

    name: str
    source: str
    key: str
    domain: str
    category: str
    items: dict[str, str]
    #: (condition, question, answer, subcategory) of each rule; `i` holds the item fields, null where one is missing.
    records: list[tuple[str, str, str, str]]
    arrays: dict[str, list[str]] = field(default_factory=dict)


def _or(value: str, default: str) -> str:
    """The value, or what stands in for an empty one."""
    return f"coalesce(nullif({value}, ''), '{default}')"


CROP = f"'Crop ' || name_en || ' (' || name_mr || '). Season: ' || {_or('season', 'None')} || '. Soil: ' || ideal_soil || '. Pests: ' || major_pests || '. Diseases: . Source: platform KB.'"
PEST = (f"name || ' on ' || {_or('crop', 'None')} || '. Symptoms: ' || coalesce(symptoms_en, '') || '. Organic: ' || organic_control_en || '. Chemical: .'")
SCHEME = f"{_or('name_en', 'scheme')} || '. Benefits: ' || benefits_en || '. Eligibility: . Portal: ' || portal"

FAMILIES = [
    Family("crops", "part", "p_partkey", "crop", "crop", {
        "name_en": "p_name", "name_mr": "CASE WHEN p_size % 2 = 0 THEN 'पीक ' || p_brand ELSE '' END", "season": "CASE WHEN p_size > 9 THEN p_type END", "ideal_soil": "lower(p_type)"},
        [("TRUE", "'What should I know about growing ' || name_en || '?'", CROP, "crop_guide"), ("name_mr <> ''", "name_mr || ' पीक माहिती काय आहे?'", CROP, "crop_guide")],
        {"major_pests": ["p_brand", "p_type"]}),
    Family("diseases_and_pests", "part", "p_partkey", "pest", "disease", {
        "name": "p_type || ' blight'", "crop": "CASE WHEN p_size % 5 > 0 THEN p_name ELSE '' END", "symptoms_en": "CASE WHEN p_size % 3 = 0 THEN 'spots on ' || p_brand END",
        "organic_control_en": "p_brand || ' oil'", "name_mr": "CASE WHEN p_size % 2 = 0 THEN 'रोग ' || p_type ELSE '' END", "symptoms_mr": "CASE WHEN p_size % 4 = 0 THEN 'ठिपके ' || p_brand END"},
        [("TRUE", f"'How do I manage ' || name || ' in ' || {_or('crop', 'None')} || '?'", PEST, "disease_pest"),
         ("name_mr <> ''", "name_mr || ' नियंत्रण कसे करावे?'", f"coalesce(symptoms_mr, {PEST})", "disease_pest")]),
    Family("schemes", "customer", "c_custkey", "government", "scheme", {
        "name_en": "CASE WHEN c_nationkey % 4 > 0 THEN c_name ELSE '' END", "benefits_en": "'support for ' || c_mktsegment", "portal": "'https://s' || c_nationkey || '.example'",
        "name_mr": "CASE WHEN c_nationkey % 2 = 0 THEN 'योजना ' || c_custkey ELSE '' END", "benefits_mr": "CASE WHEN c_nationkey % 3 = 0 THEN 'लाभ ' || c_mktsegment ELSE '' END"},
        [("TRUE", f"'What is the ' || {_or('name_en', 'scheme')} || ' government scheme?'", SCHEME, "scheme"),
         ("name_mr <> ''", "name_mr || ' योजना काय आहे?'", f"coalesce(nullif(benefits_mr, ''), {SCHEME})", "scheme")]),
    Family("fertilizer_recommendations", "part", "p_partkey", "fertilizer", "fertilizer", {
        "crop": "p_name", "n": "CAST(p_size AS STRING)", "p": "CAST(p_size + 1 AS STRING)", "k": "CASE WHEN p_size > 20 THEN CAST(p_size + 2 AS STRING) END", "basal_dose": "p_brand"},
        [("TRUE", "'What fertilizer should I apply for ' || crop || '?'",
          "'NPK per acre for ' || crop || ': N=' || n || ', P=' || p || ', K=' || coalesce(k, 'None') || '. Basal: ' || basal_dose || '. Top dressing: None. Micronutrients: ' || micronutrients || '.'", "fertilizer")],
        {"micronutrients": ["p_type", "p_brand"]}),
    Family("soil_types", "supplier", "s_suppkey", "soil", "soil", {"name_en": "s_name", "characteristics_en": "'Nation ' || s_nationkey || ' loam.'"},
        [("TRUE", "'Describe ' || name_en || ' and suitable crops.'", "name_en || '. ' || characteristics_en || ' Suitable crops: ' || suitable_crops || '.'", "soil")],
        {"suitable_crops": ["'c' || s_nationkey", "'d' || s_suppkey"]}),
    Family("advisories", "documents", "doc_id", "general", "advisory", {
        "title": "source || ' ' || doc_id", "body": "coalesce(lang, '') || ' bulletin ' || doc_id", "title_mr": "CASE WHEN doc_id % 3 = 0 THEN 'सल्ला ' || doc_id END",
        "content_mr": "CASE WHEN doc_id % 2 = 0 THEN 'मजकूर ' || doc_id END"},
        [("TRUE", "'Advisory: ' || title || '?'", "title || '. ' || body", "advisory"),
         ("title_mr IS NOT NULL OR content_mr IS NOT NULL", "coalesce(title_mr, title || ' (MR)')", "coalesce(content_mr, body)", "advisory")]),
    Family("varieties", "part", "p_partkey", "seed", "seed", {"crop": "p_name", "name": "p_brand", "agro_climatic_fit": "CASE WHEN p_size > 25 THEN p_type END", "notes": "CASE WHEN p_size > 40 THEN 'late' ELSE '' END"},
        [("TRUE", "'Which seed variety for ' || crop || ': ' || name || '?'", "'Variety ' || name || ' for ' || crop || '. Fit: ' || coalesce(agro_climatic_fit, 'None') || '. Notes: ' || notes || '.'", "seed")]),
    Family("practices", "orders", "o_orderkey", "irrigation", "irrigation", {"title": "CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE '' END", "content": "'Water plot ' || o_custkey || ' in state ' || o_orderstatus"},
        [("TRUE", f"'What is the guidance for ' || {_or('title', 'Irrigation practice')} || '?'", f"{_or('title', 'Irrigation practice')} || '. ' || content", "irrigation")]),
    Family("zones", "supplier", "s_suppkey", "weather", "weather", {"zone": "s_name", "rainfall_mm": "CAST(s_nationkey * 40 AS STRING)", "notes": "CASE WHEN s_nationkey > 12 THEN 'dry' END"},
        [("TRUE", "'What crops suit ' || zone || '?'", "'Zone ' || zone || '. Rainfall ' || rainfall_mm || '. Crops: ' || recommended_crops || '. Notes: ' || coalesce(notes, '') || '.'", "weather")],
        {"recommended_crops": ["'c' || s_nationkey"]}),
    Family("sources", "customer", "c_custkey", "general", "general", {"name": "c_name", "type": "c_mktsegment", "use": "CASE WHEN c_nationkey > 5 THEN 'prices' END", "url": "'https://d' || c_custkey || '.example'"},
        [("TRUE", "'What open data source is ' || name || '?'", "name || ' (' || type || '): ' || coalesce(use, 'None') || '. URL: ' || url", "catalog")]),
    Family("nodes", "part", "p_partkey", "general", "general", {"id": "p_name || ' ' || p_partkey", "label": "CASE WHEN p_size % 2 = 0 THEN 'Crop' ELSE 'Soil' END", "properties": "CASE WHEN p_size > 9 THEN p_type ELSE '' END"},
        [("label = 'Crop'", "'Graph entity: ' || id || '?'", f"'Crop entity ' || id || '. ' || {_or('properties', '{}')}", "graph")]),
]


def _sql(f: Family) -> str:
    text = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in f.items.items()} | {k: " || ', ' || ".join(v) for k, v in f.arrays.items()}
    items = ", ".join(f"{v} AS {k}" for k, v in text.items())
    made = " UNION ALL ".join(f"SELECT trim({q}) AS q, trim({a}) AS a, '{s}' AS subcategory, path FROM i WHERE {when}" for when, q, a, s in f.records)
    key = f"sha256('{f.name}|' || substr(q, 1, 80) || '|' || substr(a, 1, 80) || '|' || path)"
    return f"""WITH i AS (SELECT {items}, '{f.name}/' || {f.key} AS path FROM {f.source}),
r AS ({made}), k AS (SELECT *, 'std_' || substr({key}, 1, 16) AS id FROM r WHERE length(q) >= 5 AND length(a) >= 5)
SELECT {S.split_of('id')} AS split, '{f.category}' AS category, subcategory, count(*) AS n, CAST(sum(length(q) + length(a)) AS BIGINT) AS chars,
  min(id) AS first_id, max(id) AS last_id FROM k GROUP BY ALL"""


def _register(f: Family) -> None:
    def run(spark, sf):
        items = table(spark, sf, f.source).select(
            *[F.expr(v).alias(k) for k, v in f.items.items()], *[F.array(*map(F.expr, v)).alias(k) for k, v in f.arrays.items()],
            F.lit(f.domain).alias("domain"), F.concat(F.lit(f"{f.name}/"), f.key).alias("source_path"))
        r = standardize.standardize(items, f.name)
        return r.groupBy("split", "category", "subcategory").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("question") + F.length("answer")).alias("chars"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))

    query(f"q_standardize_{f.name}", _sql(f))(run)


for _family in FAMILIES:
    _register(_family)
