"""Facts to standard question/answer records (schema v1).

Each known list of a raw payload is a family with one or two templates. A family's rules
are plain data; a record list becomes `explode(array(rule structs))`, a narrow step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from fieldlake.functions import taxonomy as X
from fieldlake.functions import text as T
from fieldlake.functions import vocab
from fieldlake.operators.synth import render

MIN_LENGTH = 5


@dataclass(frozen=True)
class Rule:
    question: str
    answer: str
    subcategory: str
    crop: str | None = None
    confidence: float = 0.75
    when: str | None = None  # SQL condition on the item


# The wording of questions and answers per record list.
RULES: dict[str, list[Rule]] = {
    "crops": [
        Rule("What should I know about growing {name_en}?",
             "Crop {name_en} ({name_mr}). Season: {season}. Soil: {ideal_soil}. Pests: {major_pests}. "
             "Diseases: {major_diseases}. Source: {source}.", "crop_guide", "name_en"),
        Rule("{name_mr} पीक माहिती काय आहे?",
             "Crop {name_en} ({name_mr}). Season: {season}. Soil: {ideal_soil}. Pests: {major_pests}. "
             "Diseases: {major_diseases}. Source: {source}.", "crop_guide", "name_en", when="name_mr <> ''"),
    ],
    "diseases_and_pests": [
        Rule("How do I manage {name_en} in {crop_en}?",
             "{name_en} on {crop_en}. Symptoms: {symptoms_en}. Organic: {organic_control_en}. "
             "Chemical: {chemical_control_en}.", "disease_pest", "crop_en"),
        Rule("{name_mr} नियंत्रण कसे करावे?", "{symptoms_mr}", "disease_pest", "crop_en", when="name_mr <> ''"),
    ],
    "schemes": [
        Rule("What is the {name_en} government scheme?",
             "{name_en}. Benefits: {benefits_en}. Eligibility: {eligibility_en}. Portal: {portal}", "scheme"),
        Rule("{name_mr} योजना काय आहे?", "{benefits_mr}", "scheme", when="name_mr <> ''"),
    ],
    "markets": [
        Rule("What is the mandi price for {crop} at {mandi}?",
             "{crop} at {mandi}, {district}: modal ₹{modal_price_rs_quintal}/q (min {min_price_rs_quintal}, "
             "max {max_price_rs_quintal}). Trend: {trend}.", "market", "crop"),
    ],
    "fertilizer_recommendations": [
        Rule("What fertilizer should I apply for {crop_en}?",
             "NPK per acre for {crop_en}: N={n}, P={p}, K={k}. Basal: {basal_dose}. "
             "Top dressing: {top_dressing}. Micronutrients: {micronutrients}.", "fertilizer", "crop_en"),
    ],
    "soil_types": [
        Rule("Describe {type} and suitable crops.",
             "{type}. {characteristics_en} Suitable crops: {suitable_crops}.", "soil"),
    ],
    "advisories": [
        Rule("Advisory: {title_en}?", "{title_en}. {content_en}", "advisory"),
        Rule("{title_mr}", "{content_mr}", "advisory", when="has_mr"),
    ],
    "varieties": [
        Rule("Which seed variety for {crop_en}: {variety}?",
             "Variety {variety} for {crop_en}. Fit: {agro_climatic_fit}. Notes: {notes_mr}.", "seed", "crop_en"),
    ],
    "practices": [
        Rule("What is the guidance for {title}?", "{title}. {content}", "irrigation", "first_crop"),
    ],
    "zones": [
        Rule("What crops suit {zone}?",
             "Zone {zone}. Rainfall {rainfall_mm}. Crops: {recommended_crops}. Notes: {notes}.", "weather"),
    ],
    "sources": [
        Rule("What open data source is {name}?", "{name} ({type}): {use}. URL: {url}", "catalog", confidence=0.6),
    ],
    "nodes": [
        Rule("Graph entity: {id}?", "Crop entity {id}. {properties}", "graph", "id", 0.5, when="label = 'Crop'"),
    ],
}

# Fixed values: (column, other names to take it from, value if all are empty).
FIELDS: dict[str, list[tuple[str, list[str], str | None]]] = {
    "crops": [("name_en", ["crop"], "crop"), ("name_mr", [], ""), ("season", [], None), ("ideal_soil", [], ""),
              ("major_pests", [], ""), ("major_diseases", [], ""), ("source", [], "platform KB")],
    "diseases_and_pests": [
        ("name_en", ["name"], "pest/disease"), ("crop_en", ["crop"], None), ("symptoms_en", ["symptoms"], ""),
        ("organic_control_en", [], ""), ("chemical_control_en", [], ""), ("name_mr", [], ""), ("symptoms_mr", [], None)],
    "schemes": [("name_en", ["name"], "scheme"), ("benefits_en", ["benefits"], ""), ("eligibility_en", [], ""),
                ("portal", [], ""), ("name_mr", [], ""), ("benefits_mr", [], None)],
    "markets": [("crop", ["commodity"], None), ("mandi", ["market"], ""), ("district", [], None),
                ("modal_price_rs_quintal", [], None), ("min_price_rs_quintal", [], None),
                ("max_price_rs_quintal", [], None), ("trend", [], None)],
    "fertilizer_recommendations": [
        ("crop_en", ["crop"], None), ("n", [], None), ("p", [], None), ("k", [], None), ("basal_dose", [], None),
        ("top_dressing", [], None), ("micronutrients", [], None)],
    "soil_types": [("type", ["name_en"], "soil"), ("characteristics_en", [], ""), ("suitable_crops", [], "")],
    "advisories": [("title_en", ["title"], "Advisory"), ("content_en", ["content", "body"], ""),
                   ("title_mr", [], None), ("content_mr", [], None)],
    "varieties": [("crop_en", ["crop"], None), ("variety", ["name"], None), ("agro_climatic_fit", [], None),
                  ("notes_mr", ["notes"], "")],
    "practices": [("title", [], "Irrigation practice"), ("content", [], ""), ("first_crop", [], None)],
    "zones": [("zone", [], "zone"), ("rainfall_mm", [], None), ("recommended_crops", [], ""), ("notes", [], "")],
    "sources": [("name", [], "source"), ("type", [], None), ("use", [], None), ("url", [], None)],
    "nodes": [("id", [], None), ("label", [], None), ("properties", [], "{}")],
}


def _as_text(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, ty.ArrayType):
        return F.array_join(F.col(name), ", ")
    if isinstance(dt, (ty.StructType, ty.MapType)):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def _prepared(items: DataFrame, list_key: str) -> DataFrame:
    """Item columns as text, empty values replaced by their alternatives and defaults."""
    have = set(items.columns)
    if list_key == "fertilizer_recommendations" and "recommended_npk_kg_per_acre" in have:
        npk = F.col("recommended_npk_kg_per_acre")
        items = items.select("*", npk["N"].alias("n"), npk["P"].alias("p"), npk["K"].alias("k"))
    if list_key == "practices" and "crops" in have:
        items = items.withColumn("first_crop", F.get("crops", F.lit(0)))
    have = set(items.columns)
    out = []
    for name, others, default in FIELDS[list_key]:
        options = [F.nullif(_as_text(items, c), F.lit("")) for c in [name, *others] if c in have]
        out.append(F.coalesce(*options, F.lit(default).cast("string")).alias(name))
    prepared = items.select("source_path", "domain", *out)
    if list_key == "diseases_and_pests":
        prepared = prepared.withColumn("symptoms_mr", F.coalesce("symptoms_mr", render(RULES[list_key][0].answer)))
    if list_key == "schemes":
        prepared = prepared.withColumn("benefits_mr", F.coalesce("benefits_mr", render(RULES[list_key][0].answer)))
    if list_key == "advisories":
        prepared = (
            prepared.withColumn("has_mr", F.col("title_mr").isNotNull() | F.col("content_mr").isNotNull())
            .withColumn("title_mr", F.coalesce("title_mr", F.concat("title_en", F.lit(" (MR)"))))
            .withColumn("content_mr", F.coalesce("content_mr", "content_en"))
        )
    return prepared


def standardize(items: DataFrame, list_key: str) -> DataFrame:
    """Standard records of one record list.

    `items` has the item's fields plus `source_path` and `domain`. Unknown list keys fall
    back to one weak record with the item's JSON.
    """
    if list_key in RULES:
        base, rules = _prepared(items, list_key), RULES[list_key]
    else:
        rest = [c for c in items.columns if c not in ("source_path", "domain")]
        base = items.select("source_path", "domain", F.substring(F.to_json(F.struct(*rest)), 1, 500).alias("blob"))
        rules = [Rule(f"What is this {list_key} record about?", "{blob}", list_key, confidence=0.4)]
    made = F.array(*[
        F.when(F.expr(r.when) if r.when else F.lit(True), F.struct(
            T.strip(render(r.question)).alias("question"), T.strip(render(r.answer)).alias("answer"),
            (F.col(r.crop) if r.crop else F.lit(None).cast("string")).alias("crop"),
            F.lit(r.subcategory).alias("subcategory"), F.lit(r.confidence).alias("confidence"),
        ))
        for r in rules
    ])
    rows = base.select("source_path", "domain", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return to_records(rows.select("source_path", "domain", F.lit(list_key).alias("list_key"), "x.*"))


def to_records(pairs: DataFrame) -> DataFrame:
    """Question/answer pairs to schema v1: length gate, id, split, language, category, crop."""
    long_enough = (F.length("question") >= MIN_LENGTH) & (F.length("answer") >= MIN_LENGTH)
    rows = pairs.filter(long_enough).withColumn(
        "id", T.standard_id(F.col("list_key"), F.col("question"), F.col("answer"), F.col("source_path"))
    )
    return rows.select(
        "id",
        X.record_category(F.col("list_key"), F.col("domain")).alias("category"),
        F.coalesce("subcategory", F.get(X.detect_categories(F.concat_ws(" ", "question", "answer")), F.lit(0)))
        .alias("subcategory"),
        F.when(F.coalesce("crop", F.lit("")) != "", F.coalesce(X.resolve_crop(F.col("crop")), "crop")).alias("crop"),
        F.struct(
            F.lit("Maharashtra").alias("state"), F.lit(None).cast("string").alias("district"),
            F.lit(None).cast("string").alias("zone"), F.lit("India").alias("country"),
        ).alias("region"),
        T.detect_language_pair(F.col("question"), F.col("answer")).alias("language"),
        "question", "answer",
        F.concat(F.lit("lake_processed:"), "source_path").alias("source"),
        F.lit(False).alias("verified"), "confidence",
        F.lit(vocab.RECORD_LICENSE).alias("license"),
        T.assign_split(F.col("id")).alias("split"),
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        F.create_map(
            F.lit("list_key"), "list_key", F.lit("domain"), "domain", F.lit("source_path"), "source_path"
        ).alias("metadata"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """User turn and the assistant turn right after it, as (conv_id, turn, question, answer)."""
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(said, ["conv_id", "turn"])


def cap_per_file(records: DataFrame, path_col: str, order_col: str, cap: int) -> DataFrame:
    """At most `cap` records per file, first ones in order (a limit asked for by the caller)."""
    w = Window.partitionBy(path_col).orderBy(order_col)
    return records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def explode_lists(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(..., list_key, pos, item): every element of every known record list of a payload.

    Items stay variants, so files with different item shapes share one table.
    """
    v = F.try_parse_json(payload)
    listed = F.array(*[
        F.struct(F.lit(k).alias("list_key"), F.try_variant_get(v, f"$.{k}", "array<variant>").alias("items"))
        for k in vocab.RECORD_LIST_KEYS
    ])
    root = F.try_variant_get(v, "$", "array<variant>")
    chosen = F.when(
        root.isNotNull(), F.array(F.struct(F.lit("$root").alias("list_key"), root.alias("items")))
    ).otherwise(F.filter(listed, lambda x: x["items"].isNotNull()))
    rest = [c for c in payloads.columns if c != payload]
    return (
        payloads.select(*rest, F.explode(chosen).alias("l"))
        .select(*rest, "l.list_key", F.posexplode("l.items").alias("pos", "item"))
    )
