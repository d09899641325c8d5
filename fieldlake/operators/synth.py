"""Templated question/answer synthesis.

A pack is data: its templates and a few column templates. Rendering turns every template
into a concat expression, and one row of facts explodes into one row per template. Fixed
dimensions (stages, districts, soils, months, practices) join the same way, as array
literals, so synthesis is one scan without a join; only the facts are dealt to all cores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.functions import templates as t
from fieldlake.functions import taxonomy as X
from fieldlake.functions import text as T
from fieldlake.functions import vocab

MIN_QUESTION, MIN_ANSWER = 8, 12


@dataclass(frozen=True)
class Pack:
    name: str
    category: str
    fact_key: str
    questions: list[tuple]
    answers: dict[str, str]
    source: str
    has_crop: bool = True
    fact_keys: dict[str, str] = field(default_factory=dict)  # per template id
    categories: dict[str, str] = field(default_factory=dict)  # per template id
    question_limit: int | None = None
    subcategory: str | None = None


PACKS = {
    p.name: p
    for p in [
        Pack("crop", "crop", "crop|{crop}", t.CROP_QUESTIONS, t.CROP_ANSWERS, "qa_synth:crop:{path}"),
        Pack("disease", "disease", "disease|{crop}|{name}", t.DISEASE_QUESTIONS, t.DISEASE_ANSWERS,
             "qa_synth:disease:{path}"),
        Pack("fertilizer", "fertilizer", "fert|{crop}", t.FERTILIZER_QUESTIONS, t.FERTILIZER_ANSWERS,
             "qa_synth:fert:{path}"),
        Pack("scheme", "scheme", "scheme|{name}", t.SCHEME_QUESTIONS, t.SCHEME_ANSWERS,
             "qa_synth:scheme:{path}", has_crop=False),
        Pack("stage", "crop", "stage|{crop}|{stage_id}", t.STAGE_QUESTIONS, t.STAGE_ANSWERS,
             "qa_synth:stage:taxonomy"),
        Pack("market", "market", "market|{crop}|{mandi}", t.MARKET_QUESTIONS, t.MARKET_ANSWERS,
             "qa_synth:market:{path}"),
        Pack("irrigation", "irrigation", "irrig|{crop}|{district}", t.IRRIGATION_QUESTIONS,
             t.IRRIGATION_ANSWERS, "qa_synth:irrigation:district"),
        Pack("weather", "weather", "weather|{crop}|{district}", t.WEATHER_QUESTIONS, t.WEATHER_ANSWERS,
             "qa_synth:weather:district"),
        Pack("safety", "disease", "safety|safety|{crop}", t.SAFETY_QUESTIONS, t.SAFETY_ANSWERS,
             "qa_synth:safety", fact_keys={"en_need_info": "safety|need|{crop}"},
             categories={"en_need_info": "general"}),
        Pack("finance", "finance", "finance|{crop}", t.FINANCE_QUESTIONS, t.FINANCE_ANSWERS, "qa_synth:finance"),
        Pack("machinery", "machinery", "mach|{crop}", t.MACHINERY_QUESTIONS, t.MACHINERY_ANSWERS,
             "qa_synth:machinery"),
        Pack("paraphrase", "crop", "crop|{crop}", t.PARAPHRASE_QUESTIONS, t.PARAPHRASE_ANSWERS,
             "qa_synth:paraphrase", subcategory="crop_paraphrase"),
        Pack("soil", "soil", "soil|{crop}|{soil}", t.SOIL_QUESTIONS, t.SOIL_ANSWERS, "qa_synth:soil"),
        Pack("seed", "seed", "seed|{crop}", t.SEED_QUESTIONS, t.SEED_ANSWERS, "qa_synth:seed"),
        Pack("calendar", "crop", "cal|{crop}|{month}", t.CALENDAR_QUESTIONS, t.CALENDAR_ANSWERS,
             "qa_synth:calendar"),
        Pack("advisory", "advisory", "adv|{title_80}", t.ADVISORY_QUESTIONS, t.ADVISORY_ANSWERS,
             "qa_synth:advisory:{path}", has_crop=False, question_limit=240),
        Pack("practice", "crop", "prac|{crop}|{practice_id}", t.PRACTICE_QUESTIONS, t.PRACTICE_ANSWERS,
             "qa_synth:practice"),
    ]
}


def render(template: str) -> Column:
    """A template with {column} places as a concat expression; null columns print as None."""
    parts = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def with_dimension(facts: DataFrame, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Every fact with every row of a small fixed table, as an exploded array literal."""
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r)]) for r in rows])
    return facts.withColumn("_dim", F.explode(table)).select("*", "_dim.*").drop("_dim")


def with_stages(facts: DataFrame) -> DataFrame:
    return with_dimension(facts, ["stage_id", "stage", "stage_mr", "stage_hi"], vocab.CROP_STAGES)


def with_districts(facts: DataFrame) -> DataFrame:
    return with_dimension(facts, ["district"], [(d,) for d in vocab.district_names()])


def with_soils(facts: DataFrame) -> DataFrame:
    return with_dimension(facts, ["soil"], [(s,) for s in t.SOILS])


def with_months(facts: DataFrame) -> DataFrame:
    return with_dimension(facts, ["month", "month_mr", "month_hi"], t.MONTHS)


def with_practices(facts: DataFrame) -> DataFrame:
    return with_dimension(
        facts, ["practice_id", "practice", "practice_mr", "practice_hi", "practice_answer"], t.PRACTICES
    )


def dealt(facts: DataFrame) -> DataFrame:
    """`facts` on all cores: the rows they give are many times larger than they are, and a file of them may be read by one task."""
    cores = facts.sparkSession.sparkContext.defaultParallelism
    return facts.repartition(3 * cores)


def synthesize(facts: DataFrame, pack: Pack | str) -> DataFrame:
    """Standard records of one pack: rendered, length gated, with id, split and confidence."""
    pack = PACKS[pack] if isinstance(pack, str) else pack
    rows = []
    # a fact's key and split are the same for many templates: they are found once, before the fact becomes rows
    keys = {k: n for n, k in enumerate(dict.fromkeys(pack.fact_keys.get(q[0], pack.fact_key) for q in pack.questions))}
    for template_id, language, question, answer, confidence in pack.questions:
        n = keys[pack.fact_keys.get(template_id, pack.fact_key)]
        q = render(question)
        if pack.question_limit:
            q = F.substring(q, 1, pack.question_limit)
        rows.append(F.struct(
            render(template_id).alias("template_id"),
            F.lit(language).alias("language"),
            T.strip(q).alias("question"),
            T.strip(render(pack.answers[answer])).alias("answer"),
            F.lit(confidence).alias("confidence"),
            F.col(f"_key{n}").alias("fact_key"),
            F.col(f"_split{n}").alias("split"),
            F.lit(pack.categories.get(template_id, pack.category)).alias("category"),
        ))
    crop = X.resolve_crop(F.col("crop")) if pack.has_crop else F.lit(None).cast("string")
    district = F.col("district") if "district" in facts.columns else F.lit(None).cast("string")
    state = F.col("state") if "state" in facts.columns else F.lit("Maharashtra")
    keyed = dealt(facts).select("*", *(render(k).alias(f"_key{n}") for k, n in keys.items()))
    keyed = keyed.select("*", *(T.assign_split(F.col(f"_key{n}")).alias(f"_split{n}") for n in keys.values()))
    out = keyed.select(
        crop.alias("crop"), district.alias("district"), F.coalesce(state, F.lit("Maharashtra")).alias("state"),
        render(pack.source).alias("source"), F.explode(F.array(*rows)).alias("r"),
    ).select("crop", "district", "state", "source", "r.*")
    out = out.filter((F.length("question") >= MIN_QUESTION) & (F.length("answer") >= MIN_ANSWER))
    return out.select(
        T.synth_id(F.col("fact_key"), F.col("template_id"), F.col("language")).alias("id"),
        "category", F.lit(pack.subcategory or f"{pack.name}_synth").alias("subcategory"), "crop",
        F.struct("state", "district").alias("region"), "language", "question", "answer", "source",
        "confidence", "split", "fact_key", "template_id",
        F.lit(pack.name).alias("pack"),
    )


def first_per_id(records: DataFrame, order_col: str) -> DataFrame:
    """The first record per id; a partially aggregated minimum, so no id gathers in one task."""
    rest = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.min_by(F.struct(*rest), order_col).alias("r")).select("id", "r.*")


def rollup(records: DataFrame) -> DataFrame:
    """Counts per category, language, pack and split in one pass."""
    dims = ["category", "language", "pack", "split"]
    grouped = records.groupingSets([[d] for d in dims], *dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # a bit of the grouping id is 0 for the dimension that a row counts, so a null value is still counted as its own
    level = {d: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    of = {d: F.col("g") == g for d, g in level.items()}
    return grouped.select(
        F.coalesce(*[F.when(hit, d) for d, hit in of.items()]).alias("dimension"),
        F.coalesce(*[F.when(hit, F.col(d)) for d, hit in of.items()]).alias("value"), "n")


def targets(records: DataFrame, train_min: int = 10_000, val_min: int = 1_000) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "val").alias("val"),
        F.count_if(F.col("split") == "test").alias("test"),
    ).withColumn("train_met", F.col("train") >= train_min).withColumn("val_met", F.col("val") >= val_min)


def taxonomy_facts(spark) -> DataFrame:
    """Crop facts when no crop file was ingested: the taxonomy's own crops."""
    rows = [(en, mr, hi, "taxonomy", "taxonomy") for _, en, mr, hi, _, _ in vocab.CROPS]
    return spark.createDataFrame(rows, "crop string, crop_mr string, crop_hi string, src string, path string") \
        .select(
            "*",
            F.lit("see package of practice").alias("season"), F.lit("as per local soil test").alias("soils"),
            F.lit("scout regularly").alias("pests"), F.lit("monitor weather risk").alias("diseases"),
            F.lit(", ".join(s[1] for s in vocab.CROP_STAGES)).alias("stages"),
        )


def facts_or_taxonomy(facts: DataFrame) -> DataFrame:
    """The given crop facts, or the taxonomy's if there are none."""
    return taxonomy_facts(facts.sparkSession) if facts.isEmpty() else facts
