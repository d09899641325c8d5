"""Query understanding over a table of queries: crops, intents, expansion, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.functions import taxonomy as X
from fieldlake.functions import text as T
from fieldlake.functions import vocab
from fieldlake.operators.retrieval import contains_join
from fieldlake.operators.synth import render
from fieldlake.sources.store import materialize, spread

MAX_EXPANSIONS = 6

# Which tools serve which intent, in call order.
TOOL_ROUTES = [
    (["weather"], ["open_meteo_weather", "local_weather"]),
    (["market"], ["market_prices", "agmarknet_opendata"]),
    (["scheme"], ["government_schemes"]),
    (["disease", "fertilizer", "seed", "irrigation"], ["crop_knowledge"]),
    (["general", "disease", "scheme", "market", "weather"], ["web_search", "wikipedia"]),
]
LAST_TOOL = "open_source_catalog"

# Agents by intent or by a word in the query.
AGENT_ROUTES = [
    ("weather", ["weather", "rain", "पाऊस", "हवामान"], ["weather"]),
    ("disease", ["disease", "pest", "spot", "रोग", "कीड"], ["disease", "vision", "weather"]),
    ("market", ["market", "price", "mandi", "भाव", "बाजार"], ["market"]),
    ("fertilizer", ["fertilizer", "soil", "npk", "खत", "माती"], ["soil", "fertilizer"]),
    ("scheme", ["scheme", "subsidy", "yojana", "योजना", "अनुदान"], ["government"]),
    ("irrigation", [], ["crop", "weather"]),
    ("seed", [], ["crop"]),
    ("finance", [], ["finance"]),
]
DEFAULT_AGENTS = ["weather", "crop", "disease", "market", "soil", "fertilizer", "government", "finance"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def plan_queries(queries: DataFrame, default_crop: Column | None = None) -> DataFrame:
    """Add normalized text, crops, intents, categories, expansions and flags to (qid, query)."""
    df = queries.withColumn("normalized", T.collapse(F.col("query")))
    low = F.lower("normalized")
    crops = X.extract_crops(F.col("normalized"))
    if default_crop is not None:
        fallback = F.coalesce(X.resolve_crop(default_crop), default_crop)
        crops = F.when((F.size(crops) == 0) & (F.coalesce(default_crop, F.lit("")) != ""), F.array(fallback)) \
            .otherwise(crops)
    df = df.select(
        "*", crops.alias("crops"), X.detect_intents(F.col("normalized")).alias("intents"),
        X.detect_categories(F.col("normalized")).alias("categories"),
    )
    triggers = _strings(vocab.WEB_TRIGGERS)
    web = F.exists(triggers, lambda t: F.contains(low, t)) | F.arrays_overlap(
        "intents", _strings(["market", "weather", "scheme"]))
    df = df.withColumn("needs_web", web)
    return df.select(
        "*",
        (F.arrays_overlap("intents", _strings(["weather", "market"])) | F.col("needs_web")).alias("needs_live_tools"),
        F.when(F.col("normalized").rlike(T.DEVANAGARI), "mr").otherwise("en").alias("language_hint"),
        _expansions().alias("expanded"),
    )


def _expansions() -> Column:
    """The query, the query with its first crop, then one line per intent: distinct, at most six."""
    crop = F.get("crops", F.lit(0))
    table = F.create_map(*[
        x for intent, tail in vocab.INTENT_EXPANSIONS.items()
        for x in (F.lit(intent), F.lit(tail.replace("{crop}", "")))
    ])
    lines = F.filter(
        F.transform("intents", lambda i: F.concat(crop, F.try_element_at(table, i))), lambda s: s.isNotNull()
    )
    candidates = F.when(
        crop.isNotNull(), F.concat(F.array("normalized", F.concat(crop, F.lit(" "), "normalized")), lines)
    ).otherwise(F.array("normalized"))
    keyed = F.transform(candidates, lambda s: F.struct(T.strip(F.lower(s)).alias("key"), s.alias("text")))
    keys = F.transform(keyed, lambda s: s["key"])
    first = F.filter(keyed, lambda s, i: (s["key"] != "") & (F.array_position(keys, s["key"]) == i + 1))
    return F.slice(F.transform(first, lambda s: s["text"]), 1, MAX_EXPANSIONS)


def expand_queries(plans: DataFrame) -> DataFrame:
    """(qid, variant, query): one row per expanded query."""
    return plans.select("qid", F.posexplode("expanded").alias("variant", "query"))


def route_tools(intents: Column) -> Column:
    """Ordered distinct tool names for a list of intents."""
    picked = [
        F.when(F.arrays_overlap(intents, _strings(needs)), _strings(tools)).otherwise(_strings([]))
        for needs, tools in TOOL_ROUTES
    ]
    return F.array_distinct(F.concat(*picked, _strings([LAST_TOOL])))


def route_agents(query: Column, intents: Column, has_image: Column | None = None) -> Column:
    """Ordered distinct agents by intents or query words, the default set when none applies."""
    low = F.lower(query)
    picked = []
    for intent, words, agents in AGENT_ROUTES:
        hit = F.array_contains(intents, intent)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        if intent == "disease" and has_image is not None:
            hit = hit | has_image
        picked.append(F.when(hit, _strings(agents)).otherwise(_strings([])))
    chosen = F.array_distinct(F.concat(*picked))
    return F.when(F.size(chosen) > 0, chosen).otherwise(_strings(DEFAULT_AGENTS))


def farm_context(queries: DataFrame, farms: DataFrame) -> DataFrame:
    """Queries with the defaults of their farm; a crop named in the query wins."""
    joined = queries.join(farms, "farm_id", "left")
    named = F.get(X.extract_crops(F.col("query")), F.lit(0))
    return joined.withColumn("context_crop", F.coalesce(named, "farm_crop", F.lit("Pomegranate")))


def search_catalog(
    queries: DataFrame, items: DataFrame, item_id: str, blob: Column, min_token: int = 4,
    fallback: int = 5, cap: int = 8,
) -> DataFrame:
    """Items whose blob contains any query token of `min_token`+ characters.

    An empty query matches every item. A query without a match gets the first `fallback` items;
    each query keeps `cap` items.
    Returns (qid, item_id, matched, rank).
    """
    words_of = F.filter(F.split(F.lower(T.collapse(F.col("query"))), " "), lambda t: F.length(t) >= min_token)
    asked = spread(queries).select("qid", words_of.alias("tokens"), (F.coalesce("query", F.lit("")) == "").alias("blank"))
    # A word's first `cap` items are among the first `cap` of each blob that holds it, so a blob is searched once.
    entries = spread(items).select(F.lower(blob).alias("_blob"), item_id).filter("_blob is not null")
    leading = entries.withColumn("place", F.dense_rank().over(_by("_blob", item_id))).filter(F.col("place") <= cap).drop("place")
    words = asked.select(F.explode("tokens").alias("token")).distinct().withColumn("token_id", F.col("token"))
    blobs = leading.select("_blob").distinct()
    hits = contains_join(words, "token_id", "token", blobs.withColumn("_key", F.col("_blob")), "_key", "_blob").join(
        leading.select(F.col("_blob").alias("_key"), item_id), "_key")
    # A query's first `cap` items are among the first `cap` of its words, so only those meet the queries.
    heads = hits.select("token", item_id).withColumn("place", F.dense_rank().over(_by("token", item_id))).filter(F.col("place") <= cap)
    heads = materialize(heads.drop("place").distinct(), "word-items")
    # Queries of the same words have the same items: these are found once for each list of words.
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tokens", F.array().cast("array<string>"))))))
    wanted = materialize(asked.groupBy("qid").agg(lists.alias("tokens"), F.collect_list("blank").alias("blanks")), "word-lists")
    matched = wanted.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(heads, "token").select("tokens", item_id).distinct()
    first = matched.withColumn("rank", F.row_number().over(_by("tokens", item_id))).filter(F.col("rank") <= cap)
    found = materialize(first.groupBy("tokens").agg(F.sort_array(F.collect_list(item_id)).alias("ids")), "list-items")
    # The first items are at most `cap` or `fallback` rows, so they travel as one array.
    begin = items.select(item_id).orderBy(item_id).limit(max(cap, fallback))
    listed = begin.agg(F.sort_array(F.collect_list(item_id)).alias("ids")).scalar()
    defaults = F.transform("blanks", lambda b: F.struct(b.alias("matched"), F.slice("listed", F.lit(1), F.when(b, cap).otherwise(fallback)).alias("ids")))
    answers = F.when(F.col("ids").isNotNull(), F.array(F.struct(F.lit(True).alias("matched"), F.col("ids")))).otherwise(defaults)
    rows = wanted.join(found, "tokens", "left").withColumn("listed", listed).select("qid", F.explode(answers).alias("a"))
    return rows.select("qid", "a.matched", F.posexplode("a.ids").alias("p", item_id)).select("qid", item_id, "matched", (F.col("p") + 1).alias("rank"))


def _by(partition: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(order)


def lookup_entities(entities: DataFrame, needle: str, cap: int = 20) -> DataFrame:
    """Entities (kind_order, ord, doc_id, title, name, ...) whose name contains `needle`, in
    listing order, at most `cap` rows. An empty needle lists everything up to the cap."""
    hit = F.contains(F.lower("name"), F.lit(needle.lower()))
    return entities.filter(hit).orderBy("kind_order", "ord").limit(cap)


def catalog_documents(sources: DataFrame) -> DataFrame:
    """A source catalogue (ord, name, type, use, url) as searchable documents."""
    return sources.select(
        F.concat(F.lit("tool_catalog_"), "ord").alias("doc_id"), F.lit("Tool:Catalog").alias("category"),
        F.col("name").alias("title"), render("{name} ({type}): {use} — {url}").alias("content"),
        F.lit("open_source_catalog").alias("source"),
    )


def first_rule(hint: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """Value of the first rule with a word contained in the hint, else the default."""
    low = F.lower(F.coalesce(hint, F.lit("")))
    chain = None
    for words, value in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(default)


# Disease by file name or crop hint.
DISEASE_RULES = [
    (["pomegranate", "telyat"], "Bacterial Blight"),
    (["cotton", "bollworm"], "Pink Bollworm"),
    (["soybean", "mosaic"], "Yellow Mosaic"),
    (["onion", "purple"], "Purple Blotch"),
]


def diagnose(hints: DataFrame, diseases: DataFrame, hint: Column, default_name: str = "Bacterial Blight",
             rules: list[tuple[list[str], str]] | None = None) -> DataFrame:
    """Disease facts for each hint by the rule table, with a default row."""
    named = hints.withColumn("disease", first_rule(hint, rules or DISEASE_RULES, default_name))
    return named.join(diseases, "disease", "left")
