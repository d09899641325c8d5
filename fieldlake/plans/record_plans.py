"""Registered queries: standard records, coverage statistics and synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.functions import templates as TP
from fieldlake.functions import text as T
from fieldlake.functions import vocab
from fieldlake.operators import coverage, standardize, synth
from fieldlake.plans import sql as S
from fieldlake.plans.sql import query
from fieldlake.session import table
from fieldlake.sources import lake
from fieldlake.sources.store import materialize

# --- records from conversations: a user turn and the assistant turn after it -----------------

KEYWORDS = S.values("kw", ["cat", "word", "ord"], [
    (c, w.lower(), i) for i, (c, ws) in enumerate(vocab.CATEGORY_KEYWORDS.items()) for w in ws])

RECORDS = f"""
WITH {KEYWORDS}, p AS (SELECT q.conv_id, q.turn, {S.strip('q.text')} AS question, {S.strip('a.text')} AS answer,
    'conversations/' || q.conv_id || '/' || q.turn AS path
  FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'),
k AS (SELECT *, 'std_' || substr(sha256('conversations|' || substr(question, 1, 80) || '|' || substr(answer, 1, 80)
    || '|' || path), 1, 16) AS id FROM p WHERE length(question) >= 5 AND length(answer) >= 5),
l AS (SELECT *, {S.language('question')} AS lq, {S.language('answer')} AS la FROM k),
cats AS (SELECT id, min(ord) AS o FROM k JOIN kw ON contains(lower(question || ' ' || answer), word) GROUP BY id),
records AS (SELECT id, conv_id, turn, 'general' AS category,
    coalesce((SELECT any_value(cat) FROM kw WHERE ord = cats.o), 'general') AS subcategory,
    {S.pair_language('lq', 'la')} AS language, question, answer, path, 0.75::DOUBLE AS confidence,
    {S.split_of('l.id')} AS split FROM l LEFT JOIN cats USING (id))
"""


def _pairs(spark, sf):
    p = standardize.conversation_pairs(table(spark, sf, "conversations"))
    return p.select(
        F.concat(F.lit("conversations/"), "conv_id", F.lit("/"), "turn").alias("source_path"),
        F.lit("general").alias("domain"), F.lit("conversations").alias("list_key"),
        T.strip(F.col("question")).alias("question"), T.strip(F.col("answer")).alias("answer"),
        F.lit(None).cast("string").alias("crop"), F.lit(None).cast("string").alias("subcategory"),
        F.lit(0.75).alias("confidence"))


def _records(spark, sf):
    return standardize.to_records(_pairs(spark, sf))


@query("q_standardize", RECORDS + """
SELECT id, category, subcategory, language, sha256(question) AS q_hash, sha256(answer) AS a_hash,
  'lake_processed:' || path AS source, confidence, split FROM records""")
def standardize_conversations(spark, sf):
    return _records(spark, sf).select(
        "id", "category", "subcategory", "language", F.sha2("question", 256).alias("q_hash"),
        F.sha2("answer", 256).alias("a_hash"), "source", "confidence", "split")


MARKET_SQL = """
WITH m AS (SELECT p_name AS crop, s_name AS mandi, n_name AS district, l_extendedprice / l_quantity AS modal,
    l_returnflag AS trend, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)
"""


def _market_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_tax")
    return (
        li.join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("p_name").alias("crop"), "p_type", F.col("s_name").alias("mandi"), F.col("n_name").alias("district"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("modal_price_rs_quintal"),
            F.col("l_returnflag").alias("trend"), "l_orderkey", "l_linenumber", "l_tax"))


@query("q_standardize_markets", MARKET_SQL + f""",
k AS (SELECT 'What is the mandi price for ' || crop || ' at ' || mandi || '?' AS q,
  crop || ' at ' || mandi || ', ' || district || ': modal ₹' || CAST(CAST(round(modal, 0) AS BIGINT) AS VARCHAR)
  || '/q (min None, max None). Trend: ' || trend || '.' AS a, l_orderkey, l_linenumber FROM m),
i AS (SELECT 'std_' || substr(sha256('markets|' || substr(q, 1, 80) || '|' || substr(a, 1, 80) || '|market/'
  || l_orderkey || '-' || l_linenumber), 1, 16) AS id, q, a FROM k)
SELECT {S.split_of('id')} AS split, 'market' AS category, count(*) AS n, CAST(sum(length(q) + length(a)) AS BIGINT) AS chars,
  min(id) AS first_id, max(id) AS last_id FROM i GROUP BY ALL""")
def standardize_markets(spark, sf):
    m = _market_rows(spark, sf)
    items = m.select(
        "crop", "mandi", "district", "trend", F.round("modal_price_rs_quintal", 0).cast("bigint").alias("modal_price_rs_quintal"),
        F.lit("market").alias("domain"), F.concat(F.lit("market/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("source_path"))
    r = standardize.standardize(items, "markets")
    return r.groupBy("split", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("question") + F.length("answer")).alias("chars"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("q_explode_lists", """
WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders)
SELECT 'crops' AS list_key, o_orderpriority AS domain, count(*) AS items, CAST(sum(o_orderkey) AS BIGINT) AS total FROM o GROUP BY 2
UNION ALL SELECT 'records', o_orderpriority, 2 * count(*), CAST(sum(2 * o_orderkey + 1) AS BIGINT) FROM o
  WHERE o_orderstatus = 'F' GROUP BY 2""")
def explode_lists(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    crops = F.concat(F.lit('"crops": [{"v": '), k, F.lit("}]"))
    records = F.concat(F.lit(', "records": [{"v": '), k, F.lit('}, {"v": '), (F.col("o_orderkey") + 1).cast("string"), F.lit("}]"))
    body = F.concat(F.lit("{"), crops, F.when(F.col("o_orderstatus") == "F", records).otherwise(""), F.lit("}"))
    lists = standardize.explode_lists(o.select(F.col("o_orderpriority").alias("domain"), body.alias("payload")))
    return lists.groupBy("list_key", "domain").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.variant_get("item", "$.v", "bigint")).alias("total"))


@query("q_cap_per_file", """
SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn <= 25""")
def cap_per_file(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return standardize.cap_per_file(o, "o_orderpriority", "o_orderkey", 25)


@query("q_coverage_stats", RECORDS + """
SELECT count(*) AS total, count(*) FILTER (language <> 'unknown') AS with_language, count(*) AS with_category,
  round(100.0 * count(*) FILTER (language <> 'unknown') / count(*), 2)::DOUBLE AS language_pct, 100.0::DOUBLE AS category_pct,
  100.0 * count(*) FILTER (language <> 'unknown') / count(*) >= 90 AS ok FROM records""")
def coverage_stats(spark, sf):
    return coverage.coverage_stats(_records(spark, sf))


@query("q_normalize_metrics", RECORDS + """
SELECT split AS category, count(*) AS records, count(*) FILTER (turn > 1) AS with_crop FROM records GROUP BY 1""")
def normalize_metrics(spark, sf):
    r = _records(spark, sf).withColumn("category", F.col("split"))
    turn = F.split("source", "/")[2].cast("bigint")
    return coverage.normalize_metrics(r.withColumn("crop", F.when(turn > 1, "Onion")))


@query("q_split_balance", f"""
SELECT {S.split_of('CAST(doc_id AS VARCHAR)')} AS split, lang, count(*) AS n FROM documents GROUP BY ALL""")
def split_balance(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(T.assign_split(F.col("doc_id").cast("string")).alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("q_leakage", f"""
WITH r AS (SELECT source AS fact_key, CASE WHEN lang = 'es' THEN 'test' ELSE {S.split_of('source')} END AS split FROM documents)
SELECT fact_key, min(split) AS first_split, max(split) AS last_split, count(*) AS n FROM r GROUP BY 1
HAVING min(split) <> max(split)""")
def leakage(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("fact_key"),
        F.when(F.col("lang") == "es", "test").otherwise(T.assign_split(F.col("source"))).alias("split"))
    return coverage.leakage(d)


# --- coverage of a record table -----------------------------------------------------------------

PROFILE = """
WITH r AS (SELECT d.doc_id, NULLIF(text, '') AS question, CASE WHEN l.quality = 1 THEN source ELSE '' END AS source,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE lang END AS language, l.quality AS verified,
  CASE WHEN d.doc_id % 3 = 0 THEN [lang] ELSE [] END AS tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def _profile(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id", F.nullif("text", F.lit("")).alias("question"),
        F.when(F.col("quality") == 1, F.col("source")).otherwise("").alias("source"),
        F.when(F.col("hit"), F.col("lang")).alias("language"), F.col("quality").alias("verified"),
        F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("tags"))


@query("q_missingness", PROFILE + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({cond}) AS missing, count(*) AS n FROM r" for f, cond in [
        ("question", "question IS NULL"), ("source", "source = ''"), ("language", "language IS NULL"),
        ("verified", "verified IS NULL"), ("tags", "len(tags) = 0")]) + """)
SELECT field, missing, round(100.0::DOUBLE * missing / n, 2) AS missing_pct FROM m""")
def missingness(spark, sf):
    return coverage.missingness(_profile(spark, sf), ["question", "source", "language", "verified", "tags"])


@query("q_balance", PROFILE + """
SELECT 'language' AS dimension, coalesce(language, 'unknown') AS value, count(*) AS n FROM r GROUP BY 2
UNION ALL SELECT 'source', CASE WHEN source = '' THEN 'unknown' ELSE source END, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'verified', coalesce(CAST(verified AS VARCHAR), 'unknown'), count(*) FROM r GROUP BY 2""")
def balance(spark, sf):
    return coverage.balance(_profile(spark, sf), ["language", "source", "verified"])


@query("q_topn", PROFILE + """
SELECT CASE WHEN source = '' THEN '(none)' ELSE source END AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def topn(spark, sf):
    return coverage.top_values(_profile(spark, sf), "source", 15)


@query("q_distinct_values", "SELECT count(DISTINCT p_name) AS distinct_values FROM part")
def distinct_values(spark, sf):
    return coverage.distinct_values(table(spark, sf, "part"), "p_name")


QA = "(SELECT 'text' AS field, text AS v FROM documents UNION ALL SELECT 'source', source FROM documents)"


@query("q_length_stats", f"""
SELECT field, CAST(min(length(v)) AS INTEGER) AS min, CAST(max(length(v)) AS INTEGER) AS max, round(avg(length(v)), 1) AS mean,
  quantile_cont(length(v)::DOUBLE, 0.5) AS p50, quantile_cont(length(v)::DOUBLE, 0.9) AS p90 FROM {QA} GROUP BY 1""")
def length_stats(spark, sf):
    return coverage.length_stats(table(spark, sf, "documents"), ["text", "source"])


@query("q_profile_merge", """
WITH d AS (SELECT source, text FROM documents UNION ALL SELECT NULL, text FROM documents)
SELECT coalesce(source, '(all)') AS scope, count(*) AS n, count(DISTINCT text) AS distinct_texts, TRUE AS distinct_near, TRUE AS p50_near, TRUE AS p90_near FROM d GROUP BY source""")
def profile_merge(spark, sf):
    """Sketches of every source, merged for the whole, against exact counts: distinct within 6 %, quantiles within 4 % of ranks."""
    d = table(spark, sf, "documents").select(F.coalesce("source", F.lit("(none)")).alias("scope"), "text")
    parts = materialize(coverage.profile_parts(d, "text", "scope"), "profile-parts")
    every = coverage.merge_profiles(parts).select(F.lit("(all)").alias("scope"), "n", "values", "lengths")
    found = materialize(coverage.profile_estimates(parts.unionByName(every)), "profile-estimates")
    both = d.unionByName(d.withColumn("scope", F.lit("(all)")))
    exact = both.groupBy("scope").agg(F.count_distinct("text").alias("distinct_texts"))
    lens = both.groupBy("scope", F.length("text").alias("len")).agg(F.count(F.lit(1)).alias("k"))

    def rank_near(p: str, rank: float):
        # some rank of the estimate's ties must be near the asked one
        low = F.sum(F.when(F.col("len") < F.col(p), F.col("k")).otherwise(0)) / F.sum("k")
        high = F.sum(F.when(F.col("len") <= F.col(p), F.col("k")).otherwise(0)) / F.sum("k")
        return ((low <= rank + 0.04) & (high >= rank - 0.04)).alias(f"{p}_near")

    ranks = lens.where("len is not null").join(found, "scope").groupBy("scope").agg(rank_near("p50", 0.5), rank_near("p90", 0.9))
    return found.join(exact, "scope").join(ranks, "scope").select(
        "scope", "n", "distinct_texts", (F.abs(F.col("distinct") - F.col("distinct_texts")) <= F.greatest(F.lit(1.0), 0.06 * F.col("distinct_texts"))).alias("distinct_near"), "p50_near", "p90_near")


BINS = S.values("bins", ["lo", "hi", "bin"], [
    (a, b, f"{a}-{b - 1}") for a, b in zip(coverage.LENGTH_BINS, coverage.LENGTH_BINS[1:])] + [(10_000, 10**12, "10000+")])


@query("q_histogram", f"""
WITH {BINS}, f AS (SELECT DISTINCT field FROM {QA}), q AS {QA}
SELECT f.field, bin, count(v) AS n FROM f CROSS JOIN bins LEFT JOIN q ON q.field = f.field AND length(v) >= lo AND length(v) < hi
GROUP BY ALL""")
def histogram(spark, sf):
    return coverage.histogram(table(spark, sf, "documents"), ["text", "source"])


@query("q_confidence", """
WITH c AS (SELECT coalesce(TRY_CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 'n/a' ELSE CAST(round(c_acctbal / 10000, 4) AS VARCHAR) END AS DOUBLE), 0) AS v FROM customer)
SELECT round(avg(v), 3) AS mean, min(v) AS min, max(v) AS max FROM c""")
def confidence(spark, sf):
    c = table(spark, sf, "customer")
    v = F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.round(F.col("c_acctbal") / 10000, 4).cast("string"))
    return coverage.confidence_stats(c.select(v.alias("confidence")))


@query("q_dup_rate", """
WITH d AS (SELECT lower(lang) AS q, lower(text) AS a FROM documents)
SELECT count(*) AS total, count(DISTINCT (q, a)) AS unique_qa, count(*) - count(DISTINCT (q, a)) AS exact_qa_duplicates,
  round(100.0::DOUBLE * (count(*) - count(DISTINCT (q, a))) / count(*), 2) AS duplicate_rate_pct FROM d""")
def dup_rate(spark, sf):
    return coverage.duplicate_rate(table(spark, sf, "documents"), "lang", "text")


CATALOG = S.values("cat", ["id"], [(c,) for c in vocab.CATEGORIES])
GAP_KIND = "CASE lang WHEN 'en' THEN 'general' WHEN 'fr' THEN 'market' WHEN 'de' THEN 'soil' ELSE lang END"


@query("q_gaps", f"""
WITH {CATALOG}, present AS (SELECT DISTINCT {GAP_KIND} AS id FROM documents)
SELECT 'category' AS type, id, 'high' AS severity FROM cat WHERE id NOT IN (SELECT id FROM present)
UNION ALL SELECT 'category', id, 'extra' FROM present WHERE id NOT IN (SELECT id FROM cat)
UNION ALL SELECT 'unlabelled', CAST(d.doc_id AS VARCHAR), 'medium' FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
UNION ALL SELECT 'volume', 'finance', 'medium' WHERE (SELECT count(*) FROM documents WHERE lang = 'finance') < 5""")
def gaps(spark, sf):
    d = table(spark, sf, "documents")
    lang = F.col("lang")
    kind = F.when(lang == "en", "general").when(lang == "fr", "market").when(lang == "de", "soil").otherwise(lang)
    present = d.select(kind.alias("id")).distinct()
    wanted = spark.createDataFrame([(c,) for c in vocab.CATEGORIES], "id string")
    ids = d.select(F.col("doc_id").cast("string").alias("id"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return (
        coverage.gaps(wanted, present, "category", "high")
        .unionByName(coverage.extras(wanted, present, "category"))
        .unionByName(coverage.gaps(ids, labelled, "unlabelled", "medium"))
        .unionByName(coverage.volume_gap(d, "lang", "finance", 5)))


# --- synthesis ------------------------------------------------------------------------------------

CROP_FACTS = """facts AS (SELECT p_name || ' ' || p_partkey AS crop, p_name || ' ' || p_partkey AS crop_mr,
  p_name || ' ' || p_partkey AS crop_hi, p_type AS season, p_brand AS soils, 'scout regularly' AS pests,
  'monitor weather risk' AS diseases, CAST(p_size AS VARCHAR) AS stages, 'ICAR/SAU open advisory' AS src,
  'part' AS path, NULL AS district FROM part)"""


def _crop_facts(spark, sf):
    name = F.concat("p_name", F.lit(" "), "p_partkey")
    return table(spark, sf, "part").select(
        name.alias("crop"), name.alias("crop_mr"), name.alias("crop_hi"), F.col("p_type").alias("season"),
        F.col("p_brand").alias("soils"), F.lit("scout regularly").alias("pests"),
        F.lit("monitor weather risk").alias("diseases"), F.col("p_size").cast("string").alias("stages"),
        F.lit("ICAR/SAU open advisory").alias("src"), F.lit("part").alias("path"))


TYPE_FACTS = """facts AS (SELECT DISTINCT p_type AS crop, p_type AS crop_mr, p_type AS crop_hi, 'part' AS path FROM part)"""


def _type_facts(spark, sf):
    kind = F.col("p_type")
    return table(spark, sf, "part").select(kind.alias("crop")).distinct().select(
        "crop", F.col("crop").alias("crop_mr"), F.col("crop").alias("crop_hi"), F.lit("part").alias("path"))


def _synth_rows(pack: str, facts: str, name: str) -> str:
    """Check rows of one pack: the templates as VALUES, filled by replace()."""
    p = synth.PACKS[pack]
    rows = []
    for tid, lang, q, a, conf in p.questions:
        cut = f"substr({S.rendered(q)}, 1, {p.question_limit})" if p.question_limit else S.rendered(q)
        rows.append(
            f"SELECT {S.rendered(tid)} AS template_id, '{lang}' AS language, {S.strip(cut)} AS question, "
            f"{S.strip(S.rendered(p.answers[a]))} AS answer, {conf!r}::DOUBLE AS confidence, "
            f"{S.rendered(p.fact_keys.get(tid, p.fact_key))} AS fact_key, '{p.categories.get(tid, p.category)}' AS category, "
            f"'{pack}' AS pack FROM {facts}")
    return f"{name} AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE length(question) >= 8 AND length(answer) >= 12)"


SYNTH_OUT = f"""SELECT 'syn_' || substr(sha256(fact_key || '|' || template_id || '|' || language), 1, 20) AS id, category, pack,
  language, confidence, fact_key, template_id, {S.split_of('fact_key')} AS split, question, answer"""


def _out(df):
    return df.select("id", "category", "pack", "language", "confidence", "fact_key", "template_id", "split", "question", "answer")


@query("q_synth_crop", f"WITH {CROP_FACTS}, {_synth_rows('crop', 'facts', 's')}, {_synth_rows('paraphrase', 'facts', 'y')} "
       f"{SYNTH_OUT} FROM (SELECT * FROM s UNION ALL SELECT * FROM y)")
def synth_crop(spark, sf):
    facts = _crop_facts(spark, sf)
    return _out(synth.synthesize(facts, "crop").unionByName(synth.synthesize(facts, "paraphrase")))


DISEASE_FACTS = """facts AS (SELECT s_name AS name, s_name || ' MR' AS name_mr, n_name AS crop, n_name AS crop_mr,
  'spots ' || s_suppkey AS symptoms, 'spots ' || s_suppkey AS symptoms_mr, 'Use cultural IPM and approved biopesticides.' AS organic,
  'Use labeled chemistry only after ETL and advice.' AS chemical, 'supplier' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("q_synth_disease", f"WITH {DISEASE_FACTS}, {_synth_rows('disease', 'facts', 's')} {SYNTH_OUT} FROM s")
def synth_disease(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sym = F.concat(F.lit("spots "), "s_suppkey")
    facts = s.select(
        F.col("s_name").alias("name"), F.concat("s_name", F.lit(" MR")).alias("name_mr"), F.col("n_name").alias("crop"),
        F.col("n_name").alias("crop_mr"), sym.alias("symptoms"), sym.alias("symptoms_mr"),
        F.lit("Use cultural IPM and approved biopesticides.").alias("organic"),
        F.lit("Use labeled chemistry only after ETL and advice.").alias("chemical"), F.lit("supplier").alias("path"))
    return _out(synth.synthesize(facts, "disease"))


FERT_FACTS = """facts AS (SELECT p_name || ' ' || p_partkey AS crop, p_name AS crop_mr, p_size AS n, p_size + 1 AS p, CAST(NULL AS INTEGER) AS k,
  p_brand AS basal, p_type AS top, 'Correct deficiencies after soil test' AS micro, 'part' AS path FROM part)"""


@query("q_synth_fertilizer", f"WITH {FERT_FACTS}, {_synth_rows('fertilizer', 'facts', 's')} {SYNTH_OUT} FROM s")
def synth_fertilizer(spark, sf):
    facts = table(spark, sf, "part").select(
        F.concat("p_name", F.lit(" "), "p_partkey").alias("crop"), F.col("p_name").alias("crop_mr"), F.col("p_size").alias("n"),
        (F.col("p_size") + 1).alias("p"), F.lit(None).cast("int").alias("k"), F.col("p_brand").alias("basal"),
        F.col("p_type").alias("top"), F.lit("Correct deficiencies after soil test").alias("micro"), F.lit("part").alias("path"))
    return _out(synth.synthesize(facts, "fertilizer"))


SCHEME_FACTS = """facts AS (SELECT c_name AS name, c_name || ' MR' AS name_mr, c_mktsegment AS benefits, c_mktsegment AS benefits_mr,
  'balance ' || CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS VARCHAR) AS elig, '' AS docs, 'Aadhaar, land records as applicable' AS docs_or_default,
  '' AS portal, 'state agriculture portal' AS portal_or_default, 'customer' AS path FROM customer)"""


@query("q_synth_scheme", f"WITH {SCHEME_FACTS}, {_synth_rows('scheme', 'facts', 's')} {SYNTH_OUT} FROM s")
def synth_scheme(spark, sf):
    facts = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.concat("c_name", F.lit(" MR")).alias("name_mr"),
        F.col("c_mktsegment").alias("benefits"), F.col("c_mktsegment").alias("benefits_mr"),
        F.concat(F.lit("balance "), F.round("c_acctbal", 0).cast("bigint")).alias("elig"), F.lit("").alias("docs"),
        F.lit("Aadhaar, land records as applicable").alias("docs_or_default"), F.lit("").alias("portal"),
        F.lit("state agriculture portal").alias("portal_or_default"), F.lit("customer").alias("path"))
    return _out(synth.synthesize(facts, "scheme"))


MARKET_FACTS = """facts AS (SELECT p_name AS crop, s_name AS mandi, n_name AS district, CAST(avg(round(l_extendedprice)) AS BIGINT) AS modal,
  CAST(min(round(l_extendedprice)) AS BIGINT) AS min, CAST(max(round(l_extendedprice)) AS BIGINT) AS max, max(l_returnflag) AS trend,
  CAST(NULL AS VARCHAR) AS date, 'lineitem' AS path FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY p_name, s_name, n_name)"""


@query("q_synth_market", f"WITH {MARKET_FACTS.replace('CAST(avg(round(l_extendedprice)) AS BIGINT)', 'CAST(max(round(l_extendedprice)) AS BIGINT)')}, "
       f"{_synth_rows('market', 'facts', 's')} {SYNTH_OUT} FROM s")
def synth_market(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    # Aggregate on the narrow keys first; names join afterwards.
    price = F.round("l_extendedprice").cast("bigint")
    by_key = li.groupBy("l_partkey", "l_suppkey").agg(
        F.min(price).alias("min"), F.max(price).alias("max"), F.max("l_returnflag").alias("trend"))
    named = (
        by_key.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")))
    facts = named.groupBy(F.col("p_name").alias("crop"), F.col("s_name").alias("mandi"), F.col("n_name").alias("district")).agg(
        F.max("max").alias("modal"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("trend").alias("trend"))
    facts = facts.withColumn("date", F.lit(None).cast("string")).withColumn("path", F.lit("lineitem"))
    return _out(synth.synthesize(facts, "market"))


ADVISORY_FACTS = """facts AS (SELECT text AS title, substr(text, 1, 80) AS title_80, source AS content, 'benchmark' AS path
  FROM (SELECT text, 'Follow local agri advisory.' AS source FROM benchmark))"""


@query("q_synth_advisory", f"WITH {ADVISORY_FACTS}, {_synth_rows('advisory', 'facts', 's')} {SYNTH_OUT} FROM s")
def synth_advisory(spark, sf):
    facts = table(spark, sf, "benchmark").select(
        F.col("text").alias("title"), F.substring("text", 1, 80).alias("title_80"),
        F.lit("Follow local agri advisory.").alias("content"), F.lit("benchmark").alias("path"))
    return _out(synth.synthesize(facts, "advisory"))


GRID_DIMS = ", ".join([
    S.values("st", ["stage_id", "stage", "stage_mr", "stage_hi"], vocab.CROP_STAGES),
    S.values("di", ["district"], [(d,) for d in vocab.district_names()]),
    S.values("so", ["soil"], [(s,) for s in TP.SOILS]),
    S.values("mo", ["month", "month_mr", "month_hi"], TP.MONTHS),
    S.values("pr", ["practice_id", "practice", "practice_mr", "practice_hi", "practice_answer"], TP.PRACTICES),
])
GRID = [("stage", "facts CROSS JOIN st"), ("irrigation", "facts CROSS JOIN di"), ("weather", "facts CROSS JOIN di"),
        ("safety", "facts"), ("finance", "facts"), ("machinery", "facts"), ("soil", "facts CROSS JOIN so"), ("seed", "facts"),
        ("calendar", "facts CROSS JOIN mo"), ("practice", "facts CROSS JOIN pr")]
GRID_SQL = (f"WITH {TYPE_FACTS}, {GRID_DIMS}, " + ", ".join(_synth_rows(p, f, f"g_{p}") for p, f in GRID)
            + ", grid AS (" + " UNION ALL ".join(f"SELECT * FROM g_{p}" for p, _ in GRID) + ")")


def _grid(spark, sf):
    facts = _type_facts(spark, sf)
    sides = {"stage": synth.with_stages, "irrigation": synth.with_districts, "weather": synth.with_districts,
             "soil": synth.with_soils, "calendar": synth.with_months, "practice": synth.with_practices}
    out = None
    for p, _ in GRID:
        rows = synth.synthesize(sides.get(p, lambda f: f)(facts), p)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("q_synth_grid", f"{GRID_SQL} {SYNTH_OUT} FROM grid")
def synth_grid(spark, sf):
    return _out(_grid(spark, sf))


@query("q_synth_rollup", f"{GRID_SQL}, o AS ({SYNTH_OUT} FROM grid) "
       "SELECT 'category' AS dimension, category AS value, count(*) AS n FROM o GROUP BY 2 "
       "UNION ALL SELECT 'language', language, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'pack', pack, count(*) FROM o GROUP BY 2 "
       "UNION ALL SELECT 'split', split, count(*) FROM o GROUP BY 2")
def synth_rollup(spark, sf):
    return synth.rollup(_grid(spark, sf))


@query("q_synth_targets", f"WITH {CROP_FACTS}, {_synth_rows('crop', 'facts', 's')}, o AS ({SYNTH_OUT} FROM s) "
       "SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, "
       "count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'train') >= 10000 AS train_met, "
       "count(*) FILTER (split = 'val') >= 1000 AS val_met FROM o")
def synth_targets(spark, sf):
    return synth.targets(synth.synthesize(_crop_facts(spark, sf), "crop"))


@query("q_review_queue", f"{GRID_SQL}, o AS ({SYNTH_OUT} FROM grid), k AS (SELECT greatest(1, 500 // count(DISTINCT category)) AS per FROM o), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM o) "
       "SELECT id, category, language, split FROM r WHERE rn <= (SELECT per FROM k) ORDER BY category, id LIMIT 500")
def review_queue(spark, sf):
    return coverage.review_sample(_grid(spark, sf), "category", "id", 500).select("id", "category", "language", "split")


# --- sinks: write a dataset version, read it back -----------------------------------------------------

@query("q_export_dataset", RECORDS + """
SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test, round(100.0 * count(*) FILTER (language <> 'unknown') / count(*), 2)::DOUBLE AS language_pct,
  '1.0' AS schema_version FROM records""")
def export_dataset(spark, sf):
    from fieldlake.streaming.feeds import sink_folder

    manifest = lake.export_dataset(_records(spark, sf), sink_folder(spark, "dataset"))
    return manifest.select("total", "train", "val", "test", "language_pct", "schema_version")


@query("q_review_csv", f"{GRID_SQL}, o AS ({SYNTH_OUT} FROM grid), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM o) "
       "SELECT category, count(*) AS n, CAST(sum(length(question)) AS BIGINT) AS q_chars, CAST(sum(length(substr(answer, 1, 500))) AS BIGINT) AS a_chars, "
       "'false' AS verified FROM r WHERE rn <= 500 // (SELECT count(DISTINCT category) FROM o) GROUP BY 1")
def review_csv(spark, sf):
    """The review queue written as CSV and read back."""
    from fieldlake.streaming.feeds import sink_folder

    path = sink_folder(spark, "review")
    lake.write_review_queue(coverage.review_sample(_grid(spark, sf), "category", "id", 500), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).cast("bigint").alias("q_chars"),
        F.sum(F.length("answer")).cast("bigint").alias("a_chars"), F.max("verified").alias("verified"))


@query("q_tolerant_reader", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_type <> 'error' GROUP BY 1")
def tolerant_reader(spark, sf):
    """JSON lines with broken lines between them: the broken ones are skipped."""
    from fieldlake.streaming.feeds import sink_folder

    path = sink_folder(spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type"))
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", '{"event_id": ').otherwise(line).alias("value"))
    e.write.text(path)
    rows = lake.read_records(spark, path, "event_id bigint, event_type string")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("q_analysis_report", RECORDS + """, wanted AS (SELECT unnest(['Cotton', 'general', 'soil']) AS id)
SELECT 'records' AS section, 'total' AS item, count(*)::DOUBLE AS value FROM records
UNION ALL SELECT 'duplicates', 'exact_qa_duplicates', (count(*) - count(DISTINCT (lower(question), lower(answer))))::DOUBLE FROM records
UNION ALL SELECT 'missing', f, CASE WHEN f IN ('crop') THEN count(*) ELSE 0 END::DOUBLE FROM records,
  (SELECT unnest(['id', 'category', 'subcategory', 'crop', 'language', 'question', 'answer', 'source', 'split', 'schema_version', 'region', 'confidence', 'verified']) AS f) GROUP BY f
UNION ALL SELECT 'balance', 'language:' || language, count(*)::DOUBLE FROM records GROUP BY language
UNION ALL SELECT 'balance', 'category:' || category, count(*)::DOUBLE FROM records GROUP BY category
UNION ALL SELECT 'balance', 'split:' || split, count(*)::DOUBLE FROM records GROUP BY split
UNION ALL SELECT 'length', f || ':' || s, CASE s WHEN 'min' THEN min(n) WHEN 'max' THEN max(n) WHEN 'mean' THEN round(avg(n), 1)
  WHEN 'p50' THEN quantile_cont(n, 0.5) ELSE quantile_cont(n, 0.9) END FROM (SELECT 'question' AS f, length(question)::DOUBLE AS n FROM records
  UNION ALL SELECT 'answer', length(answer)::DOUBLE FROM records), (SELECT unnest(['min', 'max', 'mean', 'p50', 'p90']) AS s) GROUP BY f, s
UNION ALL SELECT 'gap', 'crop:Cotton', 1.0::DOUBLE UNION ALL SELECT 'gap', 'category:soil', 1.0::DOUBLE""")
def analysis_report(spark, sf):
    crops = spark.createDataFrame([("Cotton",)], "id string")
    cats = spark.createDataFrame([("general",), ("soil",)], "id string")
    return coverage.analysis_report(_records(spark, sf), crops, cats)


def _entity_tables(spark, sf):
    """The eleven entity lists of a knowledge base, filled from the star-schema tables."""
    p, s, c, n = (table(spark, sf, x) for x in ("part", "supplier", "customer", "nation"))
    o, r, b = (table(spark, sf, x) for x in ("orders", "region", "benchmark"))
    arr = F.array("p_type", "p_brand")
    no = F.lit(None).cast("string")
    span = F.struct(F.col("p_size").cast("double").alias("min"), (F.col("p_size") + 5.0).alias("max"))
    key = F.col("p_partkey").cast("string")
    return {
        "crops": p.select(F.col("p_partkey").alias("ord"), key.alias("crop_id"), F.col("p_name").alias("name_en"), F.col("p_type").alias("name_mr"),
                          F.lit("sci").alias("scientific_name"), F.col("p_brand").alias("season"), arr.alias("ideal_soil"), span.alias("ideal_temp_c"),
                          span.alias("ideal_rainfall_mm"), F.col("p_size").cast("string").alias("duration_days"), arr.alias("growth_stages"),
                          arr.alias("major_pests"), arr.alias("major_diseases"), no.alias("source")),
        "diseases_and_pests": s.select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name_en"),
                                       no.alias("name_mr"), F.lit("Onion").alias("crop_en"), *[F.lit(x).alias(x) for x in (
                                           "symptoms_en", "symptoms_mr", "organic_control_en", "organic_control_mr", "chemical_control_en",
                                           "chemical_control_mr")], F.lit("ICAR").alias("source")),
        "soil_types": n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("Soil "), "n_name").alias("type"), no.alias("type_mr"),
                               F.lit("deep").alias("characteristics_en"), no.alias("characteristics_mr"), F.array("n_name").alias("suitable_crops")),
        "fertilizer_recommendations": p.select(
            F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" ("), key, F.lit(")")).alias("crop_en"), no.alias("crop_mr"),
            F.struct(F.lit("1").alias("N"), F.lit("2").alias("P"), no.alias("K")).alias("recommended_npk_kg_per_acre"),
            *[no.alias(x) for x in ("basal_dose", "basal_dose_mr", "top_dressing", "top_dressing_mr", "micronutrients", "source")]),
        "schemes": c.select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("scheme_id"), F.col("c_name").alias("name_en"),
                            no.alias("name_mr"), F.col("c_mktsegment").alias("benefits_en"), no.alias("benefits_mr"), no.alias("eligibility_en"),
                            no.alias("eligibility_mr"), F.array(F.lit("card")).alias("documents_required"), no.alias("portal"), no.alias("source")),
        "markets": o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("mandi"), F.lit("Pune").alias("district"),
                            F.lit("Maharashtra").alias("state"), F.col("o_orderstatus").alias("crop"), no.alias("crop_mr"), no.alias("variety"),
                            *[F.col("o_custkey").cast("string").alias(x) for x in ("min_price_rs_quintal", "max_price_rs_quintal", "modal_price_rs_quintal")],
                            no.alias("arrival_tonnes"), no.alias("date"), F.lit("up").alias("trend"), no.alias("source")),
        "advisories": b.select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("id"), F.lit("Advice").alias("title_en"),
                               no.alias("title_mr"), F.col("text").alias("content_en"), no.alias("content_mr"), no.alias("category"), no.alias("source")),
        "varieties": p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("crop_en"), F.col("p_brand").alias("variety"),
                              no.alias("notes_mr"), no.alias("agro_climatic_fit"), no.alias("source")),
        "practices": r.select(F.col("r_regionkey").alias("ord"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"),
                              F.lit("drip").alias("content"), F.array("r_name").alias("crops"), no.alias("source")),
        "zones": n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("zone"), F.array("n_name").alias("districts"),
                          F.lit("600").alias("rainfall_mm"), F.array("n_name").alias("recommended_crops"), no.alias("notes")),
        "sources": r.select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.lit("http").alias("url"), F.lit("api").alias("type"),
                            F.lit("prices").alias("use")),
    }


@query("q_kb_documents", """
SELECT 'Crop' AS category, 'crop_' || p_partkey AS id, 'Crop Guide: ' || p_name || ' (' || p_type || ')' AS title, 'Crop: ' || p_name || ' (' || p_type || '). Scientific: sci. Season: '
  || p_brand || '. Ideal soil: ' || p_type || ', ' || p_brand || '. Ideal temp: ' || p_size::DOUBLE || '-' || (p_size + 5.0::DOUBLE) || '°C. Ideal rainfall: ' || p_size::DOUBLE || '-'
  || (p_size + 5.0::DOUBLE) || ' mm. Duration: ' || p_size || ' days. Stages: ' || p_type || ', ' || p_brand || '. Major pests: ' || p_type || ', ' || p_brand || '. Major diseases: '
  || p_type || ', ' || p_brand || '. Source: ICAR/SAU open advisory.' AS content, 'local_kb' AS source FROM part
UNION ALL SELECT 'Disease', 'disease_' || s_suppkey, 'Disease & Pest: ' || s_name || ' () in Onion', 'Disease/Pest: ' || s_name || ' () affecting Onion. Symptoms (English): symptoms_en. '
  || 'Symptoms (Marathi): symptoms_mr. Organic Control: organic_control_en / organic_control_mr. Chemical Control: chemical_control_en / chemical_control_mr. Source: ICAR.', 'ICAR' FROM supplier
UNION ALL SELECT 'Soil', 'soil_soil_' || lower(n_name), 'Soil Type: Soil ' || n_name || ' ()', 'Soil: Soil ' || n_name || '. deep (). Suitable crops: ' || n_name || '.', 'soil_kb' FROM nation
UNION ALL SELECT 'Fertilizer', 'fert_' || replace(p_name, ' ', '_') || '_' || p_partkey, 'Fertilizer Guide: ' || p_name || ' (' || p_partkey || ') ()', 'Fertilizer guide for ' || p_name || ' (' || p_partkey
  || ') (). Recommended NPK per acre: N=1kg, P=2kg, K=Nonekg. Basal Dose:  (). Top Dressing:  (). Micronutrients: . Source: SAU PoP.', 'local_kb' FROM part
UNION ALL SELECT 'Government Scheme', 'scheme_' || c_custkey, 'Government Scheme: ' || c_name || ' ()', 'Government Scheme: ' || c_name || ' (). Benefits: ' || c_mktsegment
  || ' (). Eligibility:  (). Documents required: card. Portal: n/a. Source: gov open info.', 'gov_kb' FROM customer
UNION ALL SELECT 'Market', 'market_' || o_orderkey || '_' || replace(o_orderpriority, ' ', '_'), 'Mandi Price: ' || o_orderstatus || ' @ ' || o_orderpriority, 'Market price for ' || o_orderstatus
  || ' () variety None at ' || o_orderpriority || ', Pune, Maharashtra. Min ₹' || o_custkey || ', Modal ₹' || o_custkey || ', Max ₹' || o_custkey
  || ' per quintal. Arrivals None tonnes. Trend: up. Date: None. Source: Agmarknet-style.', 'market_kb' FROM orders
UNION ALL SELECT 'Advisory', 'adv_' || item_id, 'Advice', 'Advice / . ' || text || ' . Category: Advisory. Source: open advisory.', 'advisory_kb' FROM benchmark
UNION ALL SELECT 'Seed Variety', 'seed_' || p_partkey || '_' || replace(p_name, ' ', '_'), 'Variety: ' || p_brand || ' (' || p_name || ')', 'Seed variety ' || p_brand || ' for ' || p_name
  || '. Notes: . Agro-climatic fit: . Source: variety notes.', 'seed_kb' FROM part
UNION ALL SELECT 'Irrigation', 'irr_' || r_regionkey, r_name, r_name || '. drip Crops: ' || r_name || '. Source: irrigation open knowledge.', 'irrigation_kb' FROM region
UNION ALL SELECT 'Climate Zone', 'zone_' || n_nationkey, 'Agro-climate: ' || n_name, 'Climate zone ' || n_name || '. Districts: ' || n_name || '. Rainfall: 600 mm. Recommended crops: ' || n_name || '. Notes: .', 'climate_zone_kb' FROM nation
UNION ALL SELECT 'Open Source Catalog', 'catalog_' || r_regionkey, 'Open Source: ' || r_name, 'Open data source ' || r_name || ' (api). Use for: prices. URL: http.', 'open_catalog' FROM region""")
def kb_documents(spark, sf):
    from fieldlake.sources import knowledge

    return knowledge.documents(_entity_tables(spark, sf)).select("category", "id", "title", "content", "source")


@query("q_kb_stats", """
SELECT 'Crop' AS category, count(*) AS n FROM part UNION ALL SELECT 'Fertilizer', count(*) FROM part UNION ALL SELECT 'Seed Variety', count(*) FROM part
UNION ALL SELECT 'Disease', count(*) FROM supplier UNION ALL SELECT 'Soil', count(*) FROM nation UNION ALL SELECT 'Climate Zone', count(*) FROM nation
UNION ALL SELECT 'Government Scheme', count(*) FROM customer UNION ALL SELECT 'Market', count(*) FROM orders UNION ALL SELECT 'Advisory', count(*) FROM benchmark
UNION ALL SELECT 'Irrigation', count(*) FROM region UNION ALL SELECT 'Open Source Catalog', count(*) FROM region""")
def kb_stats(spark, sf):
    from fieldlake.sources import knowledge

    return knowledge.knowledge_stats(knowledge.documents(_entity_tables(spark, sf)))
