"""Registered queries: cleaning, validation, duplicates, language, taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.functions import taxonomy as X
from fieldlake.functions import text as T
from fieldlake.functions import vocab
from fieldlake.operators import coverage, dedup, quality
from fieldlake.plans import sql as S
from fieldlake.plans.sql import query
from fieldlake.session import table
from fieldlake.sources import lake
from fieldlake.sources.store import spread
from fieldlake.streaming.feeds import sink_folder

C_DOC = S.clean("text")


@query("q_quality_report", f"""
WITH c AS (SELECT doc_id, {C_DOC} AS t FROM documents),
d AS (SELECT t, min(doc_id) AS doc_id FROM c GROUP BY t)
SELECT {S.language('t')} AS language, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars
FROM d GROUP BY 1""")
def quality_report(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    cleaned = docs.select("doc_id", T.clean_text(F.col("text")).alias("t"))
    first = cleaned.groupBy(F.sha2("t", 256).alias("h")).agg(F.min_by("t", "doc_id").alias("t"))
    return first.groupBy(T.detect_language(F.col("t")).alias("language")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars"))


@query("q_html_clean", f"""
WITH c AS (SELECT page_id, url, {S.clean_html('html')} AS t FROM {S.decoding('pages')})
SELECT page_id, url, sha256(t) AS text_hash, CAST(length(t) AS INTEGER) AS n_chars FROM c""")
def html_clean(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "url", "html"))
    t = T.clean_columns(pages, "page_id", "url")
    return t.select("page_id", "url", F.sha2("html", 256).alias("text_hash"), F.length("html").alias("n_chars"))


@query("q_clean_nested", f"""
WITH p AS (SELECT p_partkey, p_name, p_type, p_brand FROM part)
SELECT p_partkey, {S.clean("'<b>' || p_name || '</b>  &amp; ' || p_type", entities=True)} AS title,
  {S.clean("'<i>' || p_brand || '</i>'")} || '|' || {S.clean("p_type || ' '")} AS tags FROM p""")
def clean_nested(spark, sf):
    p = table(spark, sf, "part")
    nested = p.select("p_partkey", F.struct(
        F.concat(F.lit("<b>"), "p_name", F.lit("</b>  &amp; "), "p_type").alias("title"),
        F.array(F.concat(F.lit("<i>"), "p_brand", F.lit("</i>")), F.concat("p_type", F.lit(" "))).alias("tags"),
    ).alias("item"))
    c = T.clean_columns(nested, "p_partkey")
    return c.select("p_partkey", F.col("item.title").alias("title"), F.array_join("item.tags", "|").alias("tags"))


@query("q_validate_props", """
SELECT event_type, count(*) AS files_scanned, count(*) FILTER (WHERE json_valid(props)) AS valid,
  count(*) FILTER (WHERE NOT json_valid(props)) AS invalid, count(*) FILTER (WHERE json_valid(props)) AS records, TRUE AS ok
FROM events GROUP BY 1""")
def validate_props(spark, sf):
    files = table(spark, sf, "events").select(
        F.col("event_id").alias("path"), F.col("props").alias("payload"), "event_type")
    checked = quality.validate(files.withColumn("domain", F.lit("images")))
    return quality.validation_report(checked, "event_type")


@query("q_quarantine", """
WITH f AS (SELECT event_id, event_type, value,
  CASE WHEN event_type = 'error' THEN '{"k": ' WHEN event_type = 'signup' THEN '{}'
       WHEN event_type = 'view' THEN '{"schemes": [' || props || ', ' || props || ']}' ELSE props END AS payload
  FROM events),
c AS (SELECT event_id, event_type, payload,
  CASE WHEN NOT json_valid(payload) THEN 'invalid JSON' WHEN payload = '{}' THEN 'empty object payload'
       WHEN event_type <> 'view' THEN 'domain ''government'' missing expected keys [schemes] and no nested content'
  END AS reason FROM f)
SELECT coalesce(reason, 'valid') AS reason, event_type, count(*) AS n,
  CAST(sum(CASE WHEN NOT json_valid(payload) THEN 0 WHEN event_type = 'view' THEN 2 ELSE 1 END) AS BIGINT) AS records,
  CAST(sum(strlen(payload)) AS BIGINT) AS bytes
FROM c GROUP BY 1, 2""")
def quarantine(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    payload = (
        F.when(kind == "error", '{"k": ').when(kind == "signup", "{}")
        .when(kind == "view", F.concat(F.lit('{"schemes": ['), "props", F.lit(", "), "props", F.lit("]}")))
        .otherwise(F.col("props")))
    files = e.select(F.col("event_id").alias("path"), "event_type", payload.alias("payload"),
                     F.lit("government").alias("domain"))
    valid, bad = quality.quarantine_split(quality.validate(files))
    both = valid.withColumn("reason", F.lit("valid")).unionByName(bad)
    return both.groupBy("reason", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("record_estimate").alias("records"), F.sum("bytes").alias("bytes"))


ONE_SPACE = "regexp_replace(html, '[ \\t-\\r]+', ' ', 'g')"


@query("q_clean_stage", f"""
WITH f AS (SELECT *, {ONE_SPACE} AS h, CASE WHEN contains(url, '?') THEN '{{"records": [' ELSE
  CAST(json_object('records', [json_object('html', {ONE_SPACE})]) AS VARCHAR) END AS p FROM pages)
SELECT page_id, CASE WHEN json_valid(p) THEN 'cleaned' ELSE 'skipped_invalid' END AS action,
  CASE WHEN json_valid(p) THEN sha256({S.clean_html('h')}) END AS cleaned_hash FROM {S.decoding('f')}""")
def clean_stage(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    body = F.to_json(F.struct(F.array(F.struct(F.regexp_replace("html", r"\s+", " ").alias("html"))).alias("records")))
    files = pages.select(
        "page_id", F.col("url").alias("path"), F.lit("market").alias("domain"),
        F.when(F.contains("url", F.lit("?")), '{"records": [').otherwise(body).alias("payload"))
    staged = quality.clean_stage(quality.validate(files))
    return staged.select("page_id", "action", F.sha2(F.get_json_object("cleaned", "$.records[0].html"), 256).alias("cleaned_hash"))


LANG_FOLDER = "CASE lang WHEN 'en' THEN 'crop' WHEN 'fr' THEN 'soil' WHEN 'de' THEN 'market' ELSE 'other' END"


@query("q_lake_flow", f"""
WITH f AS (SELECT doc_id, {LANG_FOLDER} AS domain, {C_DOC} AS t, source IS NOT DISTINCT FROM 'src13' AS broken FROM documents),
v AS (SELECT *, NOT broken AND coalesce(t, '') <> '' AS ok FROM f WHERE domain <> 'other'),
k AS (SELECT domain, lower(t) AS t, min(doc_id) AS doc_id, count(*) AS copies FROM v WHERE ok GROUP BY ALL)
SELECT domain, count(*) AS scanned, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid,
  (SELECT count(*) FROM k WHERE k.domain = v.domain) AS kept, (SELECT CAST(sum(copies - 1) AS BIGINT) FROM k WHERE k.domain = v.domain) AS exact_removed,
  (SELECT CAST(sum(doc_id) AS BIGINT) FROM k WHERE k.domain = v.domain) AS kept_ids FROM v GROUP BY domain""")
def lake_flow(spark, sf):
    """Documents as line files in domain folders, one source's lines broken: scan three domains, validate, clean, de-duplicate."""
    d = table(spark, sf, "documents")
    folder = F.when(F.col("lang") == "en", "crop").when(F.col("lang") == "fr", "soil").when(F.col("lang") == "de", "market").otherwise("other")
    line = F.when(F.col("source") == "src13", '{"doc_id": ').otherwise(F.to_json(F.struct("doc_id", "text")))
    root = sink_folder(spark, "lake")
    lake.write_domain_lines(d.select(folder.alias("domain"), line.alias("line")), root)
    counters, kept = lake.lake_flow(spark, root, "doc_id", "text", domains=["crop", "soil", "market"])
    return counters.join(kept.groupBy("domain").agg(F.sum("doc_id").alias("kept_ids")), "domain", "left")


@query("q_record_constraints", """
WITH r AS (SELECT l_orderkey, l_linenumber, trim(l_returnflag) AS q, l_discount * 11 AS confidence FROM lineitem)
SELECT CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence outside [0, 1]' ELSE 'accepted' END AS verdict,
  count(*) AS n FROM r GROUP BY 1""")
def record_constraints(spark, sf):
    li = table(spark, sf, "lineitem")
    errors = quality.record_errors(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_discount") * 11)
    verdict = F.when(F.size("e") == 0, "accepted").otherwise(F.array_join("e", "; "))
    return li.select(errors.alias("e")).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("q_reference_integrity", """
SELECT 'part' AS dim, 'at least 20 rows' AS "check", CASE WHEN count(*) < 20 THEN 1::BIGINT ELSE 0 END AS failures FROM part
UNION ALL SELECT 'part', 'unique p_name', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'part', 'filled p_type', count(*) FILTER (WHERE coalesce(p_type, '') = '') FROM part
UNION ALL SELECT 'part', 'filled p_brand', count(*) FILTER (WHERE coalesce(p_brand, '') = '') FROM part
UNION ALL SELECT 'supplier', 'at least 20 rows', CASE WHEN count(*) < 20 THEN 1 ELSE 0 END FROM supplier
UNION ALL SELECT 'supplier', 'unique s_suppkey', count(*) FROM (SELECT s_suppkey FROM supplier GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'supplier', 'filled s_name', count(*) FILTER (WHERE coalesce(s_name, '') = '') FROM supplier""")
def reference_integrity(spark, sf):
    a = quality.integrity(table(spark, sf, "part"), "p_name", ["p_type", "p_brand"], 20)
    b = quality.integrity(table(spark, sf, "supplier"), "s_suppkey", ["s_name"], 20)
    return a.withColumn("dim", F.lit("part")).unionByName(b.withColumn("dim", F.lit("supplier"))).select(
        "dim", "check", "failures")


@query("q_entity_coverage", """
WITH m AS (SELECT p_name, count(*) AS entities, count(*) FILTER (WHERE p_type IN ('ECONOMY', 'STANDARD')) AS unmapped FROM part GROUP BY 1)
SELECT p_name, entities, entities - unmapped AS mapped, unmapped FROM m""")
def entity_coverage(spark, sf):
    p = table(spark, sf, "part")
    label = F.when(F.col("p_type") == "PROMO", "Scheme").when(F.col("p_type") == "SMALL", "Pest").when(
        F.col("p_type") == "MEDIUM", "WeatherCondition").when(F.col("p_type") == "LARGE", "soil").otherwise(F.col("p_type"))
    mapped = X.label_category(label)
    return p.groupBy("p_name").agg(
        F.count(F.lit(1)).alias("entities"), F.count(mapped).alias("mapped"),
        F.count_if(mapped.isNull()).alias("unmapped"))


# --- duplicates --------------------------------------------------------------------------

@query("q_exact_dedup", """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def exact_dedup(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    h = dedup.stable_hash(d, ["text"])
    return d.groupBy(h.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("q_dedup_first_rows", """
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def dedup_first_rows(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return dedup.dedup_exact(d, "doc_id", ["text", "lang"]).select("doc_id", "lang", "source")


# The check joins on the rarest grams of each text (a prefix of the set in document-frequency
# order must overlap), verifies by counting shared grams and then walks the pairs in order.
NEAR = f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT doc_id, {S.collapse('lower(' + C_DOC + ')')} AS t{{scope}} FROM {{rows}}),
u AS MATERIALIZED (SELECT t, {{group}} min(doc_id) AS id FROM f GROUP BY ALL),
w AS (SELECT id, {{scope_col}} AS sc, t, string_split(t, '') AS ch FROM u),
z AS (SELECT id, sc, unnest(ch) AS c0, unnest(ch[2:]) AS c1, unnest(ch[3:]) AS c2 FROM w WHERE length(t) >= 3),
e AS MATERIALIZED (SELECT DISTINCT id, sc, c0 || c1 || c2 AS g FROM z WHERE c2 IS NOT NULL
  UNION ALL SELECT id, sc, t FROM w WHERE length(t) IN (1, 2)),
c AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS MATERIALIZED (SELECT id, sc, g, count(*) OVER (PARTITION BY id) AS n,
    row_number() OVER (PARTITION BY id ORDER BY df, g) AS pos FROM e JOIN c USING (g)),
p AS MATERIALIZED (SELECT * FROM r WHERE pos <= n - CAST(ceil(0.92 * n - 1e-9) AS BIGINT) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b
  ON a.g = b.g AND a.sc = b.sc AND a.id < b.id AND least(a.n, b.n) >= 0.92 * greatest(a.n, b.n) - 1e-9),
pairs AS MATERIALIZED (SELECT a, b FROM cand JOIN e x ON x.id = a JOIN e y ON y.id = b AND x.g = y.g
  GROUP BY a, b, na, nb HAVING count(*) >= 0.92 * (na + nb - count(*)) - 1e-9),
todo AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped
  UNION ALL
  SELECT w.i + 1, CASE WHEN len(list_filter(t.earlier, lambda x: NOT list_contains(w.dropped, x))) > 0
    THEN list_append(w.dropped, t.b) ELSE w.dropped END
  FROM walk w JOIN todo t ON t.i = w.i + 1),
gone AS (SELECT unnest(dropped) AS id FROM (SELECT dropped FROM walk ORDER BY i DESC LIMIT 1)),
verdict AS (SELECT f.doc_id, CASE WHEN u.id IN (SELECT id FROM gone) THEN 'near_removed'
    WHEN u.id = f.doc_id THEN 'kept' ELSE 'exact_removed' END AS status{{scope_out}}
  FROM f JOIN u ON f.t = u.t{{scope_join}})
"""


def _near_sql(**parts: str) -> str:
    out = NEAR
    for name, value in parts.items():
        out = out.replace("{" + name + "}", value)
    return out


NEAR_ALL = _near_sql(rows="documents", scope="", group="", scope_col="1", scope_out="", scope_join="")
NEAR_LANG = _near_sql(rows="documents", scope=", lang", group="lang,", scope_col="lang", scope_out=", f.lang",
                      scope_join=" AND f.lang = u.lang")


@query("q_near_dedup", NEAR_ALL + "SELECT doc_id, status FROM verdict")
def near_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.dedup_near(docs, "doc_id", ["text"]).select("doc_id", "status")


@query("q_dedup_stats", NEAR_LANG + """SELECT lang, count(*) AS input, count(*) FILTER (WHERE status = 'kept') AS kept,
  count(*) FILTER (WHERE status = 'exact_removed') AS exact_removed, count(*) FILTER (WHERE status = 'near_removed') AS near_removed
FROM verdict GROUP BY lang""")
def dedup_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return dedup.dedup_stats(dedup.dedup_near(docs, "doc_id", ["text"], scope=["lang"]), "lang")


@query("q_ngram_jaccard", f"""
WITH t AS (SELECT conv_id, turn, {S.collapse('lower(text)')} AS t FROM conversations),
w AS (SELECT conv_id, turn, string_split(t, '') AS ch FROM t),
z AS (SELECT conv_id, turn, unnest(ch) AS c0, unnest(ch[2:]) AS c1, unnest(ch[3:]) AS c2 FROM w),
e AS MATERIALIZED (SELECT DISTINCT conv_id, turn, c0 || c1 || c2 AS g FROM z WHERE c2 IS NOT NULL
  UNION ALL SELECT conv_id, turn, t FROM t WHERE length(t) IN (1, 2)),
n AS (SELECT t.conv_id, t.turn, count(g) AS n FROM t LEFT JOIN e USING (conv_id, turn) GROUP BY ALL),
i AS (SELECT a.conv_id, a.turn, count(*) AS k FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
  AND a.g = b.g GROUP BY ALL)
SELECT a.conv_id, a.turn, CAST(a.n AS INTEGER) AS grams, CAST(b.n AS INTEGER) AS next_grams,
  CASE WHEN a.n + b.n = 0 THEN 1.0::DOUBLE ELSE round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)), 6) END AS jaccard
FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
LEFT JOIN i ON i.conv_id = a.conv_id AND i.turn = a.turn""")
def ngram_jaccard(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", dedup.char_ngrams(F.col("text")).alias("s"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("s2"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size("s").alias("grams"), F.size("s2").alias("next_grams"),
        F.round(dedup.jaccard(F.col("s"), F.col("s2")), 6).alias("jaccard"))


NEAR_READABLE = _near_sql(rows=f"(SELECT * REPLACE ({C_DOC} AS text) FROM documents WHERE source IS DISTINCT FROM 'src13')", scope="", group="", scope_col="1",
                      scope_out="", scope_join="")


@query("q_quality_run", NEAR_READABLE + """SELECT (SELECT count(*) FROM documents) AS files_scanned, count(*) AS valid,
  (SELECT count(*) FROM documents) - count(*) AS invalid, count(*) AS cleaned, count(*) FILTER (status = 'kept') AS kept,
  count(*) FILTER (status = 'exact_removed') AS exact_removed, count(*) FILTER (status = 'near_removed') AS near_removed, TRUE AS ok FROM verdict""")
def quality_run(spark, sf):
    """Validate, clean, de-duplicate and report in one job; the documents of one source arrive broken."""
    d = table(spark, sf, "documents")
    body = F.to_json(F.struct(F.array(F.struct("text")).alias("records")))
    files = d.select("doc_id", F.lit("market").alias("domain"), F.col("doc_id").alias("path"),
                     F.when(F.col("source") == "src13", '{"records": [').otherwise(body).alias("payload"))
    return quality.run_quality(files, "doc_id", ["text"])


FINGERPRINT = "lower(p_brand) || ' ' || lower(p_name) || ' ' || lower(p_type) || ' tag'"


@query("q_fingerprint", f"""
SELECT p_partkey, {FINGERPRINT} AS fingerprint, sha256({FINGERPRINT}) AS fingerprint_hash FROM part""")
def fingerprint(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.struct(F.concat(F.lit("<b> "), "p_brand").alias("a"), F.col("p_size").alias("skip"), F.lit("no").alias("raw")).alias("body"),
        F.array("p_name", "p_type").alias("names"), F.array(F.struct(F.lit("TAG ").alias("t"), F.col("p_size").alias("n"))).alias("tags"),
        F.lit("never").alias("metadata"))
    fp = dedup.fingerprint_text(p, ["body", "names", "tags", "metadata"])
    return p.select("p_partkey", fp.alias("fingerprint")).withColumn(
        "fingerprint_hash", F.sha2("fingerprint", 256))


@query("q_url_dedup", """
SELECT regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, min(page_id) AS page_id, count(*) AS pages
FROM pages GROUP BY 1""")
def url_dedup(spark, sf):
    p = table(spark, sf, "pages")
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/?#]+)", 1)
    return p.groupBy(host.alias("host")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))


# --- language ----------------------------------------------------------------------------

HINTED = "CASE lang WHEN 'de' THEN 'यह गेहूं है ' || text WHEN 'fr' THEN 'कापूस पीक आहे ' || text WHEN 'es' THEN 'यह फसल है ' || text ELSE text END"


def _hinted():
    lang = F.col("lang")
    return (F.when(lang == "de", F.concat(F.lit("यह गेहूं है "), "text")).when(lang == "fr", F.concat(F.lit("कापूस पीक आहे "), "text"))
            .when(lang == "es", F.concat(F.lit("यह फसल है "), "text")).otherwise(F.col("text")))


@query("q_lang_detect", f"""
WITH h AS (SELECT lang, {HINTED} AS t FROM documents)
SELECT lang AS declared, {S.language('t')} AS language, count(*) AS n FROM h GROUP BY ALL""")
def lang_detect(spark, sf):
    d = spread(table(spark, sf, "documents").select("lang", "text"))
    return d.groupBy(F.col("lang").alias("declared"), T.detect_language(_hinted()).alias("language")).agg(
        F.count(F.lit(1)).alias("n"))


@query("q_lang_pair", f"""
WITH p AS (SELECT q.conv_id, q.turn, CASE WHEN q.turn > 1 THEN 'कापूस पीक आहे ' || q.text ELSE q.text END AS q, a.text AS a
  FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'),
l AS (SELECT conv_id, turn, {S.language('q')} AS lq, {S.language('a')} AS la FROM p)
SELECT conv_id, turn, lq, la, {S.pair_language('lq', 'la')} AS language FROM l""")
def lang_pair(spark, sf):
    from fieldlake.operators.standardize import conversation_pairs

    p = conversation_pairs(table(spark, sf, "conversations"))
    q = F.when(F.col("turn") > 1, F.concat(F.lit("कापूस पीक आहे "), "question")).otherwise(F.col("question"))
    tagged = p.select("conv_id", "turn", T.detect_language(q).alias("lq"), T.detect_language(F.col("answer")).alias("la"))
    return tagged.withColumn("language", T.combine_languages(F.col("lq"), F.col("la")))


@query("q_lang_distribution", f"""
WITH p AS (SELECT q.text || ' ' || a.text AS t, CASE WHEN q.turn = 0 THEN 'tagged' END AS tag
  FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')
SELECT coalesce(tag, {S.language('t')}) AS language, count(*) AS n FROM p GROUP BY 1""")
def lang_distribution(spark, sf):
    from fieldlake.operators.standardize import conversation_pairs

    p = conversation_pairs(table(spark, sf, "conversations"))
    return coverage.language_distribution(p.withColumn("language", F.when(F.col("turn") == 0, "tagged")))


# --- taxonomy ----------------------------------------------------------------------------

ALIASES = S.values("alias", ["a", "name", "ord"], vocab.crop_alias_rows())
KEYWORDS = S.values("kw", ["cat", "word", "ord"], [
    (c, w.lower(), i) for i, (c, ws) in enumerate(vocab.CATEGORY_KEYWORDS.items()) for w in ws])


@query("q_alias_resolve", f"""
WITH {ALIASES}, t AS (SELECT doc_id, {S.strip('lower(text)')} AS t FROM documents)
SELECT t.doc_id, arg_max(name, [CASE WHEN a = t THEN 1 ELSE 0 END, length(a), -ord]) AS crop
FROM t LEFT JOIN alias ON a = t OR (length(a) >= 3 AND contains(t, a)) GROUP BY 1""")
def alias_resolve(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", X.resolve_crop(F.col("text")).alias("crop"))


@query("q_alias_extract", f"""
WITH {ALIASES}, t AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT doc_id, name, t, arg_max(a, [length(a), -ord]) AS a, max([length(a), -ord]) AS r
  FROM t JOIN alias ON length(a) >= 2 AND contains(t, a) GROUP BY ALL),
l AS (SELECT doc_id, string_agg(name, '|' ORDER BY instr(t, a), -r[1], -r[2]) AS crops FROM h GROUP BY 1)
SELECT doc_id, coalesce(crops, '') AS crops FROM documents LEFT JOIN l USING (doc_id)""")
def alias_extract(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join(X.extract_crops(F.col("text")), "|").alias("crops"))


@query("q_category", f"""
WITH {KEYWORDS}, t AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT DISTINCT doc_id, cat, ord FROM t JOIN kw ON contains(t, word)),
l AS (SELECT doc_id, string_agg(cat, '|' ORDER BY ord) AS c FROM h GROUP BY 1)
SELECT d.doc_id, coalesce(c, 'general') AS categories FROM documents d LEFT JOIN l USING (doc_id)""")
def category(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join(X.detect_categories(F.col("text")), "|").alias("categories"))


DISTRICTS = S.values("dist", ["alias", "state_id", "state", "district", "zone", "ord"], vocab.district_rows())
MH = "[" + ", ".join(S.lit(d) for d in vocab.district_names()) + "]"


@query("q_district", f"""
WITH {DISTRICTS}, p AS (SELECT s_suppkey, s_nationkey, {MH} AS ds FROM supplier),
k AS (SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN ds[s_nationkey + 1] || ' district' ELSE 'unlisted ' || s_nationkey END AS given FROM p),
m AS (SELECT s_suppkey, min(CASE WHEN alias = lower(given) THEN ord - 1000 ELSE ord END) AS o FROM k
  JOIN dist ON contains(lower(given), alias) OR contains(alias, lower(given)) GROUP BY 1)
SELECT k.s_suppkey, coalesce(d.state, 'Maharashtra') AS state, coalesce(d.district, given) AS district, d.zone
FROM k LEFT JOIN m USING (s_suppkey) LEFT JOIN dist d ON d.ord = CASE WHEN m.o < 0 THEN m.o + 1000 ELSE m.o END""")
def district(spark, sf):
    s = table(spark, sf, "supplier")
    names = F.array(*[F.lit(d) for d in vocab.district_names()])
    given = F.when(
        F.col("s_nationkey") < 20, F.concat(F.get(names, F.col("s_nationkey")), F.lit(" district"))
    ).otherwise(F.concat(F.lit("unlisted "), "s_nationkey"))
    r = X.standard_region(given, F.lit("Maharashtra"))
    return s.select("s_suppkey", r.alias("r")).select("s_suppkey", "r.state", "r.district", "r.zone")


@query("q_units", """
SELECT l_returnflag, l_linestatus, CASE l_linestatus WHEN 'F' THEN 'kg' ELSE 'ha' END AS unit,
  round(sum(CASE l_returnflag WHEN 'A' THEN l_quantity / 100.0 WHEN 'N' THEN l_quantity * 1000.0 / 100.0 END), 4) AS quintals,
  round(sum(l_quantity * 0.404686 / 1.0), 4) AS hectares
FROM lineitem GROUP BY ALL""")
def units(spark, sf):
    li = table(spark, sf, "lineitem")
    unit = F.when(F.col("l_returnflag") == "A", "kg").when(F.col("l_returnflag") == "N", "Tonne").otherwise("bushel")
    token = F.when(F.col("l_linestatus") == "F", " KG ").otherwise("हेक्टर")
    return li.groupBy("l_returnflag", "l_linestatus", X.normalize_unit(token).alias("unit")).agg(
        F.round(F.sum(X.convert_mass(F.col("l_quantity"), unit, F.lit("quintal"))), 4).alias("quintals"),
        F.round(F.sum(X.convert_area(F.col("l_quantity"), F.lit("acre"), F.lit("ha"))), 4).alias("hectares"))
