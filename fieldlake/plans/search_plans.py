"""Registered queries: retrieval, query planning and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.functions import vocab
from fieldlake.functions.embedding import hash_embed
from fieldlake.operators import cells, graph, queryplan, retrieval
from fieldlake.operators.searchindex import SearchIndex
from fieldlake.plans import sql as S
from fieldlake.plans.sql import query
from fieldlake.session import table
from fieldlake.sources.store import materialize

TOP = 10


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _body():
    return F.concat("text", F.lit(" "), "source")


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def _index(spark, sf) -> SearchIndex:
    """The search index of a folder's documents: built once per application, then only brought up to date."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex(spark, dense=True)
    _INDEXES[key].sync(_docs(spark, sf), "doc_id", _body())
    return _INDEXES[key]


def _tokens_sql(name: str, src: str, pattern: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM "
            f"(SELECT id, regexp_extract_all(lower(t), '{pattern}') AS ts FROM {src}))")


BM25 = f"""docs AS (SELECT doc_id AS id, text || ' ' || source AS t FROM documents),
asked AS (SELECT item_id AS id, text AS t FROM benchmark),
{_tokens_sql('dt', 'docs', S.TOKEN_DEV)}, {_tokens_sql('qt', 'asked', S.TOKEN_DEV)},
post AS MATERIALIZED (SELECT id, term, dl, count(*) AS tf FROM dt GROUP BY ALL),
idf0 AS (SELECT term, ln((SELECT count(*) FROM docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM post GROUP BY term),
idf AS MATERIALIZED (SELECT term, CASE WHEN v < 0 THEN 0.25 * (SELECT avg(v) FROM idf0) ELSE v END AS idf FROM idf0),
av AS (SELECT sum(dl) / (SELECT count(*) FROM docs) AS a FROM (SELECT DISTINCT id, dl FROM dt)),
bsc AS (SELECT q.id AS qid, p.id AS doc_id, sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * p.dl / (SELECT a FROM av)))) AS score
  FROM (SELECT id, term, count(*) AS n FROM qt GROUP BY ALL) q JOIN post p USING (term) JOIN idf USING (term) GROUP BY ALL),
bm AS MATERIALIZED (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bsc)
"""
TFIDF = f"""{_tokens_sql('dw', 'docs', S.TOKEN_WORD)}, {_tokens_sql('qw', 'asked', S.TOKEN_WORD)},
wpost AS MATERIALIZED (SELECT id, term, dl, count(*) AS tf FROM dw GROUP BY ALL),
widf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM wpost GROUP BY term),
wd AS MATERIALIZED (SELECT id, term, tf / dl * idf AS w FROM wpost JOIN widf USING (term)),
wq AS MATERIALIZED (SELECT id, term, count(*) / dl * idf AS w FROM qw JOIN widf USING (term) GROUP BY id, term, dl, idf),
dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM wd GROUP BY id), qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM wq GROUP BY id),
tsc AS (SELECT q.id AS qid, d.id AS doc_id, sum(q.w * d.w) / any_value(dn.n * qn.n) AS score
  FROM wq q JOIN wd d USING (term) JOIN dn ON dn.id = d.id JOIN qn ON qn.id = q.id GROUP BY ALL),
tf AS MATERIALIZED (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank
  FROM tsc WHERE score > 0.001)
"""


def _embed_sql(name: str, src: str) -> str:
    """(id, bucket, w): summed feature weights of the hashed embedding of (id, t) rows."""
    def slot(h, digits):
        return S.hex_mod(h, digits, 768)

    return f"""{name}_t AS MATERIALIZED (SELECT id, lower(t) AS t, regexp_extract_all(lower(t), '{S.TOKEN_DEV}') AS ts FROM {src}),
{name}_w AS (SELECT id, unnest(ts) AS a, unnest(ts[2:]) AS b FROM {name}_t),
{name}_c AS (SELECT id, string_split(regexp_replace(t, '\\s+', '', 'g'), '') AS ch FROM {name}_t),
{name}_g AS (SELECT id, unnest(ch) AS c0, unnest(ch[2:]) AS c1, unnest(ch[3:]) AS c2 FROM {name}_c),
{name}_f AS (SELECT id, a AS f, 'm' AS kind, 1.0 * count(*) AS w FROM {name}_w WHERE a IS NOT NULL GROUP BY ALL
  UNION ALL SELECT id, a || '_' || b, 'm', 0.5 * count(*) FROM {name}_w WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT id, c0 || c1 || c2, 's', 0.25 * count(*) FROM {name}_g WHERE c2 IS NOT NULL GROUP BY ALL),
{name}_h AS (SELECT f, kind, CASE kind WHEN 'm' THEN {slot('md5(f)', 32)} ELSE {slot('sha1(f)', 40)} END AS r
  FROM (SELECT DISTINCT f, kind FROM {name}_f)),
{name} AS MATERIALIZED (SELECT id, r % 384 AS bucket, sum(CASE WHEN r < 384 THEN w ELSE -w END) AS w
  FROM {name}_f JOIN {name}_h USING (f, kind) GROUP BY ALL)"""


DENSE = f"""{_embed_sql('ed', 'docs')}, {_embed_sql('eq', 'asked')},
edn AS (SELECT id, sqrt(sum(w * w)) AS n FROM ed GROUP BY id), eqn AS (SELECT id, sqrt(sum(w * w)) AS n FROM eq GROUP BY id),
esc AS (SELECT q.id AS qid, d.id AS doc_id, sum(q.w * d.w) / any_value(edn.n * eqn.n) AS score
  FROM eq q JOIN ed d USING (bucket) JOIN edn ON edn.id = d.id JOIN eqn ON eqn.id = q.id GROUP BY ALL),
de AS MATERIALIZED (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM esc)
"""


@query("q_index_stats", f"""WITH {BM25}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term""")
def index_stats(spark, sf):
    post = retrieval.build_postings(_docs(spark, sf), "doc_id", _body())
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("q_bm25", f"WITH {BM25} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= {TOP} AND score > 0")
def bm25(spark, sf):
    hits = _index(spark, sf).bm25(_queries(spark, sf), TOP)
    return hits.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("q_tfidf", f"WITH {BM25}, {TFIDF} SELECT qid, doc_id, round(score, 6) AS score, rank FROM tf WHERE rank <= {TOP}")
def tfidf(spark, sf):
    hits = _index(spark, sf).tfidf(_queries(spark, sf), TOP)
    return hits.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("q_index_append", f"WITH {BM25}, {TFIDF} SELECT 'bm25' AS channel, qid, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= {TOP} AND score > 0 "
       f"UNION ALL SELECT 'sparse_tfidf', qid, doc_id, round(score, 6), rank FROM tf WHERE rank <= {TOP}")
def index_append(spark, sf):
    """An index of an earlier state, with missing, different and superfluous documents, brought up to date: as if built anew."""
    docs = _docs(spark, sf)
    earlier = docs.where("doc_id % 3 > 0").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.reverse("text")).otherwise(F.col("text")))
    index = SearchIndex(spark)
    index.append(earlier.unionByName(docs.withColumn("doc_id", -F.col("doc_id") - 1)), "doc_id", _body())
    index.sync(docs, "doc_id", _body())
    asked = _queries(spark, sf)
    hits = index.bm25(asked, TOP).withColumn("channel", F.lit("bm25")).unionByName(index.tfidf(asked, TOP).withColumn("channel", F.lit("sparse_tfidf")))
    return hits.select("channel", "qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("q_hash_embed", f"""WITH docs AS (SELECT doc_id AS id, text AS t FROM documents), {_embed_sql('ed', 'docs')},
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM ed GROUP BY id)
SELECT id AS doc_id, CAST(bucket AS INTEGER) AS bucket, CAST(CAST(w / n AS FLOAT) AS DOUBLE) AS weight FROM ed JOIN n USING (id) WHERE w <> 0""")
def hash_embedding(spark, sf):
    v = materialize(retrieval.embed_documents(_docs(spark, sf), "doc_id", F.col("text")), "vectors")
    return v.select(F.col("id").alias("doc_id"), F.posexplode("vec").alias("bucket", "weight")).filter("weight <> 0").select(
        "doc_id", "bucket", F.col("weight").cast("double").alias("weight"))


@query("q_dense_search", f"WITH {BM25}, {DENSE} SELECT qid, doc_id, round(score, 5)::DOUBLE AS score FROM de WHERE rank <= {TOP} AND score > 0.01")
def dense_search(spark, sf):
    hits = _index(spark, sf).dense_search(_queries(spark, sf), TOP)
    return hits.select("qid", "doc_id", F.round("score", 5).alias("score"))


@query("q_dense_topk", f"""
WITH u AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS v FROM u GROUP BY label),
s AS (SELECT c.label AS qid, vec_id AS doc_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score FROM c CROSS JOIN embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= {TOP} AND score > 0.01""")
def dense_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    centre = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    asked = centre.select(F.col("label").alias("qid"), F.transform("p", lambda s: s["x"]).alias("vec"))
    held = cells.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    hits = cells.topk(asked, held, TOP)
    return hits.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


RRF = f"""ch AS (SELECT qid, doc_id, rank, 'bm25' AS o, 1.0 AS w, 0 AS k FROM bm WHERE rank <= {2 * TOP} AND score > 0
  UNION ALL SELECT qid, doc_id, rank, 'sparse_tfidf', 1.0, 1 FROM tf WHERE rank <= {2 * TOP}
  UNION ALL SELECT qid, doc_id, rank, 'dense', 1.15, 2 FROM de WHERE rank <= {2 * TOP} AND score > 0.01),
fu AS (SELECT qid, doc_id, sum(w / (60 + rank))::DOUBLE AS s, string_agg(o, ',' ORDER BY k) AS origins FROM ch GROUP BY ALL),
rr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 8) DESC, doc_id) AS rank FROM fu)
"""


@query("q_rrf", f"WITH {BM25}, {TFIDF}, {DENSE}, {RRF} SELECT qid, doc_id, round(s, 6) AS rrf_score, origins FROM rr WHERE rank <= {TOP}")
def rrf(spark, sf):
    hits = _index(spark, sf).hybrid(_queries(spark, sf), TOP)
    return hits.select("qid", "doc_id", F.round("rrf_score", 6).alias("rrf_score"), "origins")


FUSE = f"""src AS (SELECT qid, doc_id, rank, 1.0 AS w, 0 AS k, 'local_hybrid' AS origin FROM bm WHERE rank <= {TOP} AND score > 0
  UNION ALL SELECT qid, doc_id, rank, 0.95, 2, 'tool' FROM tf WHERE rank <= {TOP}),
fs AS (SELECT qid, doc_id, sum(w / (60 + rank))::DOUBLE AS s, arg_min(origin, k) AS origin FROM src GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 8) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fs)
"""


@query("q_fuse_sources", f"""WITH {BM25}, {TFIDF}, {FUSE}
SELECT qid, CAST(doc_id AS VARCHAR) AS doc_id, origin, round(s, 6) AS fusion_score, rank,
  '[' || rank || '] (' || origin || '/Document) ' || d.source || chr(10) || d.lang || chr(10) || 'source=' || d.source || ' score='
  || printf('%.6f', round(s, 6)) AS context
FROM fr JOIN documents d USING (doc_id) WHERE rank <= {TOP}""")
def fuse_sources(spark, sf):
    from fieldlake.functions import text as T

    docs = table(spark, sf, "documents")
    body = _body()
    stats = materialize(retrieval.corpus_stats(docs, body), "corpus-stats")
    local = retrieval.bm25(_queries(spark, sf), retrieval.build_index(docs, "doc_id", body), stats, TOP)
    tool = retrieval.tfidf(
        _queries(spark, sf), retrieval.build_index(docs, "doc_id", body, T.TOKEN_WORD), stats.select("n").scalar(), TOP)
    facts = docs.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("content"), "source",
                        F.lit(None).cast("string").alias("url"))
    fused = retrieval.fuse_sources({"local_hybrid": local.join(facts, "doc_id"), "tool": tool.join(facts, "doc_id")}, TOP)
    return retrieval.citations(fused, F.lit("Document")).join(
        fused.select("qid", "rank", "doc_id"), ["qid", "rank"]).select(
        "qid", "doc_id", "origin", "fusion_score", F.col("rank").cast("bigint").alias("rank"), "context")


@query("q_context_blocks", f"""WITH {BM25}
SELECT qid, count(*) AS blocks, sha256(string_agg('[' || rank || '] (local_hybrid/Document) ' || source || chr(10) || lang || chr(10)
  || 'source=' || source || ' score=' || printf('%.6f', round(1.0 / (60 + rank), 6)), chr(10) || chr(10) ORDER BY rank)) AS context_hash
FROM bm JOIN documents d USING (doc_id) WHERE rank <= {TOP} AND score > 0 GROUP BY qid""")
def context_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    stats = materialize(retrieval.corpus_stats(docs, _body()), "corpus-stats")
    local = retrieval.bm25(_queries(spark, sf), retrieval.build_index(docs, "doc_id", _body()), stats, TOP)
    facts = docs.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("content"), "source",
                        F.lit(None).cast("string").alias("url"))
    cited = retrieval.citations(retrieval.fuse_sources({"local_hybrid": local.join(facts, "doc_id")}, TOP), F.lit("Document"))
    n = cited.groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"))
    return retrieval.context_blocks(cited).join(n, "qid").select(
        "qid", "blocks", F.sha2("context_text", 256).alias("context_hash"))


@query("q_new_documents", """
SELECT d.doc_id, sha256(d.text) AS content_hash FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1
WHERE l.doc_id IS NULL""")
def new_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    # The index so far: good labelled documents as they are, poor ones with outdated content.
    index = docs.join(lab, "doc_id").select(
        "doc_id", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(""), 256).alias("content_hash"))
    return retrieval.new_documents(docs, index, "doc_id", F.col("text")).select("doc_id", "content_hash")


# --- query planning -----------------------------------------------------------------------------

KW = S.values("kw", ["intent", "word", "ord"], [
    (i, w.lower(), n) for n, (i, ws) in enumerate(vocab.intent_keywords().items()) for w in ws])
TRIGGERS = S.values("trig", ["word"], [(w,) for w in vocab.WEB_TRIGGERS])
ASKED = f"""a AS (SELECT conv_id, turn, {S.collapse("text || CASE turn WHEN 0 THEN ' mandi price today' WHEN 2 THEN ' npk drip' ELSE '' END")} AS n
  FROM conversations WHERE role = 'user')"""


def _asked(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    tail = F.when(F.col("turn") == 0, " mandi price today").when(F.col("turn") == 2, " npk drip").otherwise("")
    return c.select(F.col("conv_id").alias("qid"), "turn", F.concat("text", tail).alias("query"))


@query("q_query_plan", f"""WITH {KW}, {TRIGGERS}, {ASKED},
h AS (SELECT DISTINCT conv_id, turn, intent, ord FROM a JOIN kw ON contains(lower(n), word)),
l AS (SELECT conv_id, turn, list(intent ORDER BY ord) AS il FROM h GROUP BY ALL),
t AS (SELECT DISTINCT conv_id, turn FROM a JOIN trig ON contains(lower(n), word))
SELECT a.conv_id AS qid, a.turn, coalesce(array_to_string(il, '|'), 'general') AS intents,
  t.conv_id IS NOT NULL OR len(list_intersect(coalesce(il, []), ['market', 'weather', 'scheme'])) > 0 AS needs_web,
  t.conv_id IS NOT NULL OR len(list_intersect(coalesce(il, []), ['market', 'weather', 'scheme'])) > 0 AS needs_live_tools,
  'en' AS language_hint, sha256(n) AS normalized
FROM a LEFT JOIN l USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)""")
def query_plan(spark, sf):
    p = queryplan.plan_queries(_asked(spark, sf))
    return p.select("qid", "turn", F.array_join("intents", "|").alias("intents"), "needs_web", "needs_live_tools",
                    "language_hint", F.sha2("normalized", 256).alias("normalized"))


CROPS_Q = f"""{S.values("alias", ["al", "name", "ord"], vocab.crop_alias_rows())},
ch AS (SELECT conv_id, turn, name, n, arg_max(al, [length(al), -ord]) AS al, max([length(al), -ord]) AS r
  FROM a JOIN alias ON length(al) >= 2 AND contains(lower(n), al) GROUP BY ALL),
crop AS (SELECT conv_id, turn, arg_min(name, [instr(lower(n), al), -r[1], -r[2]]) AS crop FROM ch GROUP BY ALL)"""
EXP = S.values("ex", ["intent", "tail"], [(k, v.replace("{crop}", "")) for k, v in vocab.INTENT_EXPANSIONS.items()])


@query("q_expand_queries", f"""WITH {KW}, {ASKED}, {CROPS_Q}, {EXP},
h AS (SELECT DISTINCT conv_id, turn, intent, ord FROM a JOIN kw ON contains(lower(n), word)),
v AS (SELECT conv_id, turn, n AS q, 0 AS o FROM a
  UNION ALL SELECT conv_id, turn, crop || ' ' || n, 1 FROM crop JOIN a USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, crop || tail, 2 + ord FROM crop JOIN h USING (conv_id, turn) JOIN ex USING (intent)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS variant FROM v)
SELECT conv_id AS qid, turn, CAST(variant AS INTEGER) AS variant, sha256(q) AS query FROM r WHERE variant < 6""")
def expand_queries(spark, sf):
    p = queryplan.plan_queries(_asked(spark, sf))
    return p.select("qid", "turn", F.posexplode("expanded").alias("variant", "q")).select(
        "qid", "turn", "variant", F.sha2("q", 256).alias("query"))


MQ_ASKED = f"""{S.values("alias", ["al", "name", "ord"], vocab.crop_alias_rows())}, {KW}, {EXP},
a AS (SELECT item_id AS qid, {S.collapse('text')} AS n FROM benchmark),
ch0 AS (SELECT qid, name, n, arg_max(al, [length(al), -ord]) AS al, max([length(al), -ord]) AS r FROM a JOIN alias
  ON length(al) >= 2 AND contains(lower(n), al) GROUP BY ALL),
crop AS (SELECT qid, arg_min(name, [instr(lower(n), al), -r[1], -r[2]]) AS crop FROM ch0 GROUP BY ALL),
h AS (SELECT DISTINCT qid, intent, ord FROM a JOIN kw ON contains(lower(n), word)),
v AS (SELECT qid, n AS q, 0 AS o FROM a UNION ALL SELECT qid, crop || ' ' || n, 1 FROM crop JOIN a USING (qid)
  UNION ALL SELECT qid, crop || tail, 2 + ord FROM crop JOIN h USING (qid) JOIN ex USING (intent)),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS variant FROM v),
asked AS MATERIALIZED (SELECT qid * 10 + variant AS id, q AS t FROM vr WHERE variant < 6)"""
MQ_BM25 = f"{MQ_ASKED}, " + BM25.replace("asked AS (SELECT item_id AS id, text AS t FROM benchmark),\n", "")


@query("q_multi_query", f"""WITH {MQ_BM25}, {TFIDF}, {DENSE}, {RRF},
m AS (SELECT qid // 10 AS qid, doc_id, sum(1.0 / (1 + 0.15 * (qid % 10)) / (60 + rank))::DOUBLE AS s FROM rr WHERE rank <= {TOP} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 8) DESC, doc_id) AS rank FROM m)
SELECT qid, doc_id, round(s, 6) AS rrf_score FROM k WHERE rank <= {TOP}""")
def multi_query(spark, sf):
    """Every expanded query runs the hybrid search; results fuse per original query."""
    plans = materialize(queryplan.expand_queries(queryplan.plan_queries(_queries(spark, sf))), "expansions")
    asked = plans.select(F.struct("qid", "variant").alias("k"), "query").select(
        F.to_json("k").alias("qid"), "query")
    hits = _index(spark, sf).hybrid(asked, TOP)
    back = hits.select(F.from_json("qid", "qid bigint, variant int").alias("k"), "doc_id", "rank").select("k.*", "doc_id", "rank")
    fused = retrieval.multi_query_fusion(back, TOP)
    return fused.select("qid", "doc_id", F.round("rrf_score", 6).alias("rrf_score"))


TOOLS_SQL = " || ".join(
    f"CASE WHEN len(list_intersect(il, [{', '.join(S.lit(n) for n in needs)}])) > 0 THEN [{', '.join(S.lit(t) for t in tools)}] ELSE [] END"
    for needs, tools in queryplan.TOOL_ROUTES)
AGENTS_SQL = " || ".join(
    "CASE WHEN list_contains(il, " + S.lit(i) + ")" + "".join(f" OR contains(q, {S.lit(w)})" for w in ws)
    + f" THEN [{', '.join(S.lit(x) for x in ags)}] ELSE [] END" for i, ws, ags in queryplan.AGENT_ROUTES)
UNIQ = "array_to_string(list_filter({x}, lambda e, i: list_position({x}, e) = i), '|')"


@query("q_routing", f"""WITH {KW}, {ASKED},
h AS (SELECT DISTINCT conv_id, turn, intent, ord FROM a JOIN kw ON contains(lower(n), word)),
l AS (SELECT conv_id, turn, list(intent ORDER BY ord) AS il FROM h GROUP BY ALL),
b AS (SELECT conv_id, turn, lower(n) AS q, coalesce(il, ['general']) AS il FROM a LEFT JOIN l USING (conv_id, turn)),
x AS (SELECT conv_id, turn, {TOOLS_SQL} || ['open_source_catalog'] AS tl, {AGENTS_SQL} AS al FROM b)
SELECT conv_id AS qid, turn, {UNIQ.format(x='tl')} AS tools,
  CASE WHEN len(al) = 0 THEN '{"|".join(queryplan.DEFAULT_AGENTS)}' ELSE {UNIQ.format(x='al')} END AS agents FROM x""")
def routing(spark, sf):
    p = queryplan.plan_queries(_asked(spark, sf))
    return p.select(
        "qid", "turn", F.array_join(queryplan.route_tools(F.col("intents")), "|").alias("tools"),
        F.array_join(queryplan.route_agents(F.col("query"), F.col("intents")), "|").alias("agents"))


@query("q_farm_context", f"""WITH {ASKED}, {CROPS_Q}
SELECT a.conv_id AS qid, a.turn, c_name AS farmer, coalesce(crop, c_mktsegment, 'Pomegranate') AS context_crop
FROM a LEFT JOIN crop USING (conv_id, turn) LEFT JOIN customer ON c_custkey = a.conv_id""")
def farm_context(spark, sf):
    farms = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("farm_id"), F.col("c_name").alias("farmer"), F.col("c_mktsegment").alias("farm_crop"))
    q = _asked(spark, sf).withColumn("farm_id", F.col("qid"))
    return queryplan.farm_context(q, farms).select("qid", "turn", "farmer", "context_crop")


@query("q_scheme_search", """
WITH t AS (SELECT DISTINCT c_custkey AS qid, unnest(['needs', lower(c_mktsegment), CASE WHEN c_nationkey > 12 THEN 'ring' ELSE 'gear' END]) AS tok,
    c_nationkey FROM customer WHERE c_nationkey > 3),
i AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS blob FROM part),
m AS (SELECT DISTINCT qid, p_partkey FROM (SELECT DISTINCT tok FROM t WHERE length(tok) > 3) d JOIN i ON contains(blob, d.tok) JOIN t USING (tok)),
r AS (SELECT qid, p_partkey, row_number() OVER (PARTITION BY qid ORDER BY p_partkey) AS rank, TRUE AS matched FROM m),
f AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rank FROM part ORDER BY p_partkey LIMIT 8)
SELECT qid, p_partkey, CAST(rank AS INTEGER) AS rank, matched FROM r WHERE rank <= 8
UNION ALL SELECT c_custkey, p_partkey, CAST(rank AS INTEGER), c_nationkey = 0 FROM customer CROSS JOIN f
  WHERE c_custkey NOT IN (SELECT qid FROM m) AND rank <= CASE WHEN c_nationkey = 0 THEN 8 ELSE 5 END""")
def scheme_search(spark, sf):
    c = table(spark, sf, "customer")
    word = F.when(F.col("c_nationkey") > 12, "ring").otherwise("gear")
    text = F.when(F.col("c_nationkey") > 3, F.concat(F.lit("needs "), "c_mktsegment", F.lit(" "), word)).when(F.col("c_nationkey") > 0, "a an the").otherwise("")
    q = c.select(F.col("c_custkey").alias("qid"), text.alias("query"))
    blob = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand")
    return queryplan.search_catalog(q, table(spark, sf, "part"), "p_partkey", blob)


@query("q_entity_lookup", """
WITH e AS (SELECT 0 AS kind_order, CAST(p_partkey AS BIGINT) AS ord, 'part_' || p_partkey AS doc_id, p_name AS name FROM part
  UNION ALL SELECT 1, s_suppkey, 'supplier_' || s_suppkey, s_name FROM supplier)
SELECT doc_id, name FROM e WHERE contains(lower(name), 'widget') ORDER BY kind_order, ord LIMIT 20""")
def entity_lookup(spark, sf):
    p = table(spark, sf, "part").select(
        F.lit(0).alias("kind_order"), F.col("p_partkey").alias("ord"), F.concat(F.lit("part_"), "p_partkey").alias("doc_id"),
        F.col("p_name").alias("name"))
    s = table(spark, sf, "supplier").select(
        F.lit(1).alias("kind_order"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("supplier_"), "s_suppkey").alias("doc_id"),
        F.col("s_name").alias("name"))
    return queryplan.lookup_entities(p.unionByName(s), "Widget").select("doc_id", "name")


@query("q_catalog_documents", """
SELECT 'tool_catalog_' || p_partkey AS doc_id, p_name AS title, p_name || ' (' || p_type || '): ' || p_brand || ' — ' || p_size AS content,
  'open_source_catalog' AS source FROM part""")
def catalog_documents(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
        F.col("p_brand").alias("use"), F.col("p_size").alias("url"))
    return queryplan.catalog_documents(p).select("doc_id", "title", "content", "source")


@query("q_diagnose", """
WITH d AS (SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'rust') THEN 'NATION_3'
  WHEN contains(p_name, 'ring') THEN 'NATION_7' ELSE 'NATION_1' END AS disease FROM part)
SELECT p_partkey, disease, n_nationkey, n_regionkey FROM d LEFT JOIN nation ON n_name = disease""")
def diagnose(spark, sf):
    facts = table(spark, sf, "nation").select(F.col("n_name").alias("disease"), "n_nationkey", "n_regionkey")
    rules = [(["red", "rust"], "NATION_3"), (["ring"], "NATION_7")]
    hints = table(spark, sf, "part").select("p_partkey", "p_name")
    return queryplan.diagnose(hints, facts, F.col("p_name"), "NATION_1", rules).select(
        "p_partkey", "disease", "n_nationkey", "n_regionkey")


# --- graph -----------------------------------------------------------------------------------------

REL = "CASE l_returnflag WHEN 'A' THEN 'AFFECTED_BY' WHEN 'N' THEN 'GROWS_IN' ELSE 'REQUIRES_FERTILIZER' END"
GRAPH = f"""raw AS (SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, {REL} AS relation,
    [lpad(CAST(l_orderkey AS VARCHAR), 20, '0'), lpad(CAST(l_linenumber AS VARCHAR), 20, '0'), strftime(l_shipdate, '%Y-%m-%d')] AS ord FROM lineitem
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'COVERED_BY', [lpad(CAST(s_suppkey AS VARCHAR), 20, '0'), '', ''] FROM supplier),
edges AS MATERIALIZED (SELECT source, target, arg_max(relation, ord || [relation]) AS relation FROM raw GROUP BY ALL),
nodes AS (SELECT 'S' || s_suppkey AS id, 'Supplier' AS label FROM supplier UNION ALL SELECT 'P' || p_partkey, 'Part' FROM part
  UNION ALL SELECT 'N' || n_nationkey, 'Nation' FROM nation)
"""


def _graph(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate")
    flag = F.col("l_returnflag")
    rel = F.when(flag == "A", "AFFECTED_BY").when(flag == "N", "GROWS_IN").otherwise("REQUIRES_FERTILIZER")
    a = li.select(
        F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), rel.alias("relation"),
        F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("n"),
                 F.date_format("l_shipdate", "yyyy-MM-dd").alias("t"), rel.alias("r")).alias("ord"))
    s = table(spark, sf, "supplier")
    b = s.select(
        F.concat(F.lit("N"), "s_nationkey").alias("source"), F.concat(F.lit("S"), "s_suppkey").alias("target"),
        F.lit("COVERED_BY").alias("relation"),
        F.struct(F.col("s_suppkey").alias("o"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("t"),
                 F.lit("COVERED_BY").alias("r")).alias("ord"))

    def node(name, prefix, key, label, prop):
        return table(spark, sf, name).select(
            F.concat(F.lit(prefix), key).alias("id"), F.lit(label).alias("label"),
            F.create_map(F.lit("name"), prop).alias("properties"), F.col(key).cast("bigint").alias("ord"))

    nodes = node("supplier", "S", "s_suppkey", "Supplier", "s_name").unionByName(
        node("part", "P", "p_partkey", "Part", "p_name")).unionByName(node("nation", "N", "n_nationkey", "Nation", "n_name"))
    return graph.build_graph(nodes, a.unionByName(b))


@query("q_graph_edges", f"WITH {GRAPH} SELECT source, target, relation FROM edges")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1].select("source", "target", "relation")


@query("q_neighbors", f"""WITH {GRAPH}
SELECT e.source AS id, 'outgoing' AS direction, relation, target AS neighbor, label FROM edges e LEFT JOIN nodes ON id = target
UNION ALL SELECT e.target, 'incoming', relation, source, label FROM edges e LEFT JOIN nodes ON id = source""")
def neighbors(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.all_neighbors(nodes, edges).select("id", "direction", "relation", "neighbor", "label")


@query("q_two_hop", f"""WITH {GRAPH},
st AS MATERIALIZED (SELECT source AS a, target AS b, '>' || relation AS s FROM edges UNION ALL SELECT target, source, '<' || relation FROM edges),
h1 AS MATERIALIZED (SELECT a AS id, b AS node, min({{'path': s, 'via': a}}) AS w FROM st WHERE a <> b AND a LIKE 'N%' GROUP BY ALL),
h2 AS (SELECT h1.id, st.b AS node, min({{'path': h1.w.path || s, 'via': st.a}}) AS w FROM h1 JOIN st ON st.a = h1.node WHERE st.b <> h1.id GROUP BY ALL),
al AS (SELECT id, 1 AS hop, node, w FROM h1 UNION ALL SELECT id, 2, node, w FROM h2 WHERE NOT EXISTS (FROM h1 WHERE h1.id = h2.id AND h1.node = h2.node))
SELECT id, hop, w.path AS path, count(*) AS n, min(node) AS first_node, max(node) AS last_node, min(w.via) AS first_via FROM al GROUP BY ALL""")
def two_hop(spark, sf):
    """What lies within two hops of every nation, by the relations that lead there."""
    _, edges = _graph(spark, sf)
    nations = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    found = graph.within_hops(nations, edges)
    return found.groupBy("id", "hop", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node"), F.max("node").alias("last_node"), F.min("via").alias("first_via"))


@query("q_ecosystem", f"""WITH {GRAPH}, a AS (SELECT source AS id, relation FROM edges UNION ALL SELECT target, relation FROM edges)
SELECT id, count(*) FILTER (relation = 'AFFECTED_BY') AS pests_and_diseases, count(*) FILTER (relation = 'GROWS_IN') AS soil_types,
  count(*) FILTER (relation = 'REQUIRES_FERTILIZER') AS recommended_fertilizers, count(*) FILTER (relation = 'COVERED_BY') AS applicable_schemes
FROM a GROUP BY id""")
def ecosystem(spark, sf):
    return graph.ecosystem_counts(graph.both_ways(_graph(spark, sf)[1]))


@query("q_entity_match", """
WITH n AS (SELECT s_name AS entity FROM supplier UNION SELECT lower(n_name) FROM nation),
i AS (SELECT n_name AS id, n_nationkey AS ord FROM nation UNION ALL SELECT s_name, 1000 + s_suppkey FROM supplier)
SELECT entity, arg_min(id, ord) AS id FROM n JOIN i ON contains(lower(id), lower(entity)) GROUP BY 1""")
def entity_match(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    names = s.select(F.col("s_name").alias("entity")).union(n.select(F.lower("n_name").alias("entity"))).distinct()
    nodes = n.select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("bigint").alias("ord")).union(
        s.select(F.col("s_name").alias("id"), (F.col("s_suppkey") + 1000).alias("ord")))
    return graph.match_entities(names, nodes)


