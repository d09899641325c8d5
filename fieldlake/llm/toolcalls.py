"""Tool calls of conversations linked with their results, in DataFrame functions only.

Calls and results meet by identifier in an equi-join, calls are ordered along their dependencies
by pointer doubling, arguments are checked against the tool's schema, and every linked call
becomes one line of canonical JSON (sorted keys, no blanks).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.sources.store import materialize

#: Field types a schema may ask for, and the variant types that satisfy them.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, parent_id): 1 without a known parent, else one more than its parent.

    Every round doubles the distance a call looks up, so a chain of n calls takes log2(n) rounds.
    A call whose parents form a circle has a null level.
    """
    ids = calls.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    state = materialize(
        calls.join(ids, "parent_id", "left").select("call_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("level")), "levels")
    n, reach = state.count(), 1
    while reach <= n and not state.where("up is not null").isEmpty():
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = materialize(state.join(above, "up", "left").select(
            "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        reach *= 2
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, parent_id, name, level, status, json) per call id.

    calls: (call_id, parent_id, name, arguments as JSON text); results: (call_id, content);
    schemas: (name, field, type, required). Of several calls or results with one id the smallest
    counts (`copies` in the JSON says how many calls there were); a null id is left out, results
    without a call are left out. status, the first that holds: `circular`, `bad_json`,
    `unknown_tool`, `missing_field`, `unknown_field`, `wrong_type`, `no_result`, `ok`.
    """
    one = calls.where("call_id is not null").groupBy("call_id").agg(
        F.min(F.struct("name", "arguments", "parent_id")).alias("c"), F.count(F.lit(1)).alias("copies"))
    one = materialize(one.select("call_id", "c.name", "c.arguments", "c.parent_id", "copies"), "calls")
    answers = results.where("call_id is not null").groupBy("call_id").agg(
        F.min_by("content", F.coalesce("content", F.lit(""))).alias("content"), F.lit(True).alias("answered"))
    # a tool has a handful of fields
    fields = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))
    joined = (
        one.join(answers, "call_id", "left").join(levels(one), "call_id").join(fields, "name", "left")
        .withColumn("given", F.from_json("arguments", "map<string,variant>"))
        .withColumn("body", F.expr("try_parse_json(arguments)"))
        .withColumn("types", F.transform_values("given", lambda _, v: F.regexp_replace(F.schema_of_variant(v), r"\(.*", "")))
    )

    def wrong_type(f):
        kind = F.element_at("types", f["field"])
        fits = [(f["type"] == name) & kind.isin(*kinds) for name, kinds in TYPES.items()]
        return kind.isNotNull() & ~reduce(or_, fits)

    missing = F.exists("fields", lambda f: f["required"] & ~F.array_contains(F.map_keys("given"), f["field"]))
    unknown = F.exists(F.map_keys("given"), lambda k: ~F.exists("fields", lambda f: f["field"] == k))
    status = (
        F.when(F.col("level").isNull(), "circular").when(F.col("body").isNull() | F.col("given").isNull(), "bad_json")
        .when(F.col("fields").isNull(), "unknown_tool").when(missing, "missing_field").when(unknown, "unknown_field")
        .when(F.exists("fields", wrong_type), "wrong_type").when(F.col("answered").isNull(), "no_result").otherwise("ok")
    )
    out = joined.withColumn("status", status)
    line = F.to_json(F.struct(
        F.col("body").alias("arguments"), "call_id", "copies", "level", "name", F.col("parent_id").alias("parent"), F.col("content").alias("result"), "status",
    ), {"ignoreNullFields": "false"})
    return out.select("call_id", "parent_id", "name", "level", "status", line.alias("json"))


SCHEMAS = [("reply", "query", "string", True), ("reply", "turn", "integer", True), ("setup", "query", "string", True), ("setup", "turn", "integer", True)]


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool traffic: (calls, results).

    A user or system turn is a call of `reply` or `setup` with the text as its query (a null text
    has no query); an assistant turn is the result of the call one turn earlier. A call depends on
    the turn before it if that is a call, or on the call two turns before if the turn between is
    an assistant's. Rows without conversation or turn have no id and are left out.
    """
    def call_id(turn):
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    asks = rows.where("role in ('user', 'system')")
    role_at = rows.groupBy("conv_id", "turn").agg(F.max(F.col("role").isin("user", "system")).alias("is_call"), F.max(F.col("role") == "assistant").alias("is_answer"))
    before = role_at.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("is_call").alias("call_1"), F.col("is_answer").alias("answer_1"))
    earlier = role_at.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("is_call").alias("call_2"))
    parent = F.when(F.col("call_1"), call_id(F.col("turn") - 1)).when(F.col("answer_1") & F.col("call_2"), call_id(F.col("turn") - 2))
    calls = asks.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left").select(
        call_id(F.col("turn")).alias("call_id"), parent.alias("parent_id"), F.when(F.col("role") == "user", "reply").otherwise("setup").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("query"))).alias("arguments"))
    results = rows.where("role = 'assistant'").select(call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """`link_calls` over all turns."""
    spark = conversations.sparkSession
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    calls, results = conversation_calls(conversations)
    return link_calls(calls, results, schemas)


ORACLE = """
WITH RECURSIVE r AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
kinds AS (SELECT conv_id, turn, bool_or(role IN ('user', 'system')) AS is_call, bool_or(role = 'assistant') AS is_answer FROM r GROUP BY 1, 2),
c AS (SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN 'reply' ELSE 'setup' END) AS name, min(text) AS text, count(*) AS copies
      FROM r WHERE role IN ('user', 'system') GROUP BY 1, 2),
p AS (SELECT c.*, CASE WHEN a.is_call THEN c.turn - 1 WHEN a.is_answer AND b.is_call THEN c.turn - 2 END AS up
      FROM c LEFT JOIN kinds a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN kinds b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
l AS (SELECT conv_id, turn, CAST(1 AS BIGINT) AS level FROM p WHERE up IS NULL
      UNION ALL SELECT p.conv_id, p.turn, l.level + 1 FROM p JOIN l ON l.conv_id = p.conv_id AND l.turn = p.up),
a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, true AS answered FROM r WHERE role = 'assistant' GROUP BY 1, 2),
o AS (SELECT p.conv_id || ':' || p.turn AS call_id, p.conv_id || ':' || p.up AS parent_id, name, level, text, copies, content, p.turn AS turn,
             CASE WHEN text IS NULL THEN 'missing_field' WHEN answered IS NULL THEN 'no_result' ELSE 'ok' END AS status
      FROM p JOIN l USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn))
SELECT call_id, parent_id, name, level, status,
       '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || to_json(text) || ',' END || '"turn":' || turn || '},"call_id":' || to_json(call_id) || ',"copies":' || copies || ',"level":' || level
       || ',"name":"' || name || '","parent":' || coalesce(to_json(parent_id)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS json
FROM o
"""
