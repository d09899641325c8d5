"""Captures judged by the list entries active when they were fetched, in DataFrame functions only.

Dated entries of a list (block, allow, remove) become validity intervals per key. A capture's
host and parent domains are looked up as of its fetch date; the most specific key with an active
entry decides. Lookups are done once per host and date, so a host with a third of all captures
costs as many lookups as it has dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The lower-case host; null if there is none."""
    h = F.regexp_extract(F.lower(url), _HOST, 1)
    return F.when(h != "", h)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to, action) from entries (key, entry_id, dated, action).

    An entry holds from its date until the key's next one (valid_to is null at the last); of
    several on one date the one with the largest id (then action) counts. `remove` only ends what
    was before. Entries without key, date or action are left out. A key has at most one row per
    date before it is ordered.
    """
    daily = entries.where("key is not null and dated is not null and action is not null").groupBy("key", "dated").agg(
        F.max(F.struct("entry_id", "action")).alias("last"))
    following = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    ranged = daily.select("key", F.col("dated").alias("valid_from"), following.alias("valid_to"), F.col("last.action").alias("action"))
    return ranged.where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with host, verdict (block, allow, none), matched_key, active_from and n_active.

    captures needs a url and a fetch date; a null or unreadable url or a null date has verdict none.
    Repeated captures are judged each. n_active counts the host's keys with an active entry. Other
    columns stay; columns named as the new ones are replaced. Empty tables give empty ones.
    """
    rows = captures.select(F.struct("*").alias("row"), host_of(F.col(url).cast("string")).alias("host"), F.col(fetched).alias("day"))
    asked = rows.select("host", "day").where("host is not null and day is not null").distinct()
    parts = F.split("host", r"\.")
    keys = asked.withColumn("parts", parts).select(
        "host", "day", "parts", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("i")
    ).select("host", "day", F.array_join(F.expr("slice(parts, i, size(parts))"), ".").alias("key"), (-F.col("i")).alias("depth"))
    # one row per key, interval and month, so that a lookup meets the intervals of its month only
    last_day = F.lit(captures.agg(F.max(F.col(fetched).cast("date"))).first()[0]).cast("date")
    spans = (
        intervals(entries).withColumn("ends", F.least(F.coalesce(F.date_sub("valid_to", 1), last_day), last_day)).where("valid_from <= ends")
        .withColumn("month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc("ends", "month"), F.expr("interval 1 month"))))
    )
    active = keys.withColumn("month", F.trunc("day", "month")).join(spans, ["key", "month"]).where("valid_from <= day and day <= ends")
    best = active.groupBy("host", "day").agg(F.max(F.struct("depth", "key", "valid_from", "action")).alias("b"), F.count(F.lit(1)).alias("n_active"))
    added = ("host", "verdict", "matched_key", "active_from", "n_active")
    return rows.join(best, ["host", "day"], "left").select(
        *[F.col("row")[c].alias(c) for c in captures.columns if c not in added], "host", F.coalesce("b.action", F.lit("none")).alias("verdict"), F.col("b.key").alias("matched_key"),
        F.col("b.valid_from").alias("active_from"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


def dated_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures, entries) from a table of pages: every page is a capture with a date that follows from
    its id, and every page also reports its host or its host's parent domain to the list."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    dated = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 53 % 365).cast("int"))
    host = host_of(F.col("url"))
    action = F.element_at(F.array(F.lit("block"), F.lit("block"), F.lit("allow"), F.lit("remove"), F.lit("remove")), (F.col("page_id") % 5 + 1).cast("int"))
    key = F.when(F.col("page_id") % 2 == 0, host).otherwise(F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.)", ""))
    captures = pages.select("page_id", "url", day.alias("fetched"))
    return captures, pages.select(key.alias("key"), F.col("page_id").alias("entry_id"), dated.alias("dated"), action.alias("action"))


def filtered_pages(pages: DataFrame) -> DataFrame:
    captures, entries = dated_pages(pages)
    return judge(captures, entries).select("page_id", "host", "fetched", "verdict", "matched_key", "active_from", "n_active")


ORACLE = r"""
WITH p AS (SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
                  DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched, DATE '2024-01-01' + CAST(page_id * 53 % 365 AS INTEGER) AS dated,
                  CASE page_id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'remove' END AS action FROM pages),
e AS (SELECT CASE WHEN page_id % 2 = 0 OR len(string_split(host, '.')) < 3 THEN host ELSE substr(host, strpos(host, '.') + 1) END AS key, dated, action, page_id FROM p),
d AS (SELECT key, dated, max_by(action, page_id) AS action FROM e WHERE key IS NOT NULL GROUP BY 1, 2),
i AS (SELECT key, dated AS valid_from, lead(dated) OVER (PARTITION BY key ORDER BY dated) AS valid_to, action FROM d),
k AS (SELECT page_id, host, fetched, n, array_to_string(string_split(host, '.')[n:], '.') AS key
      FROM (SELECT page_id, host, fetched, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS n FROM p WHERE host IS NOT NULL)),
m AS (SELECT page_id, min_by(action, n) AS action, min_by(k.key, n) AS key, min_by(valid_from, n) AS valid_from, count(*) AS n_active
      FROM k JOIN i ON i.key = k.key AND i.valid_from <= k.fetched AND (i.valid_to IS NULL OR k.fetched < i.valid_to) WHERE i.action <> 'remove' GROUP BY 1)
SELECT p.page_id, p.host, p.fetched, coalesce(m.action, 'none') AS verdict, m.key AS matched_key, m.valid_from AS active_from, coalesce(m.n_active, 0) AS n_active
FROM p LEFT JOIN m USING (page_id)
"""
