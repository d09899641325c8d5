"""How far the sources of a language are from each other in the words they use.

Tasks over documents count terms per (language, source) and hand on sums, so a source with a third of
all documents sends one row per task and term. Terms in enough documents of a language are kept and
get an id. A group's kept terms become arrays of (term id, count), sorted by id, one per block of
terms, which bounds an array by the block whatever the vocabulary. The groups of a language are dealt
to tiles; every two tiles are co-grouped in a task of their own, which merges the arrays of each
unordered pair of groups: a galloping intersection finds the shared terms, then shared, one-sided and
absent terms are priced, and the sums of the blocks are added. Each pair gives a row both ways.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.sources.store import materialize

#: Documents of its language that a kept term occurs in at least; added to every count; scale of a share.
LEAST_DOCS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
#: Terms that are reported of a group.
TOP = 50
#: Kept terms of a block and groups of a tile: a merge task holds at most two tiles of one block.
BLOCK_TERMS, TILE = 65_536, 4
#: Different (language, source, term) sums a task holds before it hands them on.
HELD = 400_000

# a term is a run of ASCII letters and of bytes of other characters; only A-Z are lower-cased
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group.

    The term '' stands for the group itself: every group has it, also one without terms, and its
    `docs` are all documents of the group.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])

    names = ["lang", "source", "term", "n", "docs"]

    def handed_on(sums: dict[tuple[str, str], tuple[Counter, Counter]]):
        for (l, s), (n, df) in sums.items():
            term = pa.array(list(df), pa.binary()).cast(pa.string())
            columns = [pa.repeat(l, len(df)), pa.repeat(s, len(df)), term, pa.array(list(map(n.__getitem__, df)), pa.int64()), pa.array(list(df.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    def count(batches):
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for b in batches:
            for l, s, t in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if (l, s) not in sums:
                    sums[l, s] = Counter({b"": 0}), Counter({b"": 0})
                n, df = sums[l, s]
                before = len(df)
                found = terms(t)
                n.update(found)
                df.update(set(found))
                df[b""] += 1
                held += len(df) - before
                if held > HELD:
                    yield from handed_on(sums)
                    sums, held = {}, 0
        yield from handed_on(sums)

    own = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / total), exact for totals up to 9e15: three decimal digits at a time."""
    rest = count.astype(np.int64) + SMOOTHING
    out = np.zeros(len(rest), np.int64)
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray, stride: int = 512) -> np.ndarray:
    """For each value of `short` its place in `long`, or -1; both are sorted and without repeats.

    The search for a stride of values starts where the last one ended and doubles its reach until it
    passes the stride's greatest value; only that stretch of `long` is searched.
    """
    out = np.full(len(short), -1, np.int64)
    at = 0
    for k in range(0, len(short), stride):
        part = short[k : k + stride]
        reach = stride
        while at + reach < len(long) and long[at + reach] < part[-1]:
            reach *= 2
        stretch = long[at : at + reach + 1]
        place = np.searchsorted(stretch, part)
        hit = place < len(stretch)
        hit[hit] = stretch[place[hit]] == part[hit]
        out[k : k + stride][hit] = at + place[hit]
        at += int(place[-1]) if len(place) else 0
        if at >= len(long):
            break
    return out


def merge(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int]:
    """(sum of |p - q| over the terms of either group, number of such terms) for (ids, counts, total) of two groups."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, n, total), (other_ids, m, other_total) = a, b
    if not len(other_ids):
        return 0, 0
    place = gallop(ids, other_ids)
    both = place >= 0
    p, q = share(n, total), share(m, other_total)
    p0, q0 = (int(share(np.zeros(1, np.int64), t)[0]) for t in (total, other_total))
    alone = np.ones(len(other_ids), bool)
    alone[place[both]] = False
    value = np.abs(p[both] - q[place[both]]).sum() + np.abs(p[~both] - q0).sum() + np.abs(q[alone] - p0).sum()
    return int(value), int(len(ids) + alone.sum())


def _pairs(arrays: DataFrame) -> DataFrame:
    """(lang, a, b, value, terms) of every two groups of a language and every block; a < b."""
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = arrays.withColumn("other", others).where("other >= tile").select("*", F.col("tile").alias("x"), F.col("other").alias("y"))
    right = arrays.withColumn("other", others).where("other < tile").select("*", F.col("other").alias("x"), F.col("tile").alias("y"))

    def unpack(g: pd.DataFrame) -> list[tuple]:
        if not len(g):  # a side without rows may come without columns
            return []
        return [(s, (np.asarray(i, np.int64), np.asarray(n, np.int64), t)) for s, i, n, t in zip(g["source"], g["ids"], g["ns"], g["total"], strict=True)]

    def meet(key, g, h):
        own, other = unpack(g), unpack(h)
        out = []
        for k, (s, a) in enumerate(own):
            for t, b in other if key[2] != key[3] else own[k + 1 :]:
                out.append((key[0], min(s, t), max(s, t), *merge(a, b)))
        return pd.DataFrame(out, columns=["lang", "a", "b", "value", "terms"])

    keys = ["lang", "block", "x", "y"]
    kept = [*keys, "source", "ids", "ns", "total"]
    return left.select(kept).groupBy(keys).cogroup(right.select(kept).groupBy(keys)).applyInPandas(
        meet, "lang string, a string, b string, value long, terms long")


def _share(count: str, total: str):
    """`share` as a column: a quotient of decimals is exact."""
    return F.expr(f"1 + cast({SCALE} * cast({count} + {SMOOTHING} as decimal(20,0)) as decimal(38,0)) div cast({total} as decimal(20,0))")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part `pair` has a row for every other source of the language, part `term` the `top` terms that the
    group uses more than its language does. Null texts, languages and sources are ''; repeated rows
    each count; a group without terms has its pairs; ties rank by the item's UTF-8; an empty table
    gives no rows; other columns are not read.
    """
    counts = materialize(term_counts(docs, lang, source, text), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    # ids are given once and written, so every later read sees the same
    kept = materialize(kept.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id")), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("n_lang"))
    own = materialize(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "lang_n"), "group-terms")
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = counts.where("term = ''").select("lang", "source")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    groups = materialize(
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(tiles, "lang").select(
            "lang", "source", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"),
            F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n_group", F.lit(0)) + SMOOTHING * F.coalesce("v", F.lit(0))).alias("total"),
            (F.coalesce("n_lang", F.lit(0)) + SMOOTHING * F.coalesce("v", F.lit(0))).alias("lang_total"),
            F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / BLOCK_TERMS), F.lit(1)).cast("int").alias("blocks"),
        ), "groups")

    of_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    arrays = (
        own.join(groups.select("lang", "source", "blocks"), ["lang", "source"])
        .groupBy("lang", "source", of_block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("t"))
    )
    none = F.array().cast("array<bigint>")
    arrays = materialize(
        groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(arrays, ["lang", "source", "block"], "left")
        .select("lang", "source", "block", "tile", "tiles", "total", F.coalesce("t.id", none).alias("ids"), F.coalesce("t.n", none).alias("ns")), "term-arrays")
    summed = _pairs(arrays).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    facts = groups.select("lang", F.col("source").alias("a"), "v", F.when(F.col("v") > 0, _share("0L", "total")).alias("p0"))
    absent = (F.col("v") - F.col("terms")) * F.abs(F.col("p0") - F.col("q0"))
    priced = (
        summed.join(facts, ["lang", "a"]).join(facts.select("lang", F.col("a").alias("b"), F.col("p0").alias("q0")), ["lang", "b"])
        .select("lang", "a", "b", F.when(F.col("v") > 0, F.col("value") + absent).otherwise(F.lit(0)).cast("long").alias("value"))
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = priced.select("lang", both.alias("k"), "value").select("lang", "k.source", F.lit("pair").alias("part"), "k.item", "value")
    term = (
        own.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (_share("n", "total") - _share("lang_n", "lang_total")).alias("value"))
        .where("value > 0")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.unionByName(term)


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
w AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS n FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS c, k.lang_n,
         1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (tot.n + 5 * langs.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (langs.n + 5 * langs.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN langs USING (lang) JOIN tot USING (lang, source) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
