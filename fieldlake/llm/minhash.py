"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles: a shingle that occurs more often weighs
more, up to HEAVIEST. Each element's arrivals are a Poisson process with its weight as rate; every
arrival falls on a register, and a register keeps the element that arrived first, so the share of
equal registers of two documents estimates their probability Jaccard similarity. An element stops as
soon as its next arrival is later than the latest register. Bands of registers give candidates;
candidates are verified on the whole shingle sets: linked if their plain Jaccard similarity is at
least the threshold. With weights from 1 to W the probability Jaccard is at least the plain one
divided by W whatever the counts (no ratio of weights in its sums exceeds W), so bands and the
estimate's bound are sized for SIMILARITY / HEAVIEST.

Exact copies share one signature row. In a band's bucket every member is first compared with the
bucket's smallest id, its leader; only buckets that still hold several components are compared
further. Small ones are paired by a join. The members of large ones meet by leader in blocks of
bounded size, where products of shingle incidence matrices give every pair's exact similarity;
what leaves a block is one verified link per member, never its list of pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.graph import components
from fieldlake.llm.textkernel import mix, slices, windows, words
from fieldlake.session import arrow_rows
from fieldlake.sources.store import materialize

#: Words of a shingle; similarity of near copies; weight that a shingle's count cannot lift it above.
SHINGLE, SIMILARITY, HEAVIEST = 5, 0.8, 1.25
#: Bands and registers of a band. Two texts of similarity 0.8 with the same counts share no band with a
#: chance of 6e-10; with counts that differ as much as can be (probability Jaccard 0.64) of 7e-4.
BANDS, ROWS = 40, 4
#: Least share of equal registers of candidates that are verified: five standard deviations (of 160
#: registers) below SIMILARITY / HEAVIEST, so at worst 3e-7 of the links' candidates have fewer.
ESTIMATE = 0.45
#: Buckets up to this size are paired by a join, larger ones in blocks of about BLOCK; shingles of
#: one matrix product.
SMALL, BLOCK, COLUMNS = 16, 1_000, 8_192
#: Bytes of shingle sets of a block, about; characters of texts that are worked on at once; texts or sets that are sent to Python at once.
BLOCK_BYTES, SLICE, SENT = 8_000_000, 250_000, 500


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by text and hash."""
    hashes, _, offsets = words(texts)
    text, value = windows(hashes, offsets, width)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(texts: list[str], registers: int = BANDS * ROWS, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first arrivals' element hashes [texts, registers] as uint32, whether the text has shingles)."""
    text, value, count = shingles(texts, width)
    rate = HEAVIEST - (HEAVIEST - 1) / count
    first = np.full(len(texts) * registers, np.inf)
    element = np.zeros(len(texts) * registers, np.uint32)
    time = np.zeros(len(text))
    done, step = 0, 1
    alive = np.arange(len(text))
    while len(alive):
        draws = np.arange(done, done + step, dtype=np.uint64) * np.uint64(2)
        seed = value[alive][:, None] + mix(draws)[None, :]
        arrival = time[alive][:, None] + np.cumsum(-np.log(_uniform(seed)), 1) / rate[alive][:, None]
        register = (mix(seed + np.uint64(1)) % np.uint64(registers)).astype(np.int64)
        slot = (text[alive][:, None] * registers + register).ravel()
        when = arrival.ravel()
        early = np.flatnonzero(when < first[slot])
        order = early[np.lexsort((when[early], slot[early]))]
        best = order[np.diff(slot[order], prepend=-1) != 0]
        first[slot[best]] = when[best]
        element[slot[best]] = (value[alive[best // step]] >> np.uint64(32)).astype(np.uint32)
        time[alive] = arrival[:, -1]
        latest = first.reshape(-1, registers).max(1)
        alive = alive[time[alive] < latest[text[alive]]]
        done += step
        step = min(64, step * 2)
    has = np.zeros(len(texts), bool)
    has[text] = True
    return element.reshape(-1, registers), has


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band of each signature."""
    parts = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
    return key.astype(np.int64)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy_key, sig, bands) of every row with a text; sig and bands are null without words.

    `sig` keeps 16 bits of each register, which is enough for estimates; bands are made of 32."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null and doc_id is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build(batches):
        for b in batches:
            at = 0
            for part in slices(b["text"], SLICE):
                sig, has = signatures(part)
                keys = band_keys(sig)
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[at : at + len(part)].to_numpy(),
                    "copy_key": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part],
                    "sig": [s.astype(np.uint16).tobytes() if h else None for s, h in zip(sig, has, strict=True)],
                    "bands": [k.tolist() if h else None for k, h in zip(keys, has, strict=True)],
                })
                at += len(part)

    return rows.mapInPandas(build, f"doc_id {kind}, copy_key binary, sig binary, bands array<long>")


def _alike(sigs_a: pd.Series, sigs_b: pd.Series) -> np.ndarray:
    a = np.frombuffer(b"".join(sigs_a), np.uint16).reshape(len(sigs_a), -1)
    b = np.frombuffer(b"".join(sigs_b), np.uint16).reshape(len(sigs_b), -1)
    return (a == b).mean(1)


def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of equal registers of two signatures."""
    return pd.Series(_alike(a, b) if len(a) else [], dtype=float)


def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of two sorted shingle sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.isin(x, y, assume_unique=True).sum()
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """(doc_id, s): the sorted shingle set of each wanted id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches):
        for b in batches:
            at = 0
            for part in slices(b["text"], SLICE):
                text, value, _ = shingles(part)
                cut = np.searchsorted(text, np.arange(len(part) + 1)).tolist()
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at : at + len(part)].to_numpy(),
                                    "s": [value[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)]})
                at += len(part)

    # one set per id: repeated rows have the same one. The ids are hashed, so texts stream past them and are not sorted
    found = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    with arrow_rows(docs.sparkSession, SENT):
        return materialize(found.mapInPandas(sets, f"doc_id {kind}, s binary").dropDuplicates(["doc_id"]), label)


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, similarity: float, label: str) -> DataFrame:
    """Those of `pairs` (u, v) whose estimate and then whose shingle sets are alike enough."""
    alike, overlap = F.pandas_udf(estimate, "double"), F.pandas_udf(jaccard, "double")
    near = materialize(
        pairs.join(sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("su")), "u")
        .join(sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv")), "v")
        .where(alike("su", "sv") >= ESTIMATE).select("u", "v"), f"{label}-candidates")
    sets = _shingle_sets(docs, near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), f"{label}-sets")
    with arrow_rows(docs.sparkSession, SENT):
        return materialize(
            near.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("su")), "u")
            .join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sv")), "v")
            .where(overlap("su", "sv") >= similarity).select("u", "v"), f"{label}-links")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of every set of `left` with every set of `right`."""
    sets = left + right
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1  # a shingle of one text alone is in no intersection
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        incidence = np.zeros((len(sets), COLUMNS), np.float32)
        incidence[row[a:b], column[a:b] - first] = 1
        both += incidence[: len(left)] @ incidence[len(left) :].T
    return both / (size[: len(left), None] + size[None, len(left) :] - both)


def _crowd_links(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Verified links (u, v) inside large buckets that still hold several components.

    members: (leader, doc_id, component). Texts of one bucket share its leader; a leader's members
    are dealt by hash to blocks of bounded members and bytes, every two blocks meet in a task of
    their own, and a task returns for each member at most one link, to a text of the same component
    of its links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = _shingle_sets(docs, members.select("doc_id").distinct(), "crowd-sets")
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)
    sizes = members.join(sets.select("doc_id", F.length("s").alias("bytes")), "doc_id").groupBy("leader").agg(F.ceil(size).cast("int").alias("blocks"))
    dealt = (
        members.join(sizes, "leader").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leader", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "component", "s")
    )

    def meet(key, g):
        g = g.reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in g["s"]]
        own, ids, group = g["own"].to_numpy(), g["doc_id"].to_numpy(), pd.factorize(g["component"])[0]
        left = np.flatnonzero(own == key[1])
        right = left if key[1] == key[2] else np.flatnonzero(own == key[2])
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []})
        a, b = np.nonzero(overlaps([sets[i] for i in left], [sets[i] for i in right]) >= similarity)
        a, b = left[a], right[b]
        use = (a != b) & (group[a] != group[b])
        a, b = a[use], b[use]
        best = pd.DataFrame({"a": np.maximum(ids[a], ids[b]), "b": np.minimum(ids[a], ids[b])})
        # a forest over components is enough: each pair of components once
        best["x"], best["y"] = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
        best = best.drop_duplicates(["x", "y"])
        root = {k: k for k in range(group.max() + 1)}

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for r in best.itertuples():
            i, j = find(r.x), find(r.y)
            if i != j:
                root[i] = j
                out.append((r.b, r.a))
        return pd.DataFrame(out, columns=["u", "v"])

    return materialize(dealt.groupBy("leader", "x", "y").applyInPandas(meet, f"u {kind}, v {kind}"), "crowd-links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy_of, cluster_id, kept) of every row.

    copy_of: the smallest id with exactly this text. cluster_id: the smallest id reachable by links.
    kept: whether the row is its cluster's document. A null text (or id) is like nothing; a text
    without words is like its exact copies only; one of fewer than five words is a single shingle.
    Rows with the same id are taken as one document. An empty table gives an empty one; other
    columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    with arrow_rows(docs.sparkSession, SENT):
        all_rows = materialize(sketch(base), "sketches")
    classes = all_rows.groupBy("copy_key").agg(F.min("doc_id").alias("rep"))
    members = materialize(
        all_rows.select("doc_id", "copy_key", "bands").join(classes, "copy_key")
        .select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "copies")
    sigs = all_rows.where("sig is not null").groupBy("doc_id").agg(F.first("sig").alias("sig"))
    banded = members.select("doc_id", F.explode("bands").alias("key")).distinct()
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    in_buckets = materialize(banded.join(buckets, "key"), "buckets")
    stars = in_buckets.where("doc_id <> leader").select(F.col("leader").alias("u"), F.col("doc_id").alias("v")).distinct()
    links = _verified(stars, sigs, base, similarity, "stars")
    joined = components(links, "near-components")
    # buckets whose members are in one component need nothing more
    placed = in_buckets.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialize(placed.select("key", "doc_id", "n", "component", "leader"), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    unsettled = materialize(placed.join(several, "key", "left_semi"), "unsettled")
    small = unsettled.where(F.col("n") <= SMALL)
    other = small.select("key", F.col("doc_id").alias("v"), F.col("component").alias("cv"))
    pairs = (
        small.where("doc_id <> leader").select("key", F.col("doc_id").alias("u"), F.col("component").alias("cu"))
        .join(other, "key").where("u < v and cu <> cv").select("u", "v").distinct().join(stars, ["u", "v"], "left_anti")
    )
    crowd = materialize(unsettled.where(F.col("n") > SMALL).select("leader", "doc_id", "component").distinct(), "crowds")
    links = links.unionByName(_verified(pairs, sigs, base, similarity, "cross")).unionByName(_crowd_links(crowd, base, similarity))
    clusters = components(links, "near-clusters")
    found = (
        members.join(clusters.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("cluster_id")).distinct()
        .groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"), F.min("cluster_id").alias("cluster_id"))
    )
    out = base.select("doc_id").join(found, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("cluster_id", "doc_id").alias("cluster_id"),
        (F.coalesce("cluster_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )
