"""Best-fit packing of token sequences by fitted length patterns.

Documents become pieces of at most `size` tokens. The exact histogram of piece lengths (at most
`size` counts) is fitted with patterns of up to three lengths that fill a sequence: non-negative
least squares gives each pattern's repeat count, a share of the counts is rounded within what the
histogram holds, and the rest is packed best-fit decreasing over the histogram. All of that works on counts,
so the driver's work and memory depend on `size`, not on the documents. The resulting plan (runs
of equal sequences) is joined back by the rank of each piece within its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.tokens import VOCABULARY, Encoder, encoded
from fieldlake.sources.store import materialize

#: Splits of the remainder that are tried for each first length when patterns are enumerated.
SPLITS = 24
#: Shares of the fitted repeats that are tried; 0 is best-fit decreasing alone.
REPEATS = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
#: Pieces that one bucket of ranks should hold.
BUCKET_ROWS = 500_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which holds the remainder."""
    head = n % size or min(n, size)
    return [(0, head), *((s, size) for s in range(head, n, size))] if n else []


def pieces(docs: DataFrame, size: int = 2048, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text",
           vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null text is an empty one; with an end id it still has that one token.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def split(batches):
        for b in batches:
            out = []
            for i, ids in zip(b["doc_id"].tolist(), encoded(b["text"], vocabulary), strict=True):
                ids += tail
                out += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"doc_id": "Int64" if whole_number else object})
        Encoder.forget()

    whole_number = dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(split, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(size: int, present: np.ndarray, splits: int = SPLITS) -> np.ndarray:
    """Up to three occurring lengths (0 fills up) that sum to `size`, longest first."""
    have = np.flatnonzero(present)
    out = [np.array([[size, 0, 0]])] if present[size] else []
    pair = have[(have < size) & (have >= size - have)]
    pair = pair[present[size - pair]]
    out.append(np.stack([pair, size - pair, np.zeros_like(pair)], 1))
    for a in have[have < size - 1].tolist():
        rest = size - a
        b = have[(have <= min(a, rest - 1)) & (2 * have >= rest)]
        b = b[present[rest - b]]
        if len(b) > splits:
            b = b[np.unique(np.linspace(0, len(b) - 1, splits).astype(int))]
        out.append(np.stack([np.full_like(b, a), b, rest - b], 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def fit(pats: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts that bring the patterns' histogram nearest to `hist`, by accelerated
    projected gradient of the least-squares error. Errors weigh as the square of the length: short
    pieces left over still fit somewhere, long ones need a sequence each. An empty slot has no row."""
    size = len(hist) - 1
    x = y = np.zeros(len(pats))
    t = 1.0
    flat = pats.ravel()
    use = np.bincount(flat, minlength=size + 1)
    use[0] = 0
    weight = (np.arange(size + 1) / size) ** 2 + 0.01
    step = 1.0 / max(0.01, 3.0 * (use * weight).max())  # bounds the largest eigenvalue of the normal matrix
    for _ in range(steps):
        made = np.bincount(flat, np.repeat(y, 3), minlength=size + 1)
        error = (made - hist) * weight
        error[0] = 0
        new = np.maximum(0, y - step * error[pats].sum(1))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def fitted(hist: np.ndarray) -> list[tuple[list[int], float]]:
    """(slots, repeats) of the patterns that fit `hist`, most repeats first."""
    left = hist.astype(np.int64)
    size = len(hist) - 1
    # few pieces of a length ask for few patterns: counts below one cannot be rounded
    lengths = max(1, int((left > 0).sum()))
    pats = patterns(size, left > 0, int(np.clip(left.sum() // (8 * lengths), 1, SPLITS)))
    if not len(pats):
        return []
    x = fit(pats, left.astype(float))
    for least in (0.25, 0.5):  # the weight of patterns that would round to nothing goes to the others
        pats = pats[x >= least]
        x = fit(pats, left.astype(float)) if len(pats) else np.zeros(0)
    return [([v for v in pats[k].tolist() if v], float(x[k])) for k in np.argsort(-x, kind="stable").tolist()]


def plan(hist: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place every piece of `hist`.

    hist[l] is the number of pieces of length l; sequences are numbered from 0 without gaps. Every
    share in REPEATS of the fitted repeats is tried with the rest packed best-fit decreasing, and the
    plan with the fewest sequences is taken (of equal ones that with more patterns): where few pieces
    of a length make rounding costly, fewer pieces are bound to patterns.
    """
    found = fitted(hist)
    best: tuple[int, list] | None = None
    for share in REPEATS if found else (0.0,):
        seq, runs = placed(hist, found, share)
        if best is None or seq < best[0]:
            best = seq, runs
    return best[1]


def placed(hist: np.ndarray, found: list[tuple[list[int], float]], share: float) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(number of sequences, runs): patterns at a share of their repeats, then best fit for the rest."""
    size = len(hist) - 1
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    seq = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, first, offset))
        used[length] += n
        left[length] -= n

    for slots, repeats in found:
        n = round(repeats * share)
        n = min([n, *(int(left[v]) // slots.count(v) for v in slots)])
        if n > 0:
            offset = 0
            for v in slots:
                place(v, n, seq, offset)
                offset += v
            seq += n
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, number) of open runs
    keys: list[int] = []

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(keys, free)
            room[free].append((first, n))

    for length in range(size, 0, -1):
        while left[length]:
            at = bisect_left(keys, length)
            if at == len(keys):
                # as many of this length as fit go into new sequences
                per = size // length
                n, rest = divmod(int(left[length]), per)
                for k in range(per if n else 0):
                    place(length, n, seq, k * length)
                put(size - per * length, seq, n)
                seq += n
                for k in range(rest):
                    place(length, 1, seq, k * length)
                put(size - rest * length, seq, 1 if rest else 0)
                seq += 1 if rest else 0
                break
            free = keys[at]
            first, n = room[free].pop()
            if not room[free]:
                del room[free], keys[at]
            take = min(n, int(left[length]))
            place(length, take, first, size - free)
            put(free - length, first, take)
            put(free, first + take, n - take)
    return seq, runs


def pack(rows: DataFrame, size: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset (long) to rows whose `length` is 1 to `size`.

    `rows` should be a written table: it is read twice. The rank of a piece within its length is
    the number of such pieces in earlier buckets (a small table of counts) plus its place in its own
    bucket, so no task holds all pieces of one length. Rows with another length, or none, are an
    error of the caller and raise. An empty table gives an empty one. Other columns stay; columns
    named sequence_id and offset are replaced.
    """
    spark = rows.sparkSession
    n_rows = rows.count()
    buckets = max(1, -(-n_rows // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the row travels whole in one column, so its own names cannot clash
    keyed = rows.select(F.struct("*").alias("_row"), F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias("_bucket"), F.col(length).cast("long").alias("_len"))
    counts = keyed.groupBy("_len", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("_len").agg(F.sum("_n").alias("n")).limit(size + 2).collect():  # at most `size` lengths
        if r["_len"] is None or not 1 <= r["_len"] <= size:
            raise ValueError(f"length {r['_len']} is not in 1..{size}")
        hist[r["_len"]] = r["n"]
    runs = np.array(plan(hist), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # bounded by the patterns of `size`, not by the rows
    earlier = Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_len", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    place = Window.partitionBy("_len", "_bucket").orderBy(*[F.col("_row")[c] for c in order])
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(place) - 1)
        .join(bases, ["_len", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def seat(lens: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        r = shared.value
        scale = int(r[:, 1].max()) + 1 if len(r) else 1
        # runs of a length are consecutive and sorted by first rank
        at = np.searchsorted(r[:, 0] * scale + r[:, 1], lens.to_numpy() * scale + np.minimum(ranks.to_numpy(), scale - 1), side="right") - 1
        hit = r[at]
        return pd.DataFrame({"sequence_id": hit[:, 3] + ranks.to_numpy() - hit[:, 1], "offset": hit[:, 4]})

    return ranked.withColumn("_seat", seat("_len", "_rank")).select(
        *[F.col("_row")[c].alias(c) for c in rows.columns if c not in ("sequence_id", "offset")], F.col("_seat.sequence_id").alias("sequence_id"), F.col("_seat.offset").alias("offset"))


def pack_documents(docs: DataFrame, size: int = 2048, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text",
                   vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Null and empty texts hold the end id alone, repeated rows are packed each, a null doc_id stays
    null, other columns are not read.
    """
    return pack(materialize(pieces(docs, size, end_id, doc_id, text, vocabulary), "pieces"), size)
