"""Document quality from overlapping weak labellers and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing. Expectation-maximisation over the counts of vote
patterns (at most 3 to the power of the labellers, whatever the number of documents) estimates
how accurate each labeller is on good and on bad documents, and gives every pattern a posterior.
The posteriors of all documents train a logistic scorer on hashed character n-grams, which then
reads every whole text. Its n-gram counts are written once; each step of the descent sums the
gradient over all of them where they lie, and only the sums of tasks come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.textkernel import mix, slices, words
from fieldlake.session import arrow_rows
from fieldlake.sources.store import materialize

#: Hashed features; passes over all vectors that train the scorer; steps whose curvature it remembers.
BUCKETS, STEPS, MEMORY = 4_096, 40, 10
#: Documents with a lower score are rejected; where more than SPARED of all surely good documents
#: would be, the threshold is lowered to spare them.
THRESHOLD, SPARED, SURELY = 0.7, 0.002, 0.8
#: Characters that are worked on at once; texts whose vectors are held at once; least length a vector is divided by, so that a text of a few
#: characters stays near the good share instead of standing on one n-gram.
SLICE, HELD, LEAST_NORM = 250_000, 500, 12.0
#: Characters whose n-grams are counted at once, so that they stay in a core's cache.
COUNTED = 50_000
#: Texts, and written blocks (of about SLICE characters), that are sent to Python at once.
SENT, SENT_BLOCKS = 500, 32

#: Labellers: name, feature, bad from, good up to (a reversed pair: bad up to, good from). Between
#: the two they abstain.
LABELLERS = [
    ("shouting", "upper_share", 0.5, 0.2),
    ("symbols", "symbol_share", 0.04, 0.01),
    ("exclaiming", "exclaim_per_word", 0.2, 0.03),
    ("table_bars", "bars_per_word", 0.1, 0.01),
    ("word_variety", "distinct_share", 0.12, 0.3),
    ("line_copies", "line_copy_share", 0.5, 0.1),
    ("digits", "digit_share", 0.3, 0.1),
    ("sentences", "stops_per_word", 0.002, 0.03),
    ("small_words", "short_share", 0.05, 0.15),
]
#: Shares mean little in shorter texts: there every labeller abstains.
LEAST_WORDS = 20
_ORDINARY = " \n\t\r.,;:'\"-()?!/"


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(length of each text, code points of all texts)."""
    return np.array([len(t) for t in texts], np.int64), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def features(texts: list[str]) -> pd.DataFrame:
    """The labellers' features of whole texts; a text without words has only zeros and NaN."""
    size, code = characters(texts)
    at = np.minimum(code, np.uint32(255)) + np.repeat(np.arange(len(texts)) * 256, size)
    seen = np.bincount(at, minlength=len(texts) * 256).reshape(-1, 256)
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
    upper = np.zeros(256, bool)
    upper[[*range(65, 91), *range(192, 215), *range(216, 223)]] = True
    digit = np.zeros(256, bool)
    digit[48:58] = True
    ordinary = letter | digit
    ordinary[[ord(c) for c in _ORDINARY]] = True

    def per_text(mask: np.ndarray) -> np.ndarray:
        return seen[:, mask].sum(1).astype(float)

    hashes, word_bytes, offsets = words(texts)
    n_words = np.diff(offsets).astype(float)
    sums = np.append(0, np.cumsum(word_bytes < 4))[offsets]
    distinct = np.zeros(len(texts))
    for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
        own = np.sort(hashes[a:b])
        distinct[k] = np.count_nonzero(own[1:] != own[:-1]) + (b > a)
    # a long text repeats words anyway: compare with what a text of its length usually has
    with np.errstate(divide="ignore", invalid="ignore"):
        variety = distinct / n_words * np.maximum(1, n_words / 200) ** 0.35
        letters = per_text(letter)
        short = np.diff(sums) / n_words
        lines = [[x for x in t.split("\n") if x] for t in texts]
        copies = np.array([1 - len(set(x)) / len(x) if len(x) > 3 else 0.0 for x in lines])
        return pd.DataFrame({
            "n_words": n_words,
            "upper_share": per_text(upper) / letters,
            "symbol_share": per_text(~ordinary) / size,
            "exclaim_per_word": seen[:, 33] / n_words,
            "bars_per_word": seen[:, 124] / n_words,
            "distinct_share": variety,
            "line_copy_share": copies,
            "digit_share": per_text(digit) / size,
            "stops_per_word": seen[:, 46] / n_words,
            "short_share": short,
        })


def votes(texts: list[str]) -> np.ndarray:
    """One number per text: its votes (0 none, 1 bad, 2 good) as digits to the base 3."""
    f = features(texts)
    out = np.zeros(len(texts), np.int64)
    for _, name, bad, good in reversed(LABELLERS):
        x = f[name].to_numpy()
        is_bad, is_good = (x >= bad, x <= good) if bad > good else (x <= bad, x >= good)
        out = out * 3 + np.where(f["n_words"] >= LEAST_WORDS, is_bad * 1 + is_good * 2, 0)
    return out


def digits(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**j % 3 for j in range(len(LABELLERS))], 1)


@dataclass
class LabelModel:
    """P(good), and each labeller's chances of voting bad or good on documents of a class when it
    votes (columns 1 and 2); not voting says nothing (column 0 is 1)."""

    good: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) of each vote pattern."""
        v, j = digits(pattern), np.arange(len(LABELLERS))
        z = np.log(self.good / (1 - self.good)) + (np.log(self.on_good[j, v]) - np.log(self.on_bad[j, v])).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: A labeller's bad votes on good documents are at most this share of them: rules are written to be precise.
MOST_FALSE = 0.002


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, steps: int = 200) -> LabelModel:
    """The label model from the counts of vote patterns.

    Starts with every document doubtful that has a bad vote. `MOST_FALSE` fixes which class is the
    good one; kinds of bad documents may each set off other labellers.
    """
    v, n = digits(pattern), count.astype(float)
    p = np.where((v == 1).any(1), 0.1, 0.98)
    for _ in range(steps):
        g, b = n * p, n * (1 - p)
        on_good, on_bad = (np.array([[1.0, *(w[v[:, j] == k].sum() + 1 for k in (1, 2))] for j in range(v.shape[1])]) for w in (g, b))
        on_bad[:, 1:] /= on_bad[:, 1:].sum(1, keepdims=True)
        on_good[:, 1] = np.clip(on_good[:, 1] / on_good[:, 1:].sum(1), 1e-4, MOST_FALSE)
        on_good[:, 2] = 1 - on_good[:, 1]
        model = LabelModel(float(np.clip((g.sum() + 8) / (n.sum() + 10), 0.01, 0.99)), on_bad, on_good)
        after = model.posterior(pattern)
        if np.abs(after - p).max() < 1e-6:
            break
        p = after
    return model


def no_votes() -> LabelModel:
    """What an empty table gives: nothing is known of the labellers."""
    even = np.tile([1.0, 0.5, 0.5], (len(LABELLERS), 1))
    return LabelModel(0.8, even, even)


def blocks(texts) -> Iterator[list[str]]:
    """Lists of texts (null as empty), bounded in characters and in number."""
    for part in slices(texts, SLICE):
        for k in range(0, len(part), HELD):
            yield part[k : k + HELD]


def _hashed(code: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The feature of the n characters from each of the given places."""
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        value = value * np.uint64(1_114_112) + code[at + k]
    return (mix(value + np.uint64(n << 61)) % np.uint64(BUCKETS)).astype(np.uint16)


@cache
def _ascii_features(n: int) -> np.ndarray:
    """The features of all runs of n ASCII characters, by their codes as digits to the base 128."""
    out = np.empty(128**n, np.uint16)
    for first in range(0, len(out), 1 << 14):  # little is held at once
        run = np.arange(first, min(first + (1 << 14), len(out)))
        code = np.stack([run >> 7 * (n - 1 - k) & 127 for k in range(n)], 1).ravel().astype(np.uint64)
        out[run] = _hashed(code, n, np.arange(len(run)) * n)
    return out


def _counted(texts: list[str]) -> np.ndarray:
    """`grams` of texts whose counts are held as long numbers."""
    size, code = characters(texts)
    ends, total = np.cumsum(size)[size > 0], len(texts) * BUCKETS
    first = np.repeat(np.arange(len(texts)) * BUCKETS, size)
    odd, low = code > 127, (code & np.uint32(127)).astype(np.int64)
    any_odd, run, slots, used = odd.any(), low, np.empty(3 * len(code), np.int64), 0
    for n in range(1, min(3, len(code)) + 1):
        if n > 1:
            run = run[:-1] << 7 | low[n - 1 :]
            odd = odd[:-1] | odd[-len(run) :]
        feature = _ascii_features(n).take(run, mode="clip")
        if any_odd:
            at = np.flatnonzero(odd)
            feature[at] = _hashed(code, n, at)
        slot = slots[used : (used := used + len(run))]
        np.add(first[: len(run)], feature, out=slot)
        for k in range(1, n):  # what runs into the next text is counted behind the last one
            slot[(over := ends - k)[(over >= 0) & (over < len(run))]] = total
    return np.bincount(slots[:used], minlength=total + 1)[:total].reshape(-1, BUCKETS)


def grams(texts: list[str]) -> np.ndarray:
    """Hashed counts of raw character 1-, 2- and 3-grams (case and symbols kept)."""
    out, k = np.zeros((len(texts), BUCKETS), np.float32), 0
    for part in slices(texts, COUNTED):
        out[k : (k := k + len(part))] = _counted(part)
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """Normalised (see LEAST_NORM) logarithms of the hashed counts of texts."""
    return normalised(_logarithms(grams(texts)))


def _logarithms(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts, which are overwritten."""
    flat = counts.ravel()
    at = np.flatnonzero(flat != 0)
    flat[at] = np.log1p(flat[at])
    return counts


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), LEAST_NORM)


#: Counts are written as bytes: five bits for the step from the count before that is not zero, three for the count.
#: No count: only a step. Seven: a byte in `more` has the count, or 255, and `many` has it.
_STEP, _COUNT = 31, 7
_LOG = np.log1p(np.arange(256, dtype=np.float32))
_LOG_OF_BYTE = _LOG[np.arange(256) & _COUNT]
_WRITTEN = ["pattern", "length", "bytes", "more", "many"]


def packed(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(bytes, more, many) of the counts of a block."""
    flat = counts.ravel()
    at = np.flatnonzero(flat != 0)
    step, n = np.diff(at, prepend=-1), flat[at]
    only = (step - 1) // _STEP
    ends = np.cumsum(only + 1)
    out = np.full(ends[-1] if len(ends) else 0, _STEP << 3, np.uint8)
    out[ends - 1] = (step - only * _STEP) << 3 | np.minimum(n, _COUNT).astype(np.int64)
    return out.tobytes(), np.minimum(n[n >= _COUNT], 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.float32).tobytes()


def unpacked(size: int, steps, more, many, room: list[np.ndarray] | None = None) -> np.ndarray:
    """Logarithms of the counts of a block of `size` texts; `room` is used again by the next block."""
    steps, more = np.frombuffer(steps, np.uint8), np.frombuffer(more, np.uint8)
    value = _LOG_OF_BYTE.take(steps, mode="clip")
    if len(more):
        logs = _LOG[more]
        if len(many):
            logs[more == 255] = np.log1p(np.frombuffer(many, np.float32))
        value[np.flatnonzero(steps & _COUNT == _COUNT)] = logs
    at = (steps >> 3).astype(np.int64)
    np.cumsum(at, out=at)
    at -= 1
    if room is None:
        flat = np.zeros(size * BUCKETS, np.float32)
    else:
        if room[0].size < size * BUCKETS:
            room[:] = np.zeros(size * BUCKETS, np.float32), np.zeros(0, np.int64)
        room[0][room[1]] = 0
        room[1], flat = at, room[0][: size * BUCKETS]
    flat[at] = value
    return flat.reshape(size, BUCKETS)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _blocks_of(batches, posterior: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(logarithms of counts, 1 / what a vector is divided by, lengths of vectors, posteriors) of written blocks.

    An empty text has no length. The arrays hold until the next block is asked for. `posterior`: sorted patterns and theirs.
    """
    room = [np.zeros(0, np.float32), np.zeros(0, np.int64)]
    for b in batches:
        for values in zip(*(b.column(name) for name in _WRITTEN), strict=True):
            pattern, length, *block = (v.as_buffer() for v in values)
            pattern, length = np.frombuffer(pattern, np.int64), np.frombuffer(length, np.float32)
            x = unpacked(len(pattern), *block, room)
            part = 1 / np.maximum(length, LEAST_NORM)
            yield x, part, length * part, posterior[1][np.searchsorted(posterior[0], pattern)]


def _summed(written: DataFrame, posterior: tuple[np.ndarray, np.ndarray], width: int, function) -> np.ndarray:
    """The sum of `width` numbers, function(a block of `_blocks_of`), over all blocks: a row for each task."""

    def add(batches):
        total = np.zeros(width)
        for block in _blocks_of(batches, posterior):
            total += function(*block)
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    with arrow_rows(written.sparkSession, SENT_BLOCKS):
        rows = written.mapInArrow(add, "total binary").collect()  # a few for each core
    return sum((np.frombuffer(r["total"]) for r in rows), np.zeros(width))


def minimum(function, size: int, steps: int = STEPS) -> np.ndarray:
    """Where function (value, gradient) is least, by limited-memory BFGS from zero: `steps` calls at most."""
    beta, (f, g), past = np.zeros(size), function(np.zeros(size)), []
    calls = 1
    while calls < steps and np.linalg.norm(g) > 1e-7:
        d, held = -g, []
        for s, y in reversed(past):
            held.append(s @ d / (s @ y))
            d = d - held[-1] * y
        if past:
            d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]))
        for (s, y), a in zip(past, reversed(held), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        t = 1.0 if past else min(1.0, 1 / np.linalg.norm(g))
        while calls < steps:
            f_new, g_new = function(beta + t * d)
            calls += 1
            if f_new <= f + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = t * d, g_new - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-MEMORY:]
        beta, f, g = beta + s, f_new, g_new
    return beta


def train(written: DataFrame, posterior: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights of a logistic fit to the posteriors of all texts, both classes weighing the same: one per feature,
    one for the vector's length, and the log-odds of a good document that hold where there is no evidence."""

    def sizes(x, part, length, p):
        some = length > 0
        return np.concatenate([part**2 @ x**2, [some.sum(), p[some].sum()]])

    sums = _summed(written, posterior, BUCKETS + 2, sizes)
    n, good = sums[-2:]
    if not n:
        return np.zeros(BUCKETS + 2)
    scale = np.append(1 / (np.sqrt(sums[:-2] / n) + 1e-3), 1.0)  # rare n-grams count as much as common ones
    on_good, on_bad = 1 / 2 / max(good, 1e-9), 1 / 2 / max(n - good, 1e-9)

    def loss(beta):
        weights = (beta * scale).astype(np.float32)

        def slope(x, part, length, p):
            z = (x @ weights[:-1] * part + length * weights[-1]).astype(float)
            w = (p * on_good + (1 - p) * on_bad) * (length > 0)
            off = (w * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - p)).astype(np.float32)
            return np.concatenate([(off * part) @ x, [off @ length, (w * (np.logaddexp(0, z) - p * z)).sum()]])

        total = _summed(written, posterior, BUCKETS + 2, slope)
        return total[-1] + 5e-7 * beta @ beta, total[:-1] * scale + 1e-6 * beta

    return np.append(minimum(loss, BUCKETS + 1) * scale, np.log((good + 1) / (n - good + 1)))


def spared(written: DataFrame, posterior: tuple[np.ndarray, np.ndarray], weights: np.ndarray, threshold: float) -> float:
    """`threshold`, or the lower one that rejects no more than SPARED of the surely good texts.

    That is a score of a text, found exactly: of scores below the threshold the leading 16 bits are counted, then the next 16 of those that share them.
    """

    def scores_of(x, _, length, p):
        return rated(normalised(x[(p > SURELY) & (length > 0)]), weights)

    def below(*block):
        score = scores_of(*block)
        return np.array([len(score), (score < threshold).sum()])

    sure, low = _summed(written, posterior, 2, below)
    rank = int(SPARED * max(0, sure - 1))
    if low <= rank:
        return threshold

    def bits(batches):
        for block in _blocks_of(batches, posterior):
            score = scores_of(*block)
            yield pa.RecordBatch.from_pydict({"bits": score[score < threshold].view(np.int64)})

    with arrow_rows(written.sparkSession, SENT_BLOCKS):
        scores = materialize(written.mapInArrow(bits, "bits long"), "quality-low-scores")
    found = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("bits", shift)
        of_prefix = scores if shift == 48 else scores.where(F.shiftright("bits", shift + 16) == found)
        for found, n in sorted(of_prefix.groupBy(digit.alias("d")).count().collect()):  # up to 2^16 rows
            if rank < n:
                break
            rank -= n
    return float(np.array([found], np.int64).view(np.float64)[0])


def rated(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """P(good) of vectors."""
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-2] + np.linalg.norm(x, axis=1) * weights[-2] + weights[-1], -50, 50)))


def fit(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[LabelModel, np.ndarray, float]:
    """The label model, the scorer's weights and its threshold, each from all rows.

    Vote patterns and n-gram counts of whole texts are written once, in blocks, and read again by each step.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"))

    def pack(batches):
        for b in batches:
            for part in blocks(b.column("text").to_pylist()):
                counts = grams(part)
                block = packed(counts)
                columns = [votes(part).tobytes(), lengths(_logarithms(counts)).tobytes(), *block]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], _WRITTEN)

    def patterns(batches):
        for b in batches:
            for block in b.column("pattern"):
                pattern, n = np.unique(np.frombuffer(block.as_buffer(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"pattern": pattern, "n": n})

    with arrow_rows(docs.sparkSession, SENT):
        written = materialize(rows.mapInArrow(pack, ", ".join(f"{x} binary" for x in _WRITTEN)), "quality-vectors")
    # a task's sums take a row, so there are a few tasks for each core, however large the input
    written = written.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    counted = written.select("pattern").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3^labellers
    if not counted:
        return no_votes(), np.zeros(BUCKETS + 2), threshold
    pattern = np.array([r["pattern"] for r in counted], np.int64)
    model = expectation_maximisation(pattern, np.array([r["n"] for r in counted], np.int64))
    posterior = pattern, model.posterior(pattern)
    weights = train(written, posterior)
    return model, weights, spared(written, posterior, weights, threshold)


def score(docs: DataFrame, fitted: tuple[LabelModel, np.ndarray, float], keep_columns: tuple[str, ...] | None = None,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, keep) of every row, from whole texts.

    Null and blank texts score 0 and are not kept. Repeated rows each get a row.
    With `keep_columns` those columns come instead of doc_id, and only of rows that are kept.
    """
    weights, threshold = docs.sparkSession.sparkContext.broadcast(fitted[1]), fitted[2]
    names = list(keep_columns) if keep_columns else ["doc_id"]
    base = docs if keep_columns else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        out = []
        w = weights.value
        for part in blocks(texts):
            out += [float(x) if t.strip() else 0.0 for x, t in zip(rated(vectors(part), w), part, strict=True)]
        return pd.Series(out, dtype=float)

    scored = base.withColumn("_score", rate(F.col("text" if not keep_columns else text).cast("string")))
    if keep_columns:
        return scored.where(F.col("_score") >= threshold).select(*names)
    return scored.select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("keep"))
