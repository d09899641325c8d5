"""Encoding by a public byte-level vocabulary, and exact length histograms.

A document's ids are those of its byte-level BPE. No merge crosses the start of a " word", so
ids of a text are the joined ids of its space-separated chunks; chunks are found by a 64-bit
hash, encoded once per worker and kept in a bounded cache. Texts where a space is followed by white space (or ends the
text), or that hold an added token, are encoded whole, because there the split is not the tokenizer's own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.textkernel import slices, span_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Chunks a worker keeps (about 150 bytes each), and the longest chunk it keeps.
CACHE, CHUNK = 800_000, 40
#: Characters that are split and encoded in one go, and new chunks in one call of the tokenizer.
SLICE, CALL = 2_000_000, 20_000

_ODD = re.compile(r" \s| \Z")


class Encoder:
    """Text to little-endian unsigned 32-bit ids."""

    _own: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        # an added token in a text is one id, so its text is not split at spaces
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD.pattern, *added]))
        words = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(words.values()) + 1, np.int64)
        self.bytes_of[list(words.values())] = [len(w) for w in words]  # a byte-level token has a character per byte
        self.cache: dict[str, bytes] = {}

    @classmethod
    def shared(cls, vocabulary: str) -> Encoder:
        if vocabulary not in cls._own:
            cls._own[vocabulary] = cls(vocabulary)
        return cls._own[vocabulary]

    @classmethod
    def forget(cls) -> None:
        """Free the chunks at the end of a task: its worker goes on to other stages."""
        for encoder in cls._own.values():
            encoder.cache = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of " chunk" for each: encoded as one text and cut where the bytes of the chunks end."""
        out: list[bytes] = []
        for k in range(0, len(chunks), CALL):
            part = chunks[k : k + CALL]
            ids = np.frombuffer(self.whole([(b" " + b" ".join(part)).decode()])[0], "<u4")
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(c) + 1 for c in part])) + 1
            raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd, plain, heads, raw = [], [], [], []
        for i, t in enumerate(texts):
            t = t.encode("utf-8", "replace").decode()  # a lone surrogate has no bytes
            if self.odd.search(t):
                odd.append((i, t))
            elif t:
                plain.append(i)
                heads.append(t.split(" ", 1)[0])
                raw.append(t.encode())
        for (i, _), ids in zip(odd, self.whole([t for _, t in odd]), strict=True):
            out[i] = ids
        if not plain:
            return out
        joined = b" ".join(raw)
        buf = np.frombuffer(joined, np.uint8)
        spaces = np.flatnonzero(buf == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(buf))
        first = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw]))  # of each text's chunks
        inner = np.ones(len(starts), bool)
        inner[first[:-1]] = False  # no space stands before a first chunk
        s, e = starts[inner], ends[inner]
        _, one, of = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        keys = [joined[a:b] for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)]
        ids = list(map(self.cache.get, keys))
        new = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(new, self._chunks([keys[k] for k in new]), strict=True):
            ids[k] = x
            if len(self.cache) < CACHE and len(keys[k]) <= CHUNK:
                self.cache[keys[k]] = x
        ids += self.whole(heads)
        table = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        entry = np.empty(len(starts), np.int64)
        entry[inner] = of
        entry[first[:-1]] = len(one) + np.arange(len(plain))
        n = size[entry]
        done = np.cumsum(n)
        flat = table[np.repeat((np.cumsum(size) - size)[entry] - (done - n), n) + np.arange(done[-1])]
        at = np.append(0, done)[first].tolist()
        for k, i in enumerate(plain):
            out[i] = flat[at[k] : at[k + 1]].tobytes()
        return out


def encoded(texts: Iterable[str | None], vocabulary: str = VOCABULARY) -> Iterator[bytes]:
    """The ids of each text in order; null is empty. Works on slices of bounded size."""
    encoder = Encoder.shared(vocabulary)
    for part in slices(texts, SLICE):
        yield from encoder.encode(part)


def lengths(docs: DataFrame, by: str | None = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(part, n_tokens) of every row; a null text has 0 tokens, a null part stays null."""
    rows = docs.select((F.col(by) if by else F.lit(None)).cast("string").alias("part"), F.col(text).cast("string").alias("text"))

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "n_tokens": [len(x) // 4 for x in encoded(b["text"], vocabulary)]})
        Encoder.forget()

    return rows.mapInPandas(count, "part string, n_tokens long")


def histogram(lens: DataFrame) -> DataFrame:
    """Documents per (scope, part, n_tokens): one scope `part` and one scope `all`.

    `lens` holds (part, n_tokens). Rows are summed before and after the shuffle, so a part with
    a third of all rows sends one row per task and length.
    """
    own = lens.groupBy("part", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    scopes = F.explode(F.array(
        F.struct(F.lit("part").alias("scope"), F.col("part").alias("part")),
        F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("part")),
    ))
    return (
        own.select(scopes.alias("k"), "n_tokens", "n")
        .groupBy("k.scope", "k.part", "n_tokens").agg(F.sum("n").alias("n_docs"))
    )


def context_table(hist: DataFrame) -> DataFrame:
    """Totals, quantiles and truncated totals with every occurring length as the context limit.

    Columns: scope, part, context_limit, n_docs (of just that length), docs_within, docs_beyond,
    quantile (share of documents within), tokens_total, tokens_truncated (total when each
    document is cut at the limit), tokens_lost. Between two occurring lengths a < L < b the
    truncated total is that of a plus (L - a) * docs_beyond(a). Works on the histogram alone:
    a scope has as many rows as different lengths. An empty table gives no rows.
    """
    scope = Window.partitionBy("scope", "part")
    beyond = scope.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over_docs = F.coalesce(F.sum("n_docs").over(beyond), F.lit(0))
    over_tokens = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(beyond), F.lit(0))
    sums = hist.select(
        "scope", "part", "n_tokens", "n_docs", over_docs.alias("docs_beyond"), over_tokens.alias("tokens_beyond"),
        F.sum("n_docs").over(scope).alias("docs_total"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(scope).alias("tokens_total"),
    )
    lost = F.col("tokens_beyond") - F.col("docs_beyond") * F.col("n_tokens")
    return sums.select(
        "scope", "part", F.col("n_tokens").alias("context_limit"), "n_docs",
        (F.col("docs_total") - F.col("docs_beyond")).alias("docs_within"), "docs_beyond",
        ((F.col("docs_total") - F.col("docs_beyond")) / F.col("docs_total")).alias("quantile"),
        "tokens_total", (F.col("tokens_total") - lost).alias("tokens_truncated"), lost.alias("tokens_lost"),
    )


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """Per scope the truncated total for any limit, from `context_table` alone."""
    known = F.struct("context_limit", "tokens_truncated", "docs_beyond", "quantile")
    best = table.groupBy("scope", "part").agg(
        F.max(F.when(F.col("context_limit") <= limit, known)).alias("k"),
        F.max("tokens_total").alias("tokens_total"), F.sum("n_docs").alias("docs_total"),
    )
    # below the shortest document every document is cut at the limit
    cut = F.when(F.col("k").isNull(), F.col("docs_total") * limit).otherwise(
        F.col("k.tokens_truncated") + (F.lit(limit) - F.col("k.context_limit")) * F.col("k.docs_beyond"))
    return best.select(
        "scope", "part", F.lit(limit).cast("long").alias("context_limit"), cut.alias("tokens_truncated"), "tokens_total",
        F.coalesce(F.col("k.quantile"), F.lit(0.0)).alias("quantile"),
    )


def token_counts(docs: DataFrame, by: str | None = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`context_table` of whole texts per value of `by` and over all rows.

    Null and empty texts count with 0 tokens, repeated rows each count, a null `by` is a part of
    its own, other columns are not read.
    """
    return context_table(histogram(lengths(docs, by, text, vocabulary)))
