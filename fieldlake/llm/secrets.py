"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a run of 16 or more letters, digits and + / _ - that holds a digit or changes from
lower to upper case; an access key of a known prefix inside such a run; or, of any length and
characters, the value after a secret word and = or : (what the quotes hold, else up to white space,
a quote or < >, without closing punctuation). Candidates do not overlap. The forest looks at its length, its character transitions, how much of it
common letter trigrams cover, the document's path and the words around it. It is trained from
labelled findings; where none are given, rules label those of all documents whose context leaves
no doubt, and all of them are learned.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.textkernel import mix, slices
from fieldlake.sources.store import materialize

TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5
#: Letter trigrams that count as dictionary; characters whose trigrams are counted at once.
TRIGRAMS, SLICE = 4_000, 250_000
#: Characters before and after a candidate in which neighbouring words are looked for.
AROUND = 40

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
_ODD = re.compile(r"\d|[a-z][A-Z]")
_SEPARATOR = re.compile("[=:]")
_NEAR = re.compile(r"[A-Za-z0-9_]+")
_ASSIGNED = re.compile(r"(?:=>|=|:)\s*[\"'`]?\Z")
#: Neighbouring words that name a secret, and words that name a harmless identifier.
SECRET_WORDS = {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "private_key", "auth", "bearer", "credential"}
HARMLESS_WORDS = {"commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "revision", "build", "card", "isbn"}
#: Public fixed prefixes of access keys.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "AIza")
_WORDS = tuple(sorted(SECRET_WORDS))
_NAMED = re.compile("(?:" + "|".join(w.replace("_", "[_-]") for w in _WORDS) + ")[\"'`\\]]{0,3}[ \\t]{0,8}\\Z", re.IGNORECASE)
_VALUE = re.compile(r"[=>:]?[ \t]*\n?[ \t]*(?:\"(?P<d>[^\"\n]+)\"|'(?P<s>[^'\n]+)'|`(?P<b>[^`\n]+)`|[\"'`]?(?P<v>[^\s\"'`<>]+))")
_KEY = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(KEY_PREFIXES) + ")[A-Za-z0-9]{8,}")
_GLUED = re.compile("(?:" + "|".join(KEY_PREFIXES) + ")[A-Za-z0-9]{8,}")
NAMES = ["length", "digit_share", "upper_share", "transitions", "distinct_share", "entropy", "hex", "coverage", "all_digits", "prefix",
         "assigned", "quoted", "secret_word", "harmless_word", "before_hash", "after_hash", "path_hash",
         "odd", "symbol_share", "expression"]


def candidates(text: str) -> list[tuple[int, str]]:
    """(offset, string) of each candidate of a text, in order and without overlaps."""
    values, end = [], 0
    for m in _SEPARATOR.finditer(text):
        at = m.start()
        if at >= end and _NAMED.search(text, max(0, at - AROUND), at) and (v := _VALUE.match(text, at + 1)):
            kind = v.lastgroup
            found = v[kind].rstrip(".,;:)]}") if kind == "v" else v[kind]
            if found:
                values.append((v.start(kind), found))
                end = v.start(kind) + len(found)
    out, k = [], 0
    for m in _RUN.finditer(text):
        a, z = m.span()
        while k < len(values) and values[k][0] + len(values[k][1]) <= a:
            out.append(values[k])
            k += 1
        if k < len(values) and values[k][0] < z:
            continue  # a part of a value
        run = m.group()
        # keys that follow / - _ or + stand for themselves, those inside a word make the whole word a candidate
        cuts = [0, *[x.start() for x in _KEY.finditer(run) if x.start()], len(run)]
        for b, e in zip(cuts, cuts[1:], strict=False):
            part = run[b:e]
            if _GLUED.search(part) or len(part) >= 16 and _ODD.search(part):
                out.append((a + b, part))
    return out + values[k:]


def trigram_counts(texts) -> np.ndarray:
    """Counts of the 26^3 lower-case letter trigrams inside words."""
    out = np.zeros(26**3, np.int64)
    for t in texts:
        if isinstance(t, str):
            code = np.frombuffer(t.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 97
            ok = (code >= 0) & (code < 26)
            if len(code) > 2:
                whole = ok[:-2] & ok[1:-1] & ok[2:]
                out += np.bincount((code[:-2] * 676 + code[1:-1] * 26 + code[2:])[whole], minlength=26**3)
    return out


def describe(text: str, at: int, found: str, path: str | None, known: np.ndarray) -> list[float]:
    """The features of NAMES."""
    n = len(found)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in found]
    counts = np.unique(list(found), return_counts=True)[1] / n
    code = np.frombuffer(found.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 97
    ok = (code >= 0) & (code < 26)
    whole = ok[:-2] & ok[1:-1] & ok[2:]
    tri = (np.clip(code[:-2], 0, 25) * 676 + np.clip(code[1:-1], 0, 25) * 26 + np.clip(code[2:], 0, 25))
    before, after = text[max(0, at - AROUND) : at], text[at + n : at + n + AROUND]
    left, right = _NEAR.findall(before), _NEAR.findall(after)
    last, nxt = (left[-1].lower() if left else ""), (right[0].lower() if right else "")
    assigned = _ASSIGNED.search(before)
    return [
        float(n), kind.count("d") / n, kind.count("u") / n, sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, len(counts) / n,
        float(-(counts * np.log2(counts)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in found)),
        float((whole & known[tri]).sum() / max(1, n - 2)), float(found.isdigit()), float(bool(_KEY.search(text, at, at + n)) or found.startswith(KEY_PREFIXES)),
        float(bool(assigned)), float(before[-1:] in "\"'" and before != ""),
        float(last.endswith(_WORDS) or bool(assigned and _NAMED.search(before[: assigned.start()].rstrip(":=")))), float(last in HARMLESS_WORDS),
        float(zlib.crc32(last.encode()) % 16), float(zlib.crc32(nxt.encode()) % 16), float(zlib.crc32((path or "").encode()) % 16),
        float(bool(_ODD.search(found))), kind.count("s") / n, float(any(c in "([{" for c in found)),
    ]


def rule_label(x: list[float]) -> int | None:
    """1 or 0 where the context leaves no doubt, else None."""
    f = dict(zip(NAMES, x, strict=True))
    if f["prefix"] and not f["all_digits"] and not (f["coverage"] > 0.6 and not f["odd"]):
        return 1
    if f["secret_word"] and f["assigned"]:  # a short value, a plain word or code may be harmless
        return 1 if f["odd"] and f["length"] >= 8 and not f["expression"] else None
    if f["all_digits"] or f["harmless_word"] or (f["coverage"] > 0.6 and f["digit_share"] < 0.1):
        return 0
    return None


def certain(x: np.ndarray) -> np.ndarray:
    """Whether `rule_label` calls each row of features a secret."""
    return np.array([rule_label(row) == 1 for row in x.tolist()], bool)


@dataclass
class Forest:
    """Trees as flat arrays: a node's feature (-1 at a leaf), threshold, children and P(secret).

    `ruled`: what the rules call a secret is one, whatever the trees say.
    """

    feature: list[np.ndarray]
    split: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]
    known: np.ndarray
    ruled: bool = False

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, split, left, right, value in zip(self.feature, self.split, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= split[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        total /= max(1, len(self.feature))
        return np.where(certain(x), 1.0, total) if self.ruled else total


def _flatten(model, known: np.ndarray, ruled: bool) -> Forest:
    forest = Forest([], [], [], [], [], known, ruled)
    for tree in model.trees:
        nodes = []

        def visit(node):
            k = len(nodes)
            nodes.append(None)
            stats = list(node.impurityStats().stats())
            value = stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0
            if node.subtreeDepth() == 0:
                nodes[k] = (-1, 0.0, k, k, value)
            else:
                split = node.split()
                a = visit(node.leftChild())
                b = visit(node.rightChild())
                nodes[k] = (split.featureIndex(), split.threshold(), a, b, value)
            return k

        visit(tree._call_java("rootNode"))
        for target, column, kind in zip((forest.feature, forest.split, forest.left, forest.right, forest.value), zip(*nodes, strict=True), (int, float, int, int, float), strict=True):
            target.append(np.array(column, kind))
    return forest


def fit(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source", sample: int | None = None, per_class: int | None = None) -> Forest:
    """Train the forest.

    `labelled`: (text, start, length, path, secret) findings, from any source; the forest alone then
    decides, also against the rules. Findings without text or label, or that lie outside their text
    or are empty, teach nothing. Without `labelled` the candidates of all documents are labelled by
    `rule_label`, and all that get a label are learned, repeats of a row once; then what the rules
    call a secret is one. If a class is missing there is nothing to learn: what the rules call a
    secret is one, and nothing else. The trigram table counts all documents.
    On request the table comes from a hash sample of about `sample` documents, and of each class the
    findings with the smallest hashes are learned: all up to `per_class`, else between once and about twice as many.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"), F.xxhash64(doc_id, text).alias("h")).where("text is not null")
    chosen = rows.select("text")
    if sample is not None:
        n, span = rows.count(), 1 << 40
        chosen = rows.where(F.pmod("h", F.lit(span)) < min(span, int(span * sample / max(1, n)))).select("text")

    def count(batches):
        total = np.zeros(26**3, np.int64)
        for b in batches:
            for part in slices(b["text"], SLICE):
                total += trigram_counts([" ".join(part)])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": at, "n": total[at]})

    counts = np.zeros(26**3, np.int64)
    for r in chosen.mapInPandas(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # up to 26^3 rows
        counts[r["trigram"]] = r["n"]
    known = np.zeros(26**3, bool)
    top = np.argsort(-counts, kind="stable")[:TRIGRAMS]
    known[top[counts[top] > 0]] = True

    def findings(batches):
        for b in batches:
            out = []
            for t, p, h in zip(b["text"], b["path"], b["h"].tolist(), strict=True):
                for at, found in candidates(t):
                    x = describe(t, at, found, p, known)
                    label = rule_label(x)
                    if label is not None:
                        key = mix(mix(np.array([h], np.int64).view(np.uint64)) + np.uint64(at))[0]
                        out.append((float(label), int(key >> np.uint64(1)), x))
            if out:
                yield pd.DataFrame(out, columns=["label", "k", "features"])

    def given(batches):
        for b in batches:
            yield pd.DataFrame([(float(r.secret), describe(r.text, int(r.start), r.text[int(r.start) : int(r.start + r.length)], r.path, known))
                                for r in b.itertuples() if isinstance(r.text, str) and r.start + r.length <= len(r.text)], columns=["label", "features"])

    if labelled is None:
        found = materialize(rows.mapInPandas(findings, "label double, k long, features array<double>").dropDuplicates(["label", "k"]), "secret-findings")
        train = found.select("label", "features")
        if per_class is not None:
            # the leading zeros of a hash halve the rows again and again
            zeros = F.lit(63) - F.length(F.regexp_replace(F.bin("k"), "^0+", ""))
            counts = found.groupBy("label", zeros.alias("zeros")).agg(F.count(F.lit(1)).alias("n")).collect()  # up to 64 rows a class
            take = F.lit(False)
            for label in sorted({r["label"] for r in counts}):
                sizes = {least: sum(r["n"] for r in counts if r["label"] == label and r["zeros"] >= least) for least in range(64)}
                take |= (F.col("label") == label) & (zeros >= max([k for k, n in sizes.items() if n >= per_class], default=0))
            train = materialize(found.where(take).select("label", "features"), "secret-training")
    else:
        whole = labelled.select("text", "start", "length", "path", "secret").where("secret is not null and start >= 0 and length > 0")
        train = materialize(whole.mapInPandas(given, "label double, features array<double>"), "secret-findings")
    classes = sorted(r["label"] for r in train.select("label").distinct().collect())
    if classes != [0.0, 1.0]:
        return Forest([np.array([-1])], [np.zeros(1)], [np.zeros(1, int)], [np.zeros(1, int)], [np.zeros(1)], known, ruled=True)
    learner = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return _flatten(learner.fit(train.select("label", array_to_vector("features").alias("x"))), known, labelled is None)


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, start, length, finding_sha256, score, is_secret) of every candidate of every whole text.

    `start` counts characters. Null texts have no candidates, a null path is an empty one, repeated
    rows are scanned each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES x 2^DEPTH nodes and a trigram table
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches):
        f = shared.value
        for b in batches:
            ids, at, found, x = [], [], [], []
            for i, t, p in zip(b["doc_id"].tolist(), b["text"], b["path"], strict=True):
                for start, s in candidates(t) if isinstance(t, str) else ():
                    ids.append(i)
                    at.append(start)
                    found.append(s)
                    x.append(describe(t, start, s, p, f.known))
            if ids:
                yield pd.DataFrame({"doc_id": ids, "start": at, "length": [len(s) for s in found], "found": found, "score": f.score(np.array(x))})

    return rows.mapInPandas(find, f"doc_id {kind}, start long, length long, found string, score double").select(
        "doc_id", "start", "length", F.sha2("found", 256).alias("finding_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text: str = "text", path: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mask`; all other columns and texts as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        f, out = shared.value, []
        for t, p in zip(texts, paths, strict=True):
            found = candidates(t) if isinstance(t, str) else []
            if found:
                score = f.score(np.array([describe(t, at, s, p, f.known) for at, s in found]))
                for (at, s), bad in reversed(list(zip(found, score >= threshold, strict=True))):
                    if bad:
                        t = t[:at] + mask + t[at + len(s) :]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, F.pandas_udf(clean, "string")(F.col(text).cast("string"), F.col(path).cast("string")))
