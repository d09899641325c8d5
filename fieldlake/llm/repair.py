"""Cheapest audits that repair the turn structure of conversations.

A conversation's rows come in order through a stream that Spark has partitioned and sorted; of them
only digests are held, never texts. The state is a dynamic program over what the repaired
conversation ends in. Each of its (at most four) audits is a linked node that shares its prefix with
the others, so an edit costs one node however long the audit is; prefixes that no state needs any
more are freed.

Equal costs are decided by the audits' letters. Nodes have a rolling hash of their audit and lifting
pointers (every node one, at skew-binary distances), so the longest common prefix of two audits is
found in a logarithmic number of steps. Before it counts, the prefixes are walked back letter by
letter until they meet in a shared node, so colliding hashes cannot decide; equal prefixes share
their last node, so that walk is long only after a collision.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- fixed values: costs of the edits and of a truncated row that stays
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

_BASE, _MODULUS = 1_000_003, (1 << 61) - 1
_BLANK = " \t\n\v\f\r"
#: What the repaired conversation ends in.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: (role initial, state before, state after) of a row that stays.
_STEPS = [("s", NOTHING, SYSTEM), ("u", NOTHING, USER), ("u", SYSTEM, USER), ("u", ASSISTANT, USER), ("a", USER, ASSISTANT)]
_LEGAL = {"su", "ua", "au"}
_NAME = {USER: "user", ASSISTANT: "assistant"}


class Node:
    """An audit: its last letter, length, hash, the audit before that letter and one further back."""

    __slots__ = ("before", "far", "hash", "length", "letter")

    def __init__(self, before: Node | None, letter: str):
        self.letter = letter
        if before is None:
            self.before = self.far = self
            self.length = self.hash = 0
            return
        self.before = before
        self.length = before.length + 1
        self.hash = (before.hash * _BASE + ord(letter)) % _MODULUS
        far = before.far
        # two equal leaps in a row make one of both
        self.far = far.far if before.length - far.length == far.length - far.far.length and before.length else before

    def first(self, length: int) -> Node:
        """The audit's first `length` letters."""
        node = self
        while node.length > length:
            node = node.far if node.far.length >= length else node.before
        return node

    def letters(self) -> str:
        out, node = [], self
        while node.length:
            out.append(node.letter)
            node = node.before
        return "".join(reversed(out))


def first_difference(x: Node, y: Node) -> tuple[Node, Node] | None:
    """The shortest differing prefixes of two equally long audits, letter by letter; None if they are equal."""
    found = None
    while x is not y:
        if x.letter != y.letter:
            found = x, y
        x, y = x.before, y.before
    return found


def earlier(a: Node, b: Node) -> bool:
    """Whether audit a comes before b in ASCII order; of an audit and its prefix the prefix comes first."""
    n = min(a.length, b.length)
    x, y = a.first(n), b.first(n)
    if x.hash == y.hash:
        found = first_difference(x, y)
        if found is None:
            return a.length < b.length
    else:
        while x.before.hash != y.before.hash:
            x, y = (x.far, y.far) if x.far.hash != y.far.hash else (x.before, y.before)
        found = first_difference(x.before, y.before) or (x, y)
    return found[0].letter < found[1].letter


class Best:
    """The cheapest audit of a state, and the SHA-256 of the text it gives so far."""

    __slots__ = ("cost", "node", "text")

    def __init__(self, cost: int, node: Node, text):
        self.cost, self.node, self.text = cost, node, text


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.best: list[Best | None] = [Best(0, Node(None, ""), sha256()), None, None, None]
        self.seen: set[bytes] = set()
        self.last_initial: str | None = None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self._insert()

    def _insert(self) -> None:
        """Rows with empty text, where they make a state cheaper."""
        changed = True
        while changed:
            changed = False
            for initial, p, q in _STEPS[1:]:
                a = self.best[p]
                if a is not None:
                    changed |= self._offer(self.best, q, a, "I", INSERT, p, f"{_NAME[q]}:")

    @staticmethod
    def _offer(best: list[Best | None], state: int, a: Best, letter: str, cost: int, before: int, row: str | None) -> bool:
        old, cost = best[state], a.cost + cost
        if old is not None and cost > old.cost:
            return False
        node = Node(a.node, letter)
        if old is not None and cost == old.cost and not earlier(node, old.node):
            return False
        text = a.text
        if row is not None:
            text = text.copy()
            text.update((row if before == NOTHING else f"\n{row}").encode("utf-8", "replace"))
        best[state] = Best(cost, node, text)
        return True

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.last_initial = initial
        said = text.rstrip(_BLANK)
        digest = blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "replace"), digest_size=16).digest()
        must_go, extra = False, 0
        if not said:
            self.blank += 1
            must_go = True
        elif digest in self.seen:
            self.duplicate += 1
            must_go = True
        elif said[-1] not in ".!?":
            self.truncated += 1
            extra = TRUNCATED
        self.seen.add(digest)
        new: list[Best | None] = [None] * 4
        for state, a in enumerate(self.best):
            if a is not None:
                self._offer(new, state, a, "D", DELETE, state, None)
        if not must_go:
            for step, p, q in _STEPS:
                a = self.best[p]
                if a is None:
                    continue
                if step == initial:
                    self._offer(new, q, a, "K", extra, p, f"{role}:{text}")
                elif q != SYSTEM:
                    self._offer(new, q, a, "R", RELABEL + extra, p, f"{_NAME[q]}:{text}")
        self.best = new
        self._insert()

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        a, b = self.best[NOTHING], self.best[ASSISTANT]
        if a.cost > b.cost or (a.cost == b.cost and earlier(b.node, a.node)):
            a = b
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, a.cost, a.node.letters(), a.text.hexdigest()


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage; a dropped row comes with `gone` set.

    What happens to a row depends on the checksum of its conversation and turn alone. Nulls read as
    one space, but for the ids themselves, which stay null.
    """
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    read = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"), fate.alias("fate"))
    return read.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 0, F.array(F.lit(True))).when(F.col("fate") == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("gone"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation.

    rows: (conv_id, turn, role, text, gone), where `gone` marks rows that only say that the
    conversation exists. Rows are taken by turn, nulls first; rows of one turn by role, then text.
    A null conv_id is a conversation of its own; a role without a letter or with another initial
    than s, u and a cannot stay as it is. An empty table gives no rows; a conversation without
    rows has zeros, an empty audit and the hash of nothing. Other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    keyed = rows.select(
        "conv_id", F.col("conv_id").cast("string").alias("name"), F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "gone")
    sorted_rows = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "numbered", "turn", "role", "text")

    def run(batches):
        now: Repair | None = None
        at = None, None
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            got = pd.DataFrame(out, columns=["conv_id", *COUNTS, "audit", "repaired_sha256"])
            out.clear()
            return got

        for b in batches:
            ids = b["conv_id"].astype("Int64" if kind in ("bigint", "int", "smallint", "tinyint") else object)
            for conv, name, numbered, turn, role, text, gone in zip(ids, b["name"], b["numbered"], b["turn"], b["role"], b["text"], b["gone"], strict=True):
                if now is None or name != at[1]:
                    if now is not None:
                        out.append((at[0], *now.result()))
                    now, at = Repair(), (None if name is None else conv, name)
                if not gone:
                    now.add(turn if numbered else None, role, text)
            yield frame()
        if now is not None:
            out.append((at[0], *now.result()))
        yield frame()

    fields = ", ".join(f"{c} long" for c in COUNTS)
    return sorted_rows.mapInPandas(run, f"conv_id {kind}, {fields}, audit string, repaired_sha256 string")


def repaired_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`repair` of what `damaged` leaves of every conversation."""
    return repair(damaged(rows, conv_id, turn, role, text))
