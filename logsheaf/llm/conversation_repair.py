"""Cheapest repair of turn order in conversations, with an audit of every edit."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The white space of the rules and what ends a sentence.
BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")

# Costs of edits; an undeleted truncated turn adds its own.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# What a repaired conversation has so far: nothing, a system turn, an open
# user turn, or whole pairs of user and assistant. Nothing and pairs may end.
EMPTY, SYSTEM, USER, PAIRS = range(4)
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRS, (PAIRS, "u"): USER}
WRITTEN = {EMPTY: USER, SYSTEM: USER, USER: PAIRS, PAIRS: USER}
NAME = {USER: "user", PAIRS: "assistant"}
LEGAL = {"su", "ua", "au"}

BASE, MODULUS = 1_000_003, (1 << 61) - 1
SETTLE_ROWS = 512

LOG = (
    "conv_id long, position long, edit string, cost int, fault string, turn long, "
    "old_role string, role string, text string"
)
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)


class Edit:
    """The last edit of a repair; what comes before is shared with other repairs.

    ``ups[j]`` is the node 2**j edits earlier, ``hash`` a rolling hash of all
    edits since the root.
    """

    __slots__ = ("edit", "depth", "hash", "ups")

    def __init__(self, edit: str = "", before: Edit | None = None, modulus: int = MODULUS):
        self.edit = edit
        if before is None:
            self.depth, self.hash, self.ups = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * BASE + ord(edit)) % modulus
        ups, up = [before], before
        while len(up.ups) >= len(ups):
            up = up.ups[len(ups) - 1]
            ups.append(up)
        self.ups = tuple(ups)

    def above(self, depth: int) -> Edit:
        """The ancestor at ``depth``."""
        node = self
        while node.depth > depth:
            node = node.ups[(node.depth - depth).bit_length() - 1]
        return node

    def below(self, root: Edit) -> list[Edit]:
        """The nodes after ``root``, first edit first."""
        path, node = [], self
        while node is not root:
            path.append(node)
            node = node.ups[0]
        return path[::-1]


def _same(a: Edit, b: Edit) -> bool:
    """Whether two nodes of one depth and hash stand for the same edits."""
    while a is not b:
        if a.edit != b.edit:
            return False
        a, b = a.ups[0], b.ups[0]
    return True


def _parted(a: Edit, b: Edit, differ) -> tuple[Edit, Edit]:
    """The highest ancestors of two nodes of one depth that differ."""
    for j in reversed(range(len(a.ups))):
        if j < len(a.ups) and differ(a.ups[j], b.ups[j]):
            a, b = a.ups[j], b.ups[j]
    return a, b


def precedes(a: Edit, b: Edit) -> bool:
    """Whether the edits of ``a`` come before those of ``b`` in ASCII order.

    The longest common prefix is searched by hashes; that it is common is then
    verified, and after a collision the edits themselves are compared.
    """
    depth = min(a.depth, b.depth)
    x, y = a.above(depth), b.above(depth)
    if x.hash == y.hash and _same(x, y):
        return a.depth < b.depth
    if x.hash != y.hash:
        x, y = _parted(x, y, lambda u, v: u.hash != v.hash)
        if _same(x.ups[0], y.ups[0]):
            return x.edit < y.edit
    return _text(a) < _text(b)


def _text(node: Edit) -> str:
    return "".join(n.edit for n in node.below(node.above(0)))


def _common(a: Edit, b: Edit) -> Edit:
    depth = min(a.depth, b.depth)
    a, b = a.above(depth), b.above(depth)
    if a is b:
        return a
    a, _ = _parted(a, b, lambda u, v: u is not v)
    return a.ups[0]


class Repair:
    """The cheapest repairs of one conversation, fed turn by turn.

    One repair is kept per state. Turns are given out as soon as all of these
    agree on them, so memory follows the undecided rest; only a conversation
    whose repairs never meet is held as a whole.
    """

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.root, self.state = Edit(), EMPTY
        self.live = {EMPTY: (0, self.root)}
        self.turns: deque = deque()
        self.limit = SETTLE_ROWS

    def _offer(self, best: dict, state: int, cost: int, edit: str, before: Edit) -> None:
        held = best.get(state)
        if held is not None and held[0] < cost:
            return
        node = Edit(edit, before, self.modulus)
        if held is None or cost < held[0] or precedes(node, held[1]):
            best[state] = (cost, node)

    def _inserted(self) -> None:
        """Adds the repairs that insert up to two turns here."""
        for _ in range(2):
            for state, (cost, node) in list(self.live.items()):
                self._offer(self.live, WRITTEN[state], cost + INSERT, "I", node)

    def feed(self, initial: str, fault: str | None, turn: tuple) -> list[tuple]:
        """Takes the next turn; gives out (edit, role, turn) of what is decided."""
        self._inserted()
        best: dict = {}
        for state, (cost, node) in self.live.items():
            self._offer(best, state, cost + DELETE, "D", node)
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault else 0
                kept = KEPT.get((state, initial))
                if kept is not None:
                    self._offer(best, kept, cost + KEEP + extra, "K", node)
                self._offer(best, WRITTEN[state], cost + REROLE + extra, "R", node)
        if PAIRS in best:
            # Whatever these may still do, whole pairs can do as cheaply, or
            # for one deletion more in place of a system turn.
            for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
                if state in best and best[state][0] > best[PAIRS][0] + more:
                    del best[state]
        self.live = best
        self.turns.append(turn)
        if len(self.turns) < self.limit:
            return []
        decided = self._settle()
        self.limit = max(SETTLE_ROWS, 2 * len(self.turns))
        return decided

    def finish(self) -> list[tuple]:
        """The rest, by the cheapest repair that may end."""
        self._inserted()
        ends = [self.live[s] for s in (EMPTY, PAIRS) if s in self.live]
        cost, node = ends[0]
        if len(ends) == 2 and (ends[1][0] < cost or ends[1][0] == cost and precedes(ends[1][1], node)):
            node = ends[1][1]
        return self._given(node)

    def _given(self, node: Edit) -> list[tuple]:
        given = []
        for step in node.below(self.root):
            turn = None if step.edit == "I" else self.turns.popleft()
            role = None
            if step.edit == "K":
                self.state = KEPT[self.state, turn[1][:1]]
                role = turn[1]
            elif step.edit != "D":
                self.state = WRITTEN[self.state]
                role = NAME[self.state]
            given.append((step.edit, role, turn))
        return given

    def _settle(self) -> list[tuple]:
        nodes = [node for _, node in self.live.values()]
        shared = nodes[0]
        for node in nodes[1:]:
            shared = _common(shared, node)
        given = self._given(shared)
        self.root = Edit()
        new = {id(shared): self.root}
        for node in nodes:
            for old in node.below(shared):
                if id(old) not in new:
                    new[id(old)] = Edit(old.edit, new[id(old.ups[0])], self.modulus)
        self.live = {state: (cost, new[id(node)]) for state, (cost, node) in self.live.items()}
        return given


def _entry(conv, position: int, edit: str, role: str | None, turn: tuple | None) -> tuple:
    if turn is None:
        return conv, position, edit, INSERT, None, None, None, role, ""
    number, old, text, fault = turn
    cost = {"K": KEEP, "R": REROLE, "D": DELETE}[edit]
    if edit != "D" and fault:
        cost += TRUNCATED
    return conv, position, edit, cost, fault, number, old, role, None if edit == "D" else text


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*held), types)], names
        )

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or "")
        if size >= 1 << 20:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


LONG, TEXT = pa.int64(), pa.large_string()
LOG_NAMES = [f.split()[0] for f in LOG.split(", ")]
LOG_TYPES = [LONG, LONG, TEXT, pa.int32(), TEXT, LONG, TEXT, TEXT, TEXT]
SUMMARY_NAMES = [f.split()[0] for f in SUMMARY.split(", ")]
SUMMARY_TYPES = [*[LONG] * 7, TEXT, TEXT]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def entries() -> Iterator[tuple]:
        conv, repair, position = None, None, 0

        def numbered(given: list[tuple]) -> Iterator[tuple]:
            nonlocal position
            for edit, role, turn in given:
                yield _entry(conv, position, edit, role, turn)
                position += 1

        def ended() -> Iterator[tuple]:
            yield from numbered(repair.finish())
            if position == 0:
                yield (conv, *[None] * 8)

        for of, turn, role, text, fault, held in _rows(batches):
            if repair is None or of != conv:
                if repair is not None:
                    yield from ended()
                conv, repair, position = of, Repair(), 0
            if held:
                yield from numbered(repair.feed(role[:1], fault, (turn, role, text, fault)))
        if repair is not None:
            yield from ended()

    yield from _batches(entries(), LOG_TYPES, LOG_NAMES)


def repair(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    lost: str | None = None,
) -> DataFrame:
    """The edits (``LOG``) that repair each conversation, in order.

    Turns go by number, null first; equal numbers by role, then text. A turn
    is blank, a duplicate of an earlier turn, truncated (its end is no stop),
    or has no fault. A repair keeps (K), gives another role to (R) or deletes
    (D) each turn and inserts (I) empty ones, so that the initials of the roles
    read ``(s?(ua)+)?``; the cheapest is taken, and of equal ones that whose
    edits come first in ASCII order. ``turn`` and ``old_role`` are those of the
    row, ``role`` and ``text`` those after the edit, null if deleted.

    A null role or text is one space; a role without initial is never kept.
    Rows without a conversation form one of id null. A conversation that has
    only rows whose column ``lost`` is true gives one row without an edit. Rows
    that are equal are one turn and its duplicates. Very long texts pass
    through unchanged. An empty table gives no rows. Other columns are ignored,
    whatever their names.

    The turns of a conversation pass one after the other through one task,
    which keeps those that the repairs have not decided yet.
    """
    space = F.lit(" ")
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = turns.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        (~F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(True)).alias("held"),
    ).withColumn("hash", F.sha2("text", 256))
    # The window finds each conversation in one partition already.
    same = W.partitionBy("conv_id", "role", "hash", "held").orderBy(F.asc_nulls_first("turn"))
    return (
        rows.repartition("conv_id")
        .withColumn("seen", F.row_number().over(same))
        .withColumn(
            "fault",
            F.when(body == "", "blank")
            .when(F.col("seen") > 1, "duplicate")
            .when(~F.substring(body, -1, 1).isin(*STOPS), "truncated"),
        )
        .sortWithinPartitions(
            "conv_id", F.asc_nulls_first("turn"), "role", "text", "seen"
        )
        .select("conv_id", "turn", "role", "text", "fault", "held")
        .mapInArrow(_edits, LOG)
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def entries() -> Iterator[tuple]:
        fold = None
        for conv, position, edit, cost, fault, turn, old, role, text in _rows(batches):
            if fold is None or fold.conv != conv:
                if fold is not None:
                    yield fold.row()
                fold = _Fold(conv)
            if edit is not None:
                fold.add(edit, cost, fault, turn, old, role, text)
        if fold is not None:
            yield fold.row()

    yield from _batches(entries(), SUMMARY_TYPES, SUMMARY_NAMES)


class _Fold:
    """Figures of one conversation, from its edits in order."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.cost = self.illegal = self.numbers = 0
        self.first = self.last = self.before = None
        self.audit, self.digest, self.join = [], hashlib.sha256(), ""

    def add(self, edit, cost, fault, turn, old, role, text) -> None:
        self.cost += cost
        self.audit.append(edit)
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if self.before is not None and self.before + old[:1] not in LEGAL:
                self.illegal += 1
            self.before = old[:1]
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last = turn
                self.numbers += 1
        if edit != "D":
            self.digest.update(f"{self.join}{role}:{text}".encode())
            self.join = "\n"

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.numbers
        return (
            self.conv, gaps, *self.faults.values(), self.illegal, self.cost,
            "".join(self.audit), self.digest.hexdigest(),
        )


def summaries(log: DataFrame) -> DataFrame:
    """One row per conversation (``SUMMARY``), from the edits as ``repair`` returns them.

    The edits must still lie in its order; no shuffle may come between.
    """
    return log.mapInArrow(_summaries, SUMMARY)
