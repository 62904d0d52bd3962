"""Tries of conversation prefixes, as balanced parentheses per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf.llm.tables import small
from logsheaf.session import discard, materialize

KEY_BYTES = 16
SHARD_NODES = 1 << 17
BLOCK = 64
ID_RANGE = 4096

ENDS = "sequence string, first_id long, n_convs long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ----- One shard -----


class Parentheses:
    """A trie in preorder as balanced parentheses, with minimum excess per block."""

    def __init__(self, depths: np.ndarray):
        n = len(depths)
        self.opens = 2 * np.arange(n) - depths
        bits = np.zeros(2 * n, bool)
        bits[self.opens] = True
        self.bits = bits
        excess = np.cumsum(np.where(bits, 1, -1))
        spare = -len(excess) % BLOCK
        # Past the end the excess is low, so that every search stops.
        self.excess = np.concatenate([excess, np.full(spare + BLOCK, -1)])
        least = self.excess.reshape(-1, BLOCK).min(axis=1)
        self.levels = [least]
        while len(least) > 1:
            least = np.minimum.reduceat(least, np.arange(0, len(least), 2))
            self.levels.append(least)

    def _within(self, at: np.ndarray, goal: np.ndarray, found: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Looks from ``at`` to the end of its block; gives what is still open."""
        while len(which):
            hit = self.excess[at] <= goal
            found[which[hit]] = at[hit]
            at, goal, which = at[~hit] + 1, goal[~hit], which[~hit]
            over = at % BLOCK == 0
            if over.all():
                break
            if over.any():
                rest = self._within(at[~over], goal[~over], found, which[~over])
                return np.concatenate([which[over], rest])
        return which

    def findclose(self) -> np.ndarray:
        """The closing place of every node, in preorder.

        It is the first later place whose excess is one below that of the
        opening; blocks that stay above it are passed over by the tree of
        their minima.
        """
        goal = self.excess[self.opens] - 1
        found = np.full(len(goal), -1)
        which = self._within(self.opens + 1, goal, found, np.arange(len(goal)))
        which = which[found[which] < 0]
        block, want = self.opens[which] // BLOCK, goal[which]
        # Up while nothing to the right within the parent is low enough.
        level = np.zeros(len(which), int)
        place = block + 1
        active = np.arange(len(which))
        while len(active):
            stay = []
            for rank in np.unique(level[active]):
                of = active[level[active] == rank]
                low = self.levels[rank][place[of]] <= want[of]
                up = of[~low]
                # The next subtree to the right, as high as it begins there.
                place[up] += 1
                while len(up):
                    even = (place[up] % 2 == 0) & (level[up] + 1 < len(self.levels))
                    stay.append(up[~even])
                    up = up[even]
                    place[up] //= 2
                    level[up] += 1
            active = np.concatenate(stay) if stay else active[:0]
        for rank in range(len(self.levels) - 1, 0, -1):
            of = np.flatnonzero(level == rank)
            left = 2 * place[of]
            place[of] = np.where(self.levels[rank - 1][left] <= want[of], left, left + 1)
            level[of] = rank - 1
        self._within(place * BLOCK, want, found, which)
        return found

    def leaves_before(self) -> np.ndarray:
        """How many pairs ``()`` open before each place."""
        leaf = self.bits[:-1] & ~self.bits[1:]
        return np.concatenate([[0], np.cumsum(leaf), [leaf.sum()]])


class Shard:
    """The trie of a run of sorted sequences."""

    def __init__(self):
        self.path: list[int] = []  # nodes of the last sequence, the root first
        self.keys: list[bytes] = []
        self.depths: list[int] = []
        self.parents: list[int] = []
        self.names: list[bytes] = []
        self.chars: list[int] = []
        self.ends: dict[int, tuple] = {}
        self.first: list[int] = []

    def _node(self, parent: int, depth: int, name: bytes, chars: int) -> int:
        self.parents.append(parent)
        self.depths.append(depth)
        self.names.append(name)
        self.chars.append(chars)
        return len(self.depths) - 1

    def add(self, keys: list[bytes], chars: list[int], ends: tuple) -> None:
        if not self.path:
            self.path = [self._node(-1, 0, b"", 0)]
        shared = 0
        for mine, last in zip(keys, self.keys):
            if mine != last:
                break
            shared += 1
        del self.path[shared + 1 :]
        for depth in range(shared, len(keys)):
            top = self.path[-1]
            name = hashlib.sha256(self.names[top] + keys[depth]).digest()
            self.path.append(self._node(top, depth + 1, name, chars[depth]))
        self.keys = keys
        self.ends[self.path[-1]] = ends
        if not self.first:
            self.first = list(self.path)

    def nodes(self) -> dict[str, np.ndarray | list]:
        """Figures of every node, over what lies inside this shard.

        The nodes of the first and of the last sequence may go on in other
        shards; they form the spine. Sums leave out what spine nodes
        themselves add.
        """
        n = len(self.depths)
        depths, parents = np.array(self.depths), np.array(self.parents)
        own, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        for node, (first_id, count, _) in self.ends.items():
            own[node], least[node] = count, first_id
        spine = np.zeros(n, bool)
        spine[self.first] = spine[self.path] = True

        trie = Parentheses(depths)
        close = trie.findclose()
        start, end = np.arange(n), np.arange(n) + (close - trie.opens + 1) // 2
        up_to = np.concatenate([[0], np.cumsum(own)])
        members = up_to[end] - up_to[start]
        for node in range(n - 1, 0, -1):
            if least[node] < least[parents[node]]:
                least[parents[node]] = least[node]
        pairs = trie.leaves_before()
        alone = (close == trie.opens + 1) & spine
        alone_to = np.concatenate([[0], np.cumsum(alone)])
        leaves = pairs[close] - pairs[trie.opens] - (alone_to[end] - alone_to[start])
        saving = np.where(spine, 0, (members - 1) * np.array(self.chars, np.int64))
        saved_to = np.concatenate([[0], np.cumsum(saving)])
        children = np.bincount(parents[1:][~spine[1:]], minlength=n)
        side = np.zeros(n, np.int32)
        side[self.first] += 1
        side[self.path] += 2  # 1: first sequence only, 2: last only, 3: both
        beneath = spine[np.maximum(parents, 0)] & ~spine
        parent_ids = [
            None if is_spine or is_beneath else int(least[parent])
            for is_spine, is_beneath, parent in zip(spine, beneath, parents)
        ]
        hashes = [
            self.ends[node][2] if node in self.ends else NO_ENDS for node in range(n)
        ]
        above = [None if p < 0 else self.names[p].hex() for p in self.parents]
        return {
            "node": [name.hex() if s else None for name, s in zip(self.names, spine)],
            "above": [a if s or b else None for a, s, b in zip(above, spine, beneath)],
            "side": side,
            "conv_id": least,
            "depth": depths,
            "parent_conv_id": parent_ids,
            "n_convs": members,
            "n_children": children,
            "n_leaves": leaves,
            "saved_tokens": saved_to[end] - saved_to[start],
            "ends_sha256": hashes,
            "chars": self.chars,
        }


NODE = (
    "shard string, node string, above string, side int, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, chars long"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
NODE_TYPES = {name: _ARROW[kind] for name, kind in (f.split() for f in NODE.split(", "))}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted sequences of a task into shards and gives their nodes."""
    part, number, shard = TaskContext.get().partitionId(), 0, Shard()

    def given() -> Iterator[pa.RecordBatch]:
        columns = shard.nodes()
        n = len(columns["depth"])
        columns["shard"] = [f"{part:06}-{number:06}"] * n
        table = pa.table({name: pa.array(columns[name], kind) for name, kind in NODE_TYPES.items()})
        yield from table.to_batches(max_chunksize=8192)

    for batch in batches:
        rows = (batch[name].to_pylist() for name in ("path", "chars", "first_id", "n_convs", "ends_sha256"))
        for path, chars, first_id, count, digest in zip(*rows):
            keys = [path[at : at + KEY_BYTES] for at in range(0, len(path), KEY_BYTES)]
            shard.add(keys, chars, (first_id, count, digest))
            if len(shard.depths) >= SHARD_NODES:
                yield from given()
                number, shard = number + 1, Shard()
    if shard.depths:
        yield from given()


# ----- Sequences -----


def rebuilt(
    turns: DataFrame, heads: int, conversation: str, turn: str, role: str, text: str
) -> DataFrame:
    """One row per conversation: (conv_id, path, chars), its head taken from its hundred's first."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    # Sixteen bytes of a hash of both fields, the role's length ahead of it.
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    key = F.substring(digest, 1, 2 * KEY_BYTES)
    own = (
        turns.where(F.col(conversation).isNotNull())
        .select(
            F.col(conversation).cast("long").alias("conv_id"),
            F.struct(
                F.col(turn).alias("turn"),
                role.alias("role"),
                key.alias("key"),
                F.length(text).cast("long").alias("chars"),
            ).alias("turn"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("own"))
        .withColumn(
            "own", F.transform("own", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars")))
        )
    )
    # Of a hundred only its first conversation is looked up, by its first turns.
    first = own.where(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("first"), F.slice("own", 1, heads - 1).alias("head")
    )
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    whole = F.concat(
        F.slice(F.coalesce("head", F.array().cast("array<struct<key:string,chars:bigint>>")), F.lit(1), F.col("taken")),
        F.slice("own", F.col("taken") + 1, F.greatest(F.size("own"), F.lit(1))),
    )
    return (
        own.withColumn("first", F.col("conv_id") - F.col("conv_id") % 100)
        .join(first, "first", "left")
        .withColumn("taken", taken.cast("int"))
        .withColumn("turns", whole)
        .select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
            F.transform("turns", lambda t: t["chars"]).alias("chars"),
        )
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of all ids of each sequence, from runs of ids in order."""

    def runs() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        names = [f.split()[0] for f in ENDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    for sequence, own in groupby(runs(), key=lambda run: run[0]):
        digest, first, total = hashlib.sha256(), None, 0
        for _, ids, count, least in own:
            digest.update(ids.encode() if first is None else b"," + ids.encode())
            first = least if first is None else first
            total += count
        held.append((sequence, first, total, digest.hexdigest()))
        if len(held) >= 4096:
            yield packed()
            held = []
    if held:
        yield packed()


def sequences(convs: DataFrame) -> DataFrame:
    """Each distinct sequence once: (path, chars, first_id, n_convs, ends_sha256).

    Ids are joined in ranges of at most ``ID_RANGE`` first, so a sequence that
    very many conversations share reaches its last task as a few long rows.
    """
    keyed = convs.withColumn("sequence", F.sha2("path", 256))
    bound = F.floor(F.col("conv_id") / ID_RANGE)
    ends = (
        keyed.select("sequence", "conv_id", bound.alias("range"))
        .groupBy("sequence", "range")
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select(
            "sequence",
            "range",
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
            F.size("ids").cast("long").alias("n"),
            F.element_at("ids", 1).alias("least"),
        )
        .repartition("sequence")
        .sortWithinPartitions("sequence", "range")
        .select("sequence", "ids", "n", "least")
        .mapInArrow(_digests, ENDS)
    )
    # Equal sequences have equal paths and lengths; one row of each remains per task.
    paths = keyed.groupBy("sequence").agg(F.first("path").alias("path"), F.first("chars").alias("chars"))
    return paths.join(ends, "sequence").drop("sequence")


# ----- Whole trie -----

RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
    "saved_tokens", "ends_sha256",
)


def _spine(parts: DataFrame) -> DataFrame:
    """Merges the spine nodes of all shards, with sums over their whole subtrees."""
    whole = parts.groupBy("node").agg(
        F.min("shard").alias("owner"),
        F.first("above").alias("above"),
        F.first("depth").alias("depth"),
        F.first("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"),
        # A node ends conversations in one shard at most.
        F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    below = whole.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("node")).count()
    whole = materialize(
        whole.join(below, "node", "left").withColumn(
            "n_children", F.col("inner_children") + F.coalesce("count", F.lit(0))
        )
    )
    # What a spine node itself adds counts once, in the first shard that has it.
    adds = whole.select(
        "node",
        F.col("owner").alias("shard"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
    )
    side = W.partitionBy("shard", "side").orderBy(F.desc("depth"))
    shard = W.partitionBy("shard")

    def beneath(column: str) -> Column:
        """Sum from this node down its chain; shared nodes lie above both chains."""
        value = F.coalesce(F.col(column), F.lit(0))
        apart = F.sum(F.when(F.col("side") != 3, value).otherwise(0)).over(shard)
        return F.sum(value).over(side) + F.when(F.col("side") == 3, apart).otherwise(0)

    sums = (
        parts.join(adds, ["node", "shard"], "left")
        .select(
            "node",
            (F.col("saved_tokens") + beneath("saves")).alias("saved_tokens"),
            (F.col("n_leaves") + beneath("leaf")).alias("n_leaves"),
        )
        .groupBy("node")
        .agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    )
    return materialize(
        whole.drop("inner_children", "count", "owner", "chars")
        .join(sums, "node")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    )


def prefix_trie(
    turns: DataFrame,
    heads: int = 6,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``RESULT``).

    A conversation's turns go by number, null first; equal numbers by role and
    a hash of the text, so repeated rows are repeated turns. Its first h turns,
    h = crc32(id) % ``heads``, are those of the first conversation of its
    hundred. Each distinct sequence of first turns is a node; ``conv_id`` is
    the smallest of the conversations that start with it. A leaf counts
    itself. Null roles and texts are empty. Rows without a conversation take no
    part. An empty table gives no rows, not even the root. Other columns are
    ignored, whatever their names.

    A task holds 16 bytes and a length of each turn of one conversation, and
    one shard of about ``SHARD_NODES`` nodes; texts are only hashed.
    """
    convs = rebuilt(turns, heads, conversation, turn, role, text)
    convs = materialize(convs)
    nodes = materialize(
        sequences(convs)
        .repartitionByRange("path")
        .sortWithinPartitions("path")
        .select("path", "chars", "first_id", "n_convs", "ends_sha256")
        .mapInArrow(_shards, NODE)
    )
    discard(convs)
    spine = _spine(nodes.where(F.col("node").isNotNull()))
    names = small(spine.select(F.col("node").alias("above"), F.col("conv_id").alias("above_id")))
    inner = nodes.where(F.col("node").isNull())
    parent = F.coalesce("parent_conv_id", "above_id")
    both = inner.join(names, "above", "left").withColumn("parent_conv_id", parent)
    return both.select(*RESULT).unionByName(
        spine.join(names, "above", "left").withColumn("parent_conv_id", F.col("above_id")).select(*RESULT)
    )
