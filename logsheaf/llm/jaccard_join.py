"""Exact self-join of shingle sets by Jaccard likeness, with vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.pretokens import by_size, texts_of
from logsheaf.llm.tables import small, spare
from logsheaf.operators.components import connected_components
from logsheaf.session import discard, materialize

WIDTH = 5
COMMON = 8
FRAGMENT_BITS = 3
SLACK = 4
GRAMS = 2_000_000
HEAVY = 64
BLOCK = 4096
CLASS = ("n", "shared", "probe", "outside", "heavy")

_STEPS = np.array(
    [1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], "uint64"
)
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype="uint64")
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.full(max(count, 1), _STEPS[1]), dtype="uint64")


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word."""
    data = np.frombuffer(text, "uint8")
    space = _SPACES[data]
    before = np.concatenate([[True], space[:-1]]) if len(data) else space
    starts = np.nonzero(~space & before)[0]
    if not len(starts):
        return starts, np.zeros(0, dtype="uint64")
    place = np.arange(len(data))
    place -= np.maximum.accumulate(np.where(~space & before, place, 0))
    place[space] = 0
    values = np.where(space, np.uint64(0), _BYTES[data] * _powers(place.max() + 1)[place])
    words = np.add.reduceat(values, starts)
    words ^= words >> np.uint64(32)
    return starts, words * _STEPS[1]


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    runs = len(words) - width + 1
    total = np.full(max(runs, 0), width, dtype="uint64")
    for at in range(width if runs > 0 else 0):
        part = words[at : at + runs] * _STEPS[at]
        total += part ^ (part >> np.uint64(29))
        total *= _STEPS[1]
    total ^= total >> np.uint64(32)
    return total.view("int64")


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's distinct shingles, in ascending order."""
    encoded = [text.encode().lower() for text in texts]
    places = np.cumsum([0, *(len(text) + 1 for text in encoded)])
    starts, words = _word_hashes(b"\n".join(encoded))
    ends = np.searchsorted(starts, places)
    runs, found = _runs(words, WIDTH), []
    for first, end in zip(ends, ends[1:]):
        if end - first >= WIDTH:
            found.append(np.unique(runs[first : end - WIDTH + 1]))
        else:
            found.append(_runs(words[first:end], end - first)[: end - first])
    return found


def prefix(size):
    """Of any order, so many first grams: linked sets share one of them."""
    return size + (-4 * size // 5) + 1


def _linkable(n: Column, m: Column, overlap: Column) -> Column:
    """Whether sets of sizes n and m with this overlap have 100 I >= 80 (n + m - I)."""
    return 9 * overlap >= 4 * (n + m)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype="int64")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _name(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, set, n, low) of rows (doc_id, text).

    ``set`` is a 128-bit hash of the shingle set and null where it is empty.
    ``low`` has the lowest grams, somewhat more than a prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", 1 << 20):
            grams = shingles(texts_of(batch["text"]))
            firsts = [prefix(len(own)) for own in grams]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([_name(own) for own in grams], pa.binary()),
                    pa.array([len(own) for own in grams], pa.int64()),
                    _lists([own[: p + p // SLACK + 1] for own, p in zip(grams, firsts)]),
                ],
                ["doc_id", "set", "n", "low"],
            )

    return docs.mapInArrow(run, "doc_id long, set binary, n long, low array<long>")


def fragments(docs: DataFrame) -> DataFrame:
    """Sets cut at fixed places of the gram order: (set, fragment, grams), no empty pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", 1 << 20):
            names, numbers, pieces = [], [], []
            for grams in shingles(texts_of(batch["text"])):
                name = _name(grams)
                places = grams >> np.int64(64 - FRAGMENT_BITS)
                cuts = np.nonzero(np.diff(places))[0] + 1
                for piece in np.split(grams, cuts) if len(grams) else []:
                    names.append(name)
                    numbers.append(int(piece[0]) >> (64 - FRAGMENT_BITS))
                    pieces.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(numbers, pa.int32()), _lists(pieces)],
                ["set", "fragment", "grams"],
            )

    return docs.mapInArrow(run, "set binary, fragment int, grams array<long>")


class _Sets:
    """The distinct sets of a table of documents, and their grams on demand."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.rows = materialize(shingle_sets(docs))
        self.distinct = materialize(
            self.rows.where(F.col("set").isNotNull())
            .groupBy("set")
            .agg(F.min("doc_id").alias("source"), F.first("n").alias("n"), F.first("low").alias("low"))
        )

    def pieces(self, wanted: DataFrame) -> DataFrame:
        """The fragments of the sets in ``wanted`` (set), written once."""
        chosen = materialize(self.distinct.join(wanted, "set", "left_semi").select("set", "source"))
        sources = small(chosen.select(F.col("source").alias("_source")))
        texts = self.docs.join(sources, F.col("doc_id").eqNullSafe(F.col("_source")), "left_semi")
        found = fragments(texts).join(chosen, "set", "left_semi")
        return materialize(found.dropDuplicates(["set", "fragment"]))


def plausible(pairs: DataFrame, sets: _Sets) -> DataFrame:
    """``pairs`` without those that differ too much already among the lowest grams.

    Up to the smaller of their last low grams, the low lists of both sets are
    whole. Linked sets differ in at most (n + m) / 9 grams in all.
    """

    def reach(low: str, size: str) -> Column:
        whole = F.size(low) >= F.col(size)
        return F.when(whole, F.lit((1 << 63) - 1)).otherwise(F.element_at(low, -1))

    def within(low: str) -> Column:
        return F.size(F.filter(low, lambda gram: gram <= F.col("reach")))

    lows = sets.distinct.select("set", "low")
    known = (
        pairs.join(lows.toDF("b", "low_b"), "b")
        .join(lows.toDF("a", "low_a"), "a")
        .withColumn("reach", F.least(reach("low_a", "n"), reach("low_b", "m")))
    )
    differing = within("low_a") + within("low_b") - 2 * F.size(F.array_intersect("low_a", "low_b"))
    return known.where(9 * differing <= F.col("n") + F.col("m")).select("a", "b", "n", "m")


def linked(pairs: DataFrame, sets: _Sets) -> DataFrame:
    """Those of ``pairs`` (a, b, n, m) that are linked.

    Each fragment counts its part of the overlap; the parts are summed per pair.
    """
    pairs = materialize(plausible(pairs, sets))
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
    pieces = sets.pieces(wanted.distinct())
    left = pieces.select(F.col("set").alias("a"), "fragment", F.col("grams").alias("left"))
    right = pieces.select(F.col("set").alias("b"), "fragment", F.col("grams").alias("right"))
    partial = (
        pairs.join(right, "b")
        .join(left, ["a", "fragment"])
        .select("a", "b", "n", "m", F.size(F.array_intersect("left", "right")).alias("part"))
    )
    found = materialize(
        partial.groupBy("a", "b", "n", "m")
        .agg(F.sum("part").alias("overlap"))
        .where(_linkable(F.col("n"), F.col("m"), F.col("overlap")))
        .select("a", "b")
    )
    discard(pieces)
    return found


def components(links: DataFrame) -> DataFrame:
    """(set, component): the least set that links (a, b) reach, for all sets with a link."""
    return connected_components(links).toDF("set", "component")


def _buckets(sets: _Sets) -> DataFrame:
    """Rows (bucket, set, n, shared, probe): linked sets meet in a bucket where one is a probe.

    In the order (common, hash), the first grams of most sets are all among
    the lowest hashes, so only those are counted. A gram is common if more than
    ``COMMON`` sets have it among their lowest. Sets whose lowest grams are
    mostly common are the dense ones. Others are probes in the buckets of their
    lowest grams, where dense sets appear with any gram. Dense sets meet each
    other in a second family of buckets, of the first grams in the
    order of their exact frequency. ``shared`` bounds the overlap with any set
    for which this is the first common gram: of dense sets, the number of grams
    from this one on.
    """
    lows = sets.distinct.select("set", "n", F.size("low").alias("q"), F.explode("low").alias("gram"))
    common = small(
        materialize(
            lows.groupBy("gram").agg(F.count("*").alias("f")).where(F.col("f") > COMMON).select("gram")
        )
    )
    met = lows.join(common, "gram").groupBy("set", "n", "q").agg(F.count("*").alias("met"))
    first = F.col("n") - F.ceil(4 * F.col("n") / 5) + 1
    dense = materialize(met.where(F.col("q") - F.col("met") < first).select("set", "n"))
    pieces = sets.pieces(dense.select("set"))
    grams = materialize(
        pieces.join(dense, "set").select("set", "n", F.explode("grams").alias("gram"))
    )
    sparse = (
        lows.join(small(dense.select("set")), "set", "left_anti")
        .join(common, "gram", "left_anti")
        .select("gram", "set", "n", F.lit(True).alias("probe"))
    )
    every = sparse.unionByName(grams.select("gram", "set", "n", F.lit(False).alias("probe")))
    discard(pieces)
    useful = small(
        materialize(
            every.groupBy("gram")
            .agg(F.count("*").alias("f"), F.max("probe").alias("probed"))
            .where((F.col("f") > 1) & F.col("probed"))
            .select("gram")
        ),
        GRAMS,
    )
    family_a = every.join(useful, "gram").select("gram", "set", "n", F.col("n").alias("shared"), "probe")

    counted = materialize(grams.groupBy("gram").agg(F.count("*").alias("f")).where(F.col("f") > 1))
    several = grams.join(small(counted, GRAMS), "gram")
    ordered = several.groupBy("set", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("order")
    )
    # Grams that no other dense set has come first in the order; they take places but meet nothing.
    places = F.greatest(first - (F.col("n") - F.size("order")), F.lit(0)).cast("int")
    family_b = (
        ordered.where(F.size("order") >= 4 * F.col("n") / 5)
        .select(
            "set",
            "n",
            F.size("order").alias("known"),
            F.posexplode(F.slice("order", 1, places)).alias("at", "o"),
        )
        .select(
            F.struct(F.lit(1).alias("family"), "o.f", "o.gram").alias("bucket"),
            "set",
            "n",
            (F.col("known") - F.col("at")).cast("long").alias("shared"),
            F.lit(True).alias("probe"),
        )
    )
    bucket_a = F.struct(F.lit(0).alias("family"), F.lit(0).cast("long").alias("f"), "gram")
    members = materialize(
        family_a.select(bucket_a.alias("bucket"), "set", "n", "shared", "probe").unionByName(family_b)
    )
    discard(grams)
    # Of buckets with the same members, the first of the order says most; it stays.
    alike = members.groupBy("bucket").agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("set", "probe", F.lit(1))).alias("one"),
        F.bit_xor(F.xxhash64("set", "probe", F.lit(2))).alias("two"),
        F.min(
            F.when(F.col("probe"), F.struct(F.col("n") - F.col("shared"), "set", "n", "shared"))
        ).alias("pivot"),
    )
    kept = (
        alike.where(F.col("size") > 1)
        .groupBy("bucket.family", "size", "one", "two")
        .agg(F.min(F.struct("bucket", "pivot")).alias("kept"))
        .select("kept.bucket", "kept.pivot")
    )
    found = materialize(members.join(kept, "bucket"))
    discard(members)
    return found


def _possible(n: Column, shared: Column, m: Column, other: Column) -> Column:
    return _linkable(n, m, F.least(shared, other, n, m))


def _classes(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with several components, and the classes they fall into.

    Whether two members may be linked follows from their classes: size, bound of
    the overlap, probe or not, within the main component or outside, and the
    component where it holds ``HEAVY`` members of the bucket or more.
    """
    outside = F.col("component") != F.col("main")
    several = labelled.where(outside).select("bucket").distinct()
    rows = materialize(
        labelled.join(several, "bucket", "left_semi").select(
            "bucket", "set", "n", "shared", "probe", outside.alias("outside"), "component"
        )
    )
    heavy = (
        rows.groupBy("bucket", "component")
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") >= HEAVY)
        .select("bucket", "component", F.col("component").alias("heavy"))
    )
    members = materialize(
        rows.join(heavy, ["bucket", "component"], "left").withColumn(
            "heavy", F.coalesce("heavy", F.lit(b""))
        )
    )
    discard(rows)
    return members, materialize(members.groupBy("bucket", *CLASS).agg(F.count("*").alias("rows")))


def _class_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes (x, y) of a bucket whose members may be linked; x is outside the main component.

    Linked sizes differ by a quarter of the smaller at most, so classes meet by
    bands of sizes. Of two outside classes the lesser comes first.
    """
    # The base is above 1.25, so that rounding cannot part a pair by two bands.
    band = F.floor(F.log(1.26, F.col("n")))
    x, y = F.struct(*CLASS), F.struct(*CLASS)
    first = classes.where("outside").select(
        "bucket", x.alias("x"), F.explode(F.array(band - 1, band, band + 1)).alias("band")
    )
    second = classes.select("bucket", band.alias("band"), y.alias("y"), F.col("rows").alias("y_rows"))
    light = F.lit(b"")
    return (
        first.join(second, ["bucket", "band"])
        .where(F.col("x.probe") | F.col("y.probe"))
        .where((F.col("x.heavy") == light) | (F.col("x.heavy") != F.col("y.heavy")))
        .where(~F.col("y.outside") | (F.col("x") <= F.col("y")))
        .where(_possible(F.col("x.n"), F.col("x.shared"), F.col("y.n"), F.col("y.shared")))
        .select("bucket", "x", "y", F.ceil(F.col("y_rows") / BLOCK).alias("blocks"))
    )


def _unconnected(labelled: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of different components that meet in a bucket and may be linked.

    Classes are paired before members are, so members that cannot be linked
    never meet. Large classes meet the others in blocks of about ``BLOCK`` members.
    """
    members, classes = _classes(labelled)
    pairs = materialize(_class_pairs(classes))
    own = F.struct(*CLASS)
    blocks = classes.where(F.col("rows") > BLOCK).select(
        "bucket", own.alias("y"), F.ceil(F.col("rows") / BLOCK).alias("of")
    )
    left = (
        members.where("outside")
        .select("bucket", own.alias("x"), F.col("set").alias("a"), F.col("component").alias("a_component"))
        .join(pairs, ["bucket", "x"])
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    right = (
        members.select("bucket", own.alias("y"), F.col("set").alias("b"), F.col("component").alias("b_component"))
        .join(small(materialize(blocks)), ["bucket", "y"], "left")
        .withColumn("block", F.pmod(F.xxhash64("b"), F.coalesce("of", F.lit(1))))
        .drop("of")
    )
    return (
        left.join(right, ["bucket", "y", "block"])
        .where(F.col("a_component") != F.col("b_component"))
        .where((F.col("x") != F.col("y")) | (F.col("a") < F.col("b")))
        .select("a", "b", F.col("x.n").alias("n"), F.col("y.n").alias("m"))
    )


def find_components(sets: _Sets) -> DataFrame:
    """(set, component) of all sets that are linked with another.

    In each bucket, the first probe is compared with all others. Only where that
    leaves several components are the rest compared, and then only with members of
    other components and of classes that may be linked with theirs, so a group of
    near copies costs one comparison per copy.
    """
    members = _buckets(sets)
    pivot = F.col("pivot")
    star = (
        members.where(F.col("set") != pivot["set"])
        .where(_possible(F.col("n"), F.col("shared"), pivot["n"], pivot["shared"]))
        .select(pivot["set"].alias("a"), F.col("set").alias("b"), pivot["n"].alias("n"), F.col("n").alias("m"))
        .distinct()
    )
    star = materialize(star)
    links = linked(star, sets)
    labels = components(links)
    labelled = materialize(
        members.join(labels, "set", "left")
        .withColumn("component", F.coalesce("component", "set"))
        .join(
            labels.select(F.col("set").alias("_pivot"), F.col("component").alias("main")),
            F.col("pivot.set") == F.col("_pivot"),
            "left",
        )
        .withColumn("main", F.coalesce("main", "pivot.set"))
        .select("bucket", "set", "n", "shared", "probe", "component", "main")
    )
    more = (
        _unconnected(labelled)
        .distinct()
        .join(star.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        .join(star.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = materialize(more)
    if more.isEmpty():
        return labels
    return components(links.unionByName(linked(more, sets)))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents with a Jaccard likeness of 0.8 or more: (doc_id, n_shingles, component_id).

    A text's set has its distinct runs of five words, or its only run where it
    has fewer words. Equal sets are one set from the start. Candidates share
    one of the first grams of a global order; their overlap is counted in
    fragments of the order and summed per pair, so the result is exact.

    ``component_id`` is the smallest id in the component. Texts without words,
    null included, have no shingles and are components of their own.
    Repeated rows fall together. Null ids stay, and are a component's id only
    where it has no other. An empty table gives no rows; other columns are
    ignored.
    """
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = _Sets(narrow)
    labels = find_components(sets)
    named = sets.distinct.select("set", "source").join(labels, "set", "left")
    least = (
        named.where(F.col("component").isNotNull())
        .groupBy("component")
        .agg(F.min("source").alias("component_id"))
    )
    # Most rows may be of one component; a broadcast leaves them where they are.
    names = named.join(small(materialize(least)), "component", "left").select(
        "set", F.coalesce("component_id", "source").alias("component_id")
    )
    return sets.rows.join(names, "set", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the smallest id.

    Rows that repeat an id and its text are one document. Null and empty texts
    are near nothing; very long ones are compared as a whole. An empty table
    stays empty; columns may have any names. Rows without an
    id cannot be the one that stays for others, so only such repeats of them go.
    """
    found = materialize(near_duplicates(docs, id, text))
    own = spare("found", docs)
    stays = (F.col("doc_id") == F.col("component_id")).cast("int")
    by_id = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(stays).alias("stays"), F.count("*").alias("rows")
    )
    gone = small(materialize(by_id.where(F.col("stays") == 0).select(F.col("doc_id").alias(own))))
    left = docs.join(gone, F.col(id) == F.col(own), "left_anti")
    repeated = by_id.where(F.col("rows") > 1).select(F.col("doc_id").alias(own))
    if found.where(F.col("doc_id").isNull()).limit(2).count() > 1:
        none = docs.sparkSession.range(1).select(F.lit(None).cast("long").alias(own))
        repeated = repeated.unionByName(none)
    repeated = materialize(repeated)
    if repeated.isEmpty():
        return left
    same = F.col(id).cast("long").eqNullSafe(F.col(own))
    once = left.join(small(repeated), same, "left_anti")
    return once.unionByName(left.join(small(repeated), same, "left_semi").dropDuplicates([id, text]))
