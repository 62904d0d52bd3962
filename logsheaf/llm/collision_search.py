"""Nearest neighbours by counting collisions in sorted projections."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf.llm.tables import small
from logsheaf.session import materialize

PROJECTIONS = 128
SEED = 20_011
# A vector at the radius itself falls short of the threshold by this many
# standard deviations' chance.
DEVIATIONS = 2.0
# Radii of a query, as shares of the last one.
RADII = (0.25, 0.5, 0.75, 0.9, 1.0)
# Rounding of projections and of distances between unit vectors.
SLACK = 1e-6

BLOCK_ROWS = 8192
BLOCK_VALUES = 1 << 20
QUERIES_PER_CHUNK = 1024
CHUNKS_PER_GROUP = 64
SAMPLE_VALUES = 1 << 19

PACKED = "dim int, ids array<long>, rows array<long>, vectors binary"
FOUND = "query_row long, query_id long, vec_id long, row long, score double"
FOUND_TYPES = {
    "query_row": pa.int64(),
    "query_id": pa.int64(),
    "vec_id": pa.int64(),
    "row": pa.int64(),
    "score": pa.float64(),
}


def threshold(projections: int) -> int:
    """Collisions that a vector at the radius has with high probability.

    A projection of the difference of two unit vectors at distance s is normal
    with deviation s, so one at the radius r falls within r in 68 percent.
    """
    p = 2 * NormalDist().cdf(1) - 1
    return int(np.floor(projections * p - DEVIATIONS * np.sqrt(projections * p * (1 - p))))


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id).cast("long").alias("id"), values.alias("vector"))
        .where(F.coalesce(fine & F.exists("vector", lambda x: x != 0), F.lit(False)))
    )


def _matrix(buffer: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(buffer, np.float64).reshape(-1, dim)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which leaves its cosines as they are."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponents[:, None])


def _packer(numbered: bool, limit: int):
    """Packs the rows of a task into tables of vectors of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        row = TaskContext.get().partitionId() << 33

        def packed(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            vectors = np.array([r[2] for r in rows])
            columns = [
                pa.array([dim], pa.int32()),
                pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                pa.array([(vectors if numbered else _scaled(vectors)).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "rows", "vectors"])

        for batch in batches:
            ids = batch["id"].to_pylist()
            lists = batch["vector"]
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            starts = np.concatenate([[0], ends[:-1]])
            given = batch["row"].to_pylist() if numbered else range(row, row + len(ids))
            row += len(ids)
            for one, number, start, end in zip(ids, given, starts, ends):
                dim = int(end - start)
                held[dim].append((one, number, values[start:end]))
                if len(held[dim]) >= min(limit, max(1, BLOCK_VALUES // dim)):
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return pack


def _unpacked(every: int):
    """The queries of packed tables, one row each."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, rows, buffer in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = _matrix(buffer, dim)
                chosen = [i for i, one in enumerate(ids) if one is not None and one % every == 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in chosen], pa.int64()),
                        pa.array([rows[i] for i in chosen], pa.int64()),
                        pa.array([vectors[i].tolist() for i in chosen], pa.list_(pa.float64())),
                    ],
                    ["id", "row", "vector"],
                )

    return unpack


class SortedProjections:
    """One block of vectors, each projection an array in its own order."""

    def __init__(self, dim: int, ids: list, rows: list, buffer: bytes, projections: int):
        self.vectors = _matrix(buffer, dim)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        # Candidates without an id come last among equals.
        self.ids, self.rows = ids, np.array(rows)
        self.rank = np.argsort(np.argsort([np.inf if i is None else i for i in ids], kind="stable"))
        self.lines = lines_of(dim, projections)
        projected = (self.vectors / self.norms[:, None]) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def windows(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the window of every (query, projection)."""
        low, high = np.empty(centres.shape, int), np.empty(centres.shape, int)
        for line, values in enumerate(self.sorted):
            low[:, line] = np.searchsorted(values, centres[:, line] - radii, "left")
            high[:, line] = np.searchsorted(values, centres[:, line] + radii, "right")
        return low, high

    def search(
        self, queries: np.ndarray, own: np.ndarray, radii: np.ndarray, k: int
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query: the nearest verified vectors of this block within its last radius, and scores.

        Windows around the query grow from radius to radius (virtual
        rehashing); only the new ends of a window are counted. A vector that
        reaches the threshold is verified once. A query is done when ``k``
        verified vectors lie within the present radius.
        """
        least, n = threshold(len(self.order)), len(self.norms)
        norms = np.sqrt((queries * queries).sum(axis=1))
        centres = (queries / norms[:, None]) @ self.lines
        bounds = [self.windows(centres, share * radii + SLACK) for share in RADII]
        for q, (query, norm) in enumerate(zip(queries, norms)):
            counts = np.zeros(n, np.int64)
            seen = np.zeros(n, bool)
            seen[self.rows == own[q]] = True  # never its own neighbour
            near, scores = [np.empty(0, int)], [np.empty(0)]
            before = None
            for share, (low, high) in zip(RADII, bounds):
                ends = [(low[q], high[q])] if before is None else [(low[q], before[0]), (before[1], high[q])]
                parts = [
                    order[start:end]
                    for starts, stops in ends
                    for order, start, end in zip(self.order, starts, stops)
                    if start < end
                ]
                before = low[q], high[q]
                if parts:
                    counts += np.bincount(np.concatenate(parts), minlength=n)
                fresh = np.flatnonzero((counts >= least) & ~seen)
                seen[fresh] = True
                score = (self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)
                near.append(fresh)
                scores.append(score)
                radius = share * radii[q] + SLACK
                within = sum(int((_distances(s) <= radius).sum()) for s in scores)
                if within >= k:
                    break
            near, score = np.concatenate(near), np.concatenate(scores)
            kept = np.flatnonzero(_distances(score) <= radii[q] + SLACK)
            best = kept[np.lexsort((self.rank[near[kept]], -score[kept]))[:k]]
            yield q, near[best], score[best]


def lines_of(dim: int, projections: int) -> np.ndarray:
    """The lines that vectors of ``dim`` values are projected to, the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, projections))


def _distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def last_radii(queries: np.ndarray, own: np.ndarray, sample: tuple | None, k: int) -> np.ndarray:
    """A distance for each query that its k-th nearest does not exceed.

    It is that of the k-th nearest in the sample; without so many there, it is
    2, which holds every unit vector.
    """
    if sample is None or len(sample[0]) <= k:
        return np.full(len(queries), 2.0)
    rows, vectors = sample
    distances = _distances(_units(queries) @ _units(vectors).T)
    distances[own[:, None] == rows[None, :]] = np.inf
    return np.minimum(np.partition(distances, k - 1, axis=1)[:, k - 1], 2.0)


def _searcher(samples: dict, k: int, projections: int):
    """Holds one block and searches it for each chunk of queries that follows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["chunk"]:
                    block = SortedProjections(
                        row["dim"], row["ids"], row["rows"], row["vectors"], projections
                    )
                    continue
                queries, own = _matrix(row["vectors"], row["dim"]), np.array(row["rows"])
                radii = last_radii(queries, own, samples.get(row["dim"]), k)
                found = [[] for _ in FOUND_TYPES]
                for q, near, scores in block.search(queries, own, radii, k):
                    for column, values in zip(
                        found,
                        (
                            [row["rows"][q]] * len(near),
                            [row["ids"][q]] * len(near),
                            [block.ids[i] for i in near],
                            block.rows[near].tolist(),
                            scores.tolist(),
                        ),
                    ):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(found, FOUND_TYPES.values())], list(FOUND_TYPES)
                )

    return search


def _numbered(table: DataFrame, name: str) -> DataFrame:
    """The packed tables of each dimension, numbered from 0 by their first rows alone."""
    first = F.col("rows")[0]
    number = F.row_number().over(W.partitionBy("dim").orderBy("first")) - 1
    numbers = table.select("dim", first.alias("first")).withColumn(name, number)
    numbers = small(materialize(numbers.drop("dim")))
    return table.withColumn("first", first).join(numbers, "first").drop("first")


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id: str = "vec_id",
    vector: str = "embedding",
    projections: int = PROJECTIONS,
) -> DataFrame:
    """The ``k`` nearest by cosine of each query: (query_id, rank, vec_id, score).

    Queries are the rows whose id ``every`` divides, candidates all rows but
    the query's own; repeated ids are queries and candidates each by
    themselves. A query's last radius comes from a sample of
    ``SAMPLE_VALUES`` values; all rows are indexed, in blocks. Nearest first,
    ties by smaller id, null ids last. A vector is only compared with those of
    as many values. Vectors that are null, empty, zero or hold a null or
    non-finite value take no part. An empty table, or one with a single
    vector, gives no rows. Other columns are ignored, whatever their names.

    Each true neighbour is found with about 98 percent probability or more. A
    query left with fewer than ``k`` is searched again without a bound.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector)
    total, dim = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = min(BLOCK_ROWS, max(1, BLOCK_VALUES // dim))
    blocks = materialize(rows.repartition(-(-total // size)).mapInArrow(_packer(False, size), PACKED))
    queries = materialize(
        blocks.mapInArrow(_unpacked(every), "id long, row long, vector array<double>")
    )
    samples = _samples(blocks, total, max(1, SAMPLE_VALUES // dim))
    blocks = materialize(_numbered(blocks, "block"))
    found = _round(blocks, queries, samples, k, projections)
    # Where chance left a query short, its windows grow over everything.
    full = found.groupBy("query_row").count().where(F.col("count") >= k)
    short = queries.join(full.select(F.col("query_row").alias("row")), "row", "left_anti")
    again = _round(blocks, materialize(short), {}, k, projections)
    kept = found.join(again.select("query_row").distinct(), "query_row", "left_anti")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        kept.unionByName(again)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _round(
    blocks: DataFrame, queries: DataFrame, samples: dict, k: int, projections: int
) -> DataFrame:
    """The nearest of each query in every block (``FOUND``), within its last radius."""
    n_queries = queries.count()
    if not n_queries:
        return blocks.sparkSession.createDataFrame([], FOUND)
    packed = queries.repartition(-(-n_queries // QUERIES_PER_CHUNK)).mapInArrow(
        _packer(True, QUERIES_PER_CHUNK), PACKED
    )
    chunks = materialize(_numbered(materialize(packed), "chunk"))
    counts = blocks.groupBy("dim").agg(F.count("*").alias("n_blocks"))
    groups = chunks.groupBy("dim").agg(
        (F.floor(F.max("chunk") / CHUNKS_PER_GROUP) + 1).alias("n_groups")
    )

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))

    # A block meets every group of chunks; a task holds one block and one chunk at a time.
    held = blocks.join(F.broadcast(groups), "dim").select(
        "dim", "block", each(F.col("n_groups")).alias("group"),
        F.lit(None).cast("int").alias("chunk"), "ids", "rows", "vectors",
    )
    asked = chunks.join(F.broadcast(counts), "dim").select(
        "dim", each(F.col("n_blocks")).alias("block"),
        F.floor(F.col("chunk") / CHUNKS_PER_GROUP).alias("group"),
        (F.col("chunk") + 1).alias("chunk"), "ids", "rows", "vectors",
    )
    keys = ("dim", "block", "group")
    tasks = blocks.count() * (1 + n_queries // (QUERIES_PER_CHUNK * CHUNKS_PER_GROUP))
    return materialize(
        held.unionByName(asked)
        .repartition(tasks, *keys)
        .sortWithinPartitions(*keys, F.asc_nulls_first("chunk"))
        .mapInArrow(_searcher(samples, k, projections), FOUND)
    )


def _samples(blocks: DataFrame, total: int, size: int) -> dict:
    """About ``size`` of all vectors, per dimension, from every block in proportion."""
    share = min(1.0, size / total)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, rows, buffer in zip(*(c.to_pylist() for c in batch.columns)):
                # Rows were dealt to blocks at random, so an even stride is a sample.
                chosen = np.unique(np.floor(np.arange(0, len(rows), 1 / share)).astype(int))
                chosen = chosen[chosen < len(rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim], pa.int32()),
                        pa.array([[rows[i] for i in chosen]], pa.list_(pa.int64())),
                        pa.array([_matrix(buffer, dim)[chosen].tobytes()], pa.binary()),
                    ],
                    ["dim", "rows", "vectors"],
                )

    parts = defaultdict(list)
    thinned = blocks.select("dim", "ids", "rows", "vectors").mapInArrow(thin, "dim int, rows array<long>, vectors binary")
    for row in thinned.collect():
        parts[row["dim"]].append((np.array(row["rows"]), _matrix(bytes(row["vectors"]), row["dim"])))
    return {
        dim: (np.concatenate([r for r, _ in found]), np.concatenate([v for _, v in found]))
        for dim, found in parts.items()
    }
