"""Nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables cuts space by the floors of Gaussian projections (2-stable, so a projection's
difference follows the Euclidean distance) into buckets.  All vectors are indexed.  A query visits its own
bucket and perturbed ones: moving one step along a projection costs the squared distance to the wall
crossed, and sets of moves are visited in the order of their summed costs, that is of estimated
success.  Candidates of all tables are merged and reranked by exact distance in double precision.

The cell width and the number of visited buckets are fitted on a bounded sample of vectors
(``SAMPLE`` of smallest id hashes): the fewest visits that find ``TARGET`` of the sample's true
neighbours, which lie farther apart than those of the whole table.  Where ``MOST_VISITS`` do not reach
it, the index takes fewer projections and then wider cells until they do.

A query left with fewer than ``k`` candidates (a far or isolated vector, whose visited buckets are empty) is
compared with all entries, block by block.

Equal vectors are one entry of the index, held by its ``k + 1`` smallest ids: ties go to smaller ids, so no
other row of the entry can be among the ``k`` nearest of anything.  A vector that a third of the rows
share is thus a few rows (each task passes on as many at most before the shuffle).

Queries are dealt to buckets, not to vectors: a task holds a share of at most some ``BLOCK`` vectors of a
bucket with the queries that visit it, and returns the best ``k`` of each query only.  A hot bucket is
split into as many shares as its size asks for.

Components of any finite size are measured: a difference is scaled by a power of two before it is squared.

Defined cases: an empty table, or one without a usable vector, gives an empty result.  Vectors that are null, empty, zero, of another length than most of the sample, or that hold
null or non-finite components take no part (neither as query nor as candidate).  Ties go to the smaller id.  Rows with equal ids and vectors are one candidate.
A table of fewer than ``k`` candidates gives all of them.  Null ids take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common

K = 10
TABLES = 2
SAMPLE, SAMPLE_QUERIES, TARGET = 3000, 100, 0.97
BLOCK = 2048
MOST_VISITS = 4096
SEED = 20240101


def perturbations(costs: np.ndarray, most: int) -> Iterator[tuple[float, list[int]]]:
    """Index sets of the rising ``costs`` (two a projection, lower and upper wall) in the order of their sums.

    Every set comes once, from the empty one on, by the shift and expand moves on the sorted costs.
    """
    yield 0.0, []
    if not len(costs):
        return
    heap = [(float(costs[0]), (0,))]
    for _ in range(most):
        if not heap:
            return
        total, chosen = heapq.heappop(heap)
        yield total, list(chosen)
        last = chosen[-1]
        if last + 1 < len(costs):
            heapq.heappush(heap, (total - float(costs[last]) + float(costs[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + float(costs[last + 1]), (*chosen, last + 1)))


@dataclass
class Index:
    """Projections (tables, functions, dimensions), offsets, the cells' width and the visits of a query and table."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    visits: int

    @property
    def dimensions(self) -> int:
        return self.directions.shape[2]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows, functions), in cells."""
        return np.einsum("tfd,nd->tnf", self.directions, x) / self.width + self.offsets[:, None, :]

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A 64-bit key of each row of whole-numbered cells."""
        acc = np.full(len(cells), common.u64((table + 1) * 0x9E3779B97F4A7C15), dtype=np.uint64)
        for column in cells.T:
            acc = common.mix(acc ^ column.astype(np.int64).view(np.uint64))
        return acc.view(np.int64)

    def probes(self, position: np.ndarray) -> np.ndarray:
        """The cells that one query visits in one table, best first, its own the first."""
        cell = np.floor(position)
        low = position - cell
        # Crossing one wall up or down; two walls of one projection exclude each other.
        costs = np.concatenate([low**2, (1 - low) ** 2])
        order = np.argsort(costs, kind="stable")
        out, f = [cell], len(cell)
        for _, chosen in perturbations(costs[order], 64 * self.visits):
            if not chosen:
                continue
            at = order[chosen]
            axes = at % f
            if len(set(axes.tolist())) < len(axes):
                continue
            moved = cell.copy()
            moved[axes] += np.where(at < f, -1, 1)
            out.append(moved)
            if len(out) >= self.visits:
                break
        return np.array(out)


def exact_distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; each difference is brought near 1 by a power of two first, which
    changes no digit and keeps the squares of very large or small components finite."""
    diff = vectors - queries
    exponent = np.frexp(np.abs(diff).max(axis=-1))[1]
    return np.ldexp(np.sqrt((np.ldexp(diff, -exponent[..., None]) ** 2).sum(axis=-1)), exponent)


def to_unit(x: np.ndarray) -> tuple[np.ndarray, int]:
    """``x`` by the power of two that brings its largest component near 1, and the exponent."""
    exponent = int(np.frexp(np.abs(x).max())[1]) if x.size else 0
    return np.ldexp(x, -exponent), exponent


def fit(sample: np.ndarray, total: int) -> Index:
    """An index for ``total`` vectors like those of ``sample``, coarse enough that ``MOST_VISITS`` reach ``TARGET``."""
    functions, widths = int(np.clip(round(np.log2(max(total, 2) / BLOCK)), 4, 24)), 2.0
    while True:
        index, reached = attempt(sample, functions, widths)
        if reached:
            return index
        # Fewer projections, then wider cells: in the end all vectors share a bucket.
        functions, widths = (functions - 1, widths) if functions > 1 else (1, 2.0 * widths)


def attempt(sample: np.ndarray, functions: int, widths: float) -> tuple[Index, bool]:
    """An index of cells of so many deviations, and whether it finds ``TARGET`` of the sample's neighbours."""
    rng = np.random.default_rng(SEED)
    n, d = sample.shape
    directions = rng.standard_normal((TABLES, functions, d))
    offsets = rng.random((TABLES, functions))
    unit, exponent = to_unit(sample)
    spread = float(np.std(np.einsum("tfd,nd->tnf", directions, unit))) if n > 1 else 1.0
    # Cells of two deviations: a projection falls in two or three of them.
    index = Index(directions, offsets, float(np.ldexp(max(widths * spread, 1e-12), exponent)), 1)
    queries = sample[:: max(1, n // SAMPLE_QUERIES)]
    k = min(K, n - 1)
    if k < 1:
        return index, True
    square = (unit**2).sum(axis=1)
    near = np.argsort(square[None, :] - 2 * unit[:: max(1, n // SAMPLE_QUERIES)] @ unit.T, axis=1, kind="stable")[:, : k + 1]
    index.visits = min(MOST_VISITS, 3**functions)
    cells = np.floor(index.positions(sample))
    asked = index.positions(queries)
    first = np.full((len(queries), n), index.visits, dtype=np.int64)
    for table in range(TABLES):
        keys = index.keys(cells[table], table)
        for q in range(len(queries)):
            visited = index.keys(index.probes(asked[table, q]), table)
            rank = {int(key): r for r, key in reversed(list(enumerate(visited)))}
            at = np.array([rank.get(int(key), index.visits) for key in keys[near[q]]])
            first[q, near[q]] = np.minimum(first[q, near[q]], at)
    needed = np.sort(np.concatenate([first[q, near[q]][1:] for q in range(len(queries))]))
    last = int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))])
    reached = last < index.visits
    index.visits = int(min(index.visits, last + 1))
    return index, reached


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = common.bounded_sample(rows.select("vec_id", "v"), "vec_id", SAMPLE).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], result)
    lengths = [len(r["v"]) for r in sample]
    size = max(sorted(set(lengths)), key=lengths.count)
    rows = rows.where(F.size("v") == size)
    index = fit(np.array([r["v"] for r in sample if len(r["v"]) == size]), rows.count())
    # Of fixed size: tables x functions x dimensions.
    shipped = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64())])
        for batch in batches:
            cells = np.floor(shipped.value.positions(matrix(batch.column(1))))
            for table in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(shipped.value.keys(cells[table], table)), batch.column(0)], schema=schema)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("query_id", pa.int64())])
        for batch in batches:
            asked = shipped.value.positions(matrix(batch.column(1)))
            for q, query in enumerate(batch.column(0)):
                for table in range(TABLES):
                    keys = shipped.value.keys(shipped.value.probes(asked[table, q]), table)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([query.as_py()] * len(keys), pa.int64())], schema=schema)

    by_vector = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.select("vec_id", "v").withColumn("nth", F.dense_rank().over(by_vector)).where(F.col("nth") <= k + 1).select("vec_id", "v").checkpoint()
    placed = entries.mapInArrow(place, "key long, vec_id long").checkpoint()
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("shares"))
    visits = rows.where("asks").select("vec_id", "v").mapInArrow(visit, "key long, query_id long")
    # Only buckets that hold vectors are visited; a visit goes to each share of its bucket.
    visits = visits.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "query_id")
    visits = visits.join(rows.select(F.col("vec_id").alias("query_id"), "v"), "query_id").select("key", "share", F.col("query_id").alias("id"), "v", F.lit(True).alias("asks"))
    held = placed.join(sizes, "key").join(entries, "vec_id")
    held = held.select("key", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int").alias("share"), F.col("vec_id").alias("id"), "v", F.lit(False).alias("asks"))

    def best(table: pa.Table) -> pa.Table:
        """The best k of each query among this share's vectors, as two lists a query."""
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks()
        x = matrix(flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat)
        pool, first = np.unique(ids[~asks], return_index=True)
        vectors = x[~asks][first]
        made: tuple[list, list, list] = ([], [], [])
        if len(pool):
            unit, exponent = to_unit(x)
            held = unit[~asks][first]
            square = (held**2).sum(axis=1)
            for query, (q, u) in {int(i): (x[n], unit[n]) for n, i in enumerate(ids) if asks[n]}.items():
                rough = square - 2 * (held @ u) + u @ u
                rough[pool == query] = np.inf
                count = min(k, int(np.isfinite(rough).sum()))
                if not count:
                    continue
                # Rough squares may be off by rounding: all that may be among the nearest are measured exactly.
                off = 1e-14 * x.shape[1] * (square + u @ u)
                near = np.flatnonzero((rough - off <= np.partition(rough + off, count - 1)[count - 1]) & np.isfinite(rough))
                d = exact_distances(q, vectors[near])
                order = np.lexsort((pool[near], d))[:k]
                made[0].append(query)
                made[1].append(pool[near][order].tolist())
                made[2].append(d[order].tolist())
        return pa.table({"query_id": pa.array(made[0], pa.int64()), "ids": pa.array(made[1], pa.list_(pa.int64())), "scores": pa.array(made[2], pa.list_(pa.float64()))})

    found = held.union(visits).groupBy("key", "share").applyInArrow(best, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).checkpoint()
    held_by = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(held_by, "query_id", "left")
    short = asking.where(F.coalesce("n", F.lit(0)) < k).select("query_id", "v").checkpoint()
    some = short.count()
    if some:
        # Every share of the short queries meets every block of entries.
        blocks, shares = -(-entries.count() // BLOCK), -(-some // BLOCK)
        dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("long")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        scanned = short.select(every(blocks).alias("key"), dealt("query_id", shares).alias("share"), F.col("query_id").alias("id"), "v", F.lit(True).alias("asks"))
        all_of = entries.select(dealt("vec_id", blocks).alias("key"), every(shares).alias("share"), F.col("vec_id").alias("id"), "v", F.lit(False).alias("asks"))
        more = all_of.union(scanned).groupBy("key", "share").applyInArrow(best, "query_id long, ids array<long>, scores array<double>")
        more = more.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
        pairs = pairs.union(more).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
