"""Connected components of an edge table, without ever holding a large graph in one place.

Each partition first contracts its edges by union-find to stars (a partition's forest has no more edges
than nodes it has seen).  If at most ``HELD`` edges are left, one task contracts them all.  Of more, partitions
of ``HELD`` edges are contracted once more and large-star and small-star rounds follow until no edge changes: each
joins a node's larger, or smaller, neighbours to the smallest one, so every component ends as a star
around its smallest node.  Rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "u long, v long"
#: Edges that one task holds; more are joined in rounds.  Either way gives the same components.
HELD = 500_000


def contract(batches: Iterator[pa.RecordBatch], with_roots: bool = False) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: every node but the roots (unless they are asked for), with its root (the smallest)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while (up := root.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            root[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    if with_roots:
        nodes += sorted({find(x) for x in nodes})
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """Edges (two long columns, each pair in either order) to (node, root) for every linked node.

    The root is the component's smallest node and has itself as root.  Self-links and nulls are
    ignored; an empty table gives an empty one.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = edges.mapInArrow(contract, EDGE).checkpoint()
    parts = -(-edges.count() // HELD)
    if parts <= 1:
        return edges.repartition(1).mapInArrow(lambda held: contract(held, True), "node long, root long").checkpoint()
    edges = edges.repartition(parts).mapInArrow(contract, EDGE).distinct().checkpoint()
    before = _state(edges)
    while before[0]:
        edges = _small_star(_large_star(edges)).distinct().checkpoint()
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
