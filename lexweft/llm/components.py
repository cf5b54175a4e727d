"""Connected components of a graph too large for one machine, by contraction with union-find inside each batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of each batch: the same components, as stars, with fewer edges."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[p]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        stars = [(x, r) for x in up if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is its smallest node.

    Each round joins every node to the neighbour, or itself, that comes first in a hashed order, and contracts.
    The order is new in each round, so a chain shrinks by a constant factor and the rounds grow with the
    logarithm of the longest path. Nodes never meet on the driver; only the rounds' row counts do. Hot nodes
    appear in partial aggregates and in joins that adaptive execution can split.
    """
    e = written(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        rank = lambda c, r=len(maps): F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("n"))
        both = e.union(e.select("b", "a"))
        m = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("w"))
        step = written(m.select("v", F.least(rank("v"), "w")["n"].alias("m")), "step")
        maps.append(step)
        to = lambda c, s=small(step): s.select(F.col("v").alias(c), F.col("m").alias(f"m{c}"))
        e = e.join(to("a"), "a").join(to("b"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).filter("a <> b").distinct()
        e = written(e.mapInArrow(_forest, "a long, b long"), "edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = maps[-1].select(F.col("v").alias("node"), F.col("m").alias("r"))
    for step in reversed(maps[:-1]):
        known = small(label.select(F.col("node").alias("m"), "r"))
        label = step.join(known, "m", "left").select(F.col("v").alias("node"), F.coalesce("r", "m").alias("r"))
    label = written(label, "labels")
    low = label.groupBy("r").agg(F.min("node").alias("component"))
    return label.join(low, "r").select("node", "component")
