"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import reads, release, stage

MAX_ROUNDS = 60


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of one partition by stars that join the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(a, b)`` long links to ``(node, component)``: the smallest node it can reach for every node that isn't that one itself.

    Each partition first contracts its own links, then star steps alternate until the links no longer change. Every
    round aggregates with partial sums and joins on one column, so a hub of any degree is split like any skewed join
    side. No table is broadcast, so the driver holds none; a round's links are staged, and deleted once the next has written
    its own. Links to null or to itself are ignored. An empty table gives an empty one. release() deletes what the result reads.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b")
    links = links.mapInArrow(_contract, "a long, b long")
    links = stage(links.distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        last, links = links, stage(_small_star(_large_star(links)), "links")
        release(last)
        state = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return reads(links.select(F.col("a").alias("node"), F.col("b").alias("component")), links)
        before = state
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
