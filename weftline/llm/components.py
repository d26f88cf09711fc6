"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import delete, materialise, scratch


def _attach_least(edges: DataFrame) -> DataFrame:
    """Adds least, the smallest neighbour of a. The minima are written first, so that a hub's edges can be split in the join."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    return edges.join(least, "a")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _round(now: DataFrame) -> DataFrame:
    """A large star and a small star; their own tables are gone afterwards."""
    with scratch(now.sparkSession):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _attach_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        linked = _attach_least(materialise(large, "large"))
        small = linked.select("a", F.col("least").alias("b")).unionByName(linked.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        return materialise(small.distinct(), "small", keep=True)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges(a, b): two columns of one orderable type. Returns (node, label) for every node of an edge; label: the component's smallest node.

    Each round costs a few shuffles of the edge list; the number of rounds grows with the logarithm of the longest path.
    Minima are combined before the shuffle; no component is collected anywhere. Loops and repeated edges are dropped.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        last, now = now, _round(now)
        delete(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
