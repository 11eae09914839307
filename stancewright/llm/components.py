"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.llm.scratch import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _pointed_at_least(edges: DataFrame, by: DataFrame) -> DataFrame:
    """Each edge with the smallest node that its first end is tied to."""
    least = by.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, for all nodes of edges.

    Both ends are longs. Loops, repeated and NULL-ended edges are ignored; no edges give no
    rows. Neighbour lists are never gathered: a hub only meets an aggregate and a join, and
    each round is written to shared storage. The number of rounds grows with the logarithm
    of the longest path.
    """
    now = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before, mark = None, _fingerprint(now)
    while mark != before and mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _pointed_at_least(both, both).where("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        tied = _pointed_at_least(large, large)
        small = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            tied.select("u", F.col("m").alias("v"))
        )
        now = written(small.where("u != v").distinct(), "edges")
        before, mark = mark, _fingerprint(now)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
