"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.session import discard, materialize


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each end of ``edges`` (a, b).

    After a limited number of ``rounds`` a component may still go by several names; nodes
    of one name are connected all the same.

    A hub's edges are reduced by a minimum with map-side combine and joined to one row
    per node, so no task holds the neighbours of a node.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    for _ in range(rounds or 0):
        now = _next(now)
    if rounds is not None:
        return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        now = _next(now)


def _next(now: DataFrame) -> DataFrame:
    after = _round(now)
    discard(now)
    return after


def _round(now: DataFrame) -> DataFrame:
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                          F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return materialize(small.where("u <> v").distinct(), "stars")
