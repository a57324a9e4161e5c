"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedmill.llm.common import Workspace


def _state(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``links`` (a, b) of long ids, in either order; returns (node, component), the smallest id that can be reached.

    Only ids that have a link to another id come out; links from an id to itself and repeated links change
    nothing. Every round is written to ``work``, so lost executors cost one round at most; the result reads
    the last round there. The least neighbours are aggregated before the shuffle and written, so that the
    join back to a hot id's links has a plain shuffle on both sides, which Spark's skew-join handling splits.
    """
    edges = work.settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        large = work.settle(larger.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        beside = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = least.toDF("a", "b").unionByName(beside)
        edges = work.settle(small.filter("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
