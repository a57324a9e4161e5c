"""Labelling runs over the backlog of reviews without labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Slices of an app's backlog in the running count.
SLICES = 64


def run_outcomes(backlog: DataFrame, limit: int | None = None) -> DataFrame:
    """``backlog`` (app_id, pos, valid) in order of the whole number pos, cut after the ``limit``-th success of each app.

    The running count is taken in two steps - successes of each slice of the order, then within the slices -
    so no app's backlog is counted in one task. None: no limit; a limit of 0 or less: no rows.
    """
    if limit is None:
        return backlog
    if limit <= 0:
        return backlog.limit(0)
    ok = F.col("valid").cast("int")
    cuts = backlog.groupBy("app_id").agg(F.percentile_approx("pos", [i / SLICES for i in range(1, SLICES)], 1000).alias("__cuts"))
    d = backlog.join(cuts, "app_id").withColumn("__s", F.size(F.filter("__cuts", lambda c: c < F.col("pos")))).drop("__cuts")
    before = Window.partitionBy("app_id").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("app_id", "__s").agg(F.sum(ok).alias("__n")).select("app_id", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    w = Window.partitionBy("app_id", "__s").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("__base") + F.coalesce(F.sum(ok).over(w), F.lit(0))
    return d.join(base, ["app_id", "__s"]).withColumn("__done", done).filter(F.col("__done") < limit).drop("__done", "__base", "__s")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Attempted, classified and failed reviews of each app."""
    return outcomes.groupBy("app_id").agg(F.count("*").alias("total"), F.count_if("valid").alias("classified"), F.count_if(~F.col("valid")).alias("failed"))
