"""News items: duplicate titles, type and feed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedmill import params
from feedmill.functions.text import trim_white


def dedup_by_title(items: DataFrame) -> DataFrame:
    """The newest item of each trimmed, lower-case title of an app; a missing date is 0, the earlier place wins a tie.

    The window carries keys only; the contents join back by (app_id, gid, pos).
    """
    keys = ["app_id", "gid", "pos"]
    w = Window.partitionBy("app_id", "__title").orderBy(F.coalesce("date", F.lit(0)).desc(), "pos")
    narrow = items.select(*keys, "date", F.lower(trim_white(F.coalesce("title", F.lit("")))).alias("__title"))
    first = narrow.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(*keys)
    return items.join(first, keys, "left_semi")


def news_type_counts(items: DataFrame) -> DataFrame:
    """Items per type of each app, events included."""
    counts = [F.count_if(F.col("news_type") == t).alias(t) for t in params.NEWS_TYPES]
    return items.groupBy("app_id").agg(*counts)


def feed_distribution(items: DataFrame) -> DataFrame:
    """(kind, value, n): items by feedname and by feedlabel; missing ones as <missing>."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit("<missing>")).alias("value")) for k in ("feedname", "feedlabel")])
    return items.select(F.explode(pairs).alias("p")).select("p.*").groupBy("kind", "value").agg(F.count("*").alias("n"))
