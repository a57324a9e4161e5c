"""Landed API pages: one JSON object per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedmill.functions.text import news_type
from feedmill.operators.news import dedup_by_title
from feedmill.schemas import NEWS_PAGE, REVIEW_PAGE


def read_review_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW_PAGE).json(path)


def read_news_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NEWS_PAGE).json(path)


def raw_reviews(pages: DataFrame, max_reviews: int | None = None) -> DataFrame:
    """(app_id, page, pos, review) of all pages that succeeded, at most ``max_reviews`` an app in page order.

    Pages after the first one of an app that failed or is empty are not read, as paging ends there.
    """
    ok = F.coalesce(F.col("success") != 0, F.lit(False)) & (F.coalesce(F.size("reviews"), F.lit(0)) > 0)
    # a narrow row for each app whose paging ended; pages are not dealt by app, of which there may be few
    ends = pages.filter(~ok).groupBy("app_id").agg(F.min("page").alias("__end"))
    good = pages.filter(ok & F.col("app_id").isNotNull()).join(F.broadcast(ends), "app_id", "left").filter(F.col("__end").isNull() | (F.col("page") < F.col("__end")))
    rows = good.select("app_id", "page", F.posexplode("reviews").alias("pos", "review"))
    if max_reviews is None:
        return rows
    # only page sizes are needed to number the reviews: one narrow row for each page
    before = Window.partitionBy("app_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sizes = good.select("app_id", "page", F.size("reviews").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return rows.join(sizes, ["app_id", "page"]).filter(F.col("__before") + F.col("pos") < max_reviews).drop("__before")


def news_items(pages: DataFrame, feeds: list[str] | None = None) -> DataFrame:
    """One row per item of the feeds asked for, with its place ``pos`` in the page."""
    items = pages.select("app_id", F.posexplode("appnews.newsitems").alias("pos", "i")).select("app_id", "pos", "i.*").drop("appid")
    return items.filter(F.col("feedname").isin(feeds)) if feeds else items


def kept_news(items: DataFrame) -> DataFrame:
    """Items deduplicated by title, with ``news_type``, without events."""
    return dedup_by_title(items).withColumn("news_type", news_type(F.col("title"), F.col("contents"))).filter("news_type <> 'event'")


