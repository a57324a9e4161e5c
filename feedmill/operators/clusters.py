"""Complaint clusters: metrics of each category and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedmill import params
from feedmill.functions.text import half_even
from feedmill.operators.stats import keywords_by

KEYS = ["app_id", "category"]


def cluster_metrics(reviews: DataFrame, as_of: Column, window_days: int = params.WINDOW_DAYS, least: int = params.MIN_CLUSTER) -> DataFrame:
    """Counts, trend and shares of each (app_id, category) with at least ``least`` reviews.

    ``reviews`` has app_id, category, timestamp, voted_up, playtime_hours. Recent: not older than the window
    before ``as_of``, later ones included; prior: the window before that. A null timestamp counts in the total only.
    """
    cut = as_of - F.make_dt_interval(days=F.lit(window_days))
    before = as_of - F.make_dt_interval(days=F.lit(2 * window_days))
    ts = F.col("timestamp")
    d = reviews.filter("category is not null").groupBy(*KEYS).agg(
        F.count("*").alias("total_reviews"), F.count_if(ts >= cut).alias("recent_reviews"), F.count_if((ts >= before) & (ts < cut)).alias("prior_reviews"),
        F.count_if(~F.col("voted_up")).alias("__bad"), half_even(F.avg("playtime_hours")).alias("avg_playtime_hours"),
    ).filter(F.col("total_reviews") >= least)
    ratio = F.when(F.col("prior_reviews") == 0, F.col("recent_reviews").cast("double")).otherwise(half_even(F.col("recent_reviews") / F.col("prior_reviews")))
    return d.select(*KEYS, "total_reviews", "recent_reviews", "prior_reviews", ratio.alias("velocity_ratio"), half_even(F.col("__bad") / F.col("total_reviews") * 100).alias("negative_pct"), "avg_playtime_hours")


def cluster_samples(reviews: DataFrame, n: int = params.SAMPLES, chars: int = params.SAMPLE_CHARS) -> DataFrame:
    """The best-voted texts of each cluster, cut; only ids are ranked, the texts join afterwards."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("weighted_vote_score").desc_nulls_last(), "review_id")
    best = reviews.select(*KEYS, "review_id", "weighted_vote_score").withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).select(*KEYS, "review_id", "__k")
    text = best.join(reviews.select(*KEYS, "review_id", F.substring("review_text", 1, chars).alias("__t")), [*KEYS, "review_id"])
    return text.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__t"))), lambda x: x["__t"]).alias("sample_reviews"))


def build_clusters(reviews: DataFrame, as_of: Column, window_days: int = params.WINDOW_DAYS, least: int = params.MIN_CLUSTER) -> DataFrame:
    """``cluster_metrics`` with the cluster's keywords and sample texts."""
    words = keywords_by(reviews, KEYS).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("top_keywords"))
    d = cluster_metrics(reviews, as_of, window_days, least).join(words, KEYS, "left").join(cluster_samples(reviews), KEYS, "left")
    return d.withColumn("top_keywords", F.coalesce("top_keywords", F.array().cast("array<string>")))


def rank_clusters(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``priority_score`` (0 to 100) and ``priority_rank`` within the app; equal scores by category."""
    share = lambda c: F.when(F.max(c).over(Window.partitionBy("app_id")) > 0, F.col(c) / F.max(c).over(Window.partitionBy("app_id"))).otherwise(0.0)
    w = params.PRIORITY_WEIGHTS
    bad = F.col("negative_pct") / 100
    d = clusters.withColumns({"__v": share("total_reviews"), "__g": share("velocity_ratio")})
    score = w["volume"] * F.col("__v") + w["velocity"] * F.col("__g") + w["sentiment"] * bad + w["rating_impact"] * (bad * F.col("__v"))
    d = d.withColumn("priority_score", half_even(F.round(score * 100, 9))).drop("__v", "__g")
    return d.withColumn("priority_rank", F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("priority_score"), "category")))


def cluster_prompts(ranked: DataFrame) -> DataFrame:
    """The metrics of each cluster as labelled lines."""
    number = lambda c: F.format_string("%.1f", F.col(c))
    samples = F.array_join(F.transform("sample_reviews", lambda s: F.concat(F.lit('- "'), s, F.lit('"'))), "\n")
    lines = [
        F.lit("<cluster_data>"), F.concat(F.lit("category: "), "category"), F.concat(F.lit("total_reviews: "), "total_reviews"), F.concat(F.lit("recent_reviews: "), "recent_reviews"),
        F.concat(F.lit("prior_reviews: "), "prior_reviews"), F.concat(F.lit("velocity_ratio: "), number("velocity_ratio")), F.concat(F.lit("negative_pct: "), number("negative_pct")),
        F.concat(F.lit("avg_playtime_hours: "), number("avg_playtime_hours")), F.concat(F.lit("top_keywords: ["), F.array_join(F.transform("top_keywords", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]")),
        F.lit("sample_reviews:"), samples, F.concat(F.lit("priority_score: "), number("priority_score")), F.lit("</cluster_data>"),
    ]
    return ranked.select("app_id", "category", F.concat_ws("\n", *lines).alias("prompt"))
