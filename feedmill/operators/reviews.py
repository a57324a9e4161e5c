"""Reviews: extraction, cleaning, samples and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedmill import params
from feedmill.functions.text import words
from feedmill.sources.tables import first_of_key


def extract_review_fields(raw: DataFrame) -> DataFrame:
    """Flat reviews of paid copies from (app_id, page, pos, review). Hours are minutes / 60, to one place, ties up."""
    r = F.col("review")
    minutes = F.coalesce(r["author"]["playtime_forever"], F.lit(0))
    return raw.filter((r["steam_purchase"]) & (~r["received_for_free"])).select(
        r["recommendationid"].alias("review_id"), "app_id", r["author"]["steamid"].alias("steam_id"), r["review"].alias("review_text"), r["voted_up"].alias("voted_up"),
        F.timestamp_seconds(r["timestamp_created"]).alias("timestamp"), (F.floor((minutes + 3) / 6) / 10.0).cast("double").alias("playtime_hours"), F.coalesce(r["votes_up"], F.lit(0)).alias("votes_up"),
        F.coalesce(r["votes_funny"], F.lit(0)).alias("votes_funny"), F.coalesce(F.expr("try_cast(review.weighted_vote_score as double)"), F.lit(0.0)).alias("weighted_vote_score"), "page", "pos",
    )


def long_enough(reviews: DataFrame) -> DataFrame:
    """Reviews of at least five characters and three words."""
    text = F.col("review_text")
    return reviews.filter(text.isNotNull() & (F.length(text) >= params.MIN_CHARS) & (F.size(words(text)) >= params.MIN_WORDS))


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews of at least five characters and three words; of equal ids the first by (page, pos) that passes."""
    return first_of_key(long_enough(reviews), ["review_id"], ["page", "pos"])


def sample_negatives(classified: DataFrame, seed: int = 0) -> DataFrame:
    """One negative review of each app and category, by a hash of id and seed; apps without negatives use all their reviews."""
    flag = classified.groupBy("app_id").agg(F.count_if(~F.col("voted_up")).alias("__n"))
    pool = classified.join(flag, "app_id").filter((F.col("__n") == 0) | ~F.col("voted_up")).drop("__n")
    w = Window.partitionBy("app_id", "primary_category").orderBy(F.md5(F.concat_ws("/", "review_id", F.lit(str(seed)))), "review_id")
    return pool.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("app_id", "primary_category", "review_id", "review_text", "voted_up")


def negative_listing(classified: DataFrame, shown: int = 3) -> DataFrame:
    """Per app and category the number of negatives, the previews of the first by id, and how many more there are."""
    bad = classified.filter(~F.col("voted_up"))
    preview = F.replace(F.substring("review_text", 1, params.PREVIEW_CHARS), F.lit("\n"), F.lit(" "))
    w = Window.partitionBy("app_id", "primary_category").orderBy("review_id")
    first = bad.select("app_id", "primary_category", "review_id", preview.alias("__p")).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= shown)
    first = first.groupBy("app_id", "primary_category").agg(F.array_sort(F.collect_list(F.struct("__k", F.concat(F.lit("["), "review_id", F.lit("] "), "__p").alias("t")))).alias("__l"))
    counts = bad.groupBy("app_id", "primary_category").agg(F.count("*").alias("n_negative"))
    return counts.join(first, ["app_id", "primary_category"]).select(
        "app_id", "primary_category", "n_negative", F.array_join(F.transform("__l", lambda x: x["t"]), " / ").alias("previews"), F.greatest(F.col("n_negative") - shown, F.lit(0)).alias("n_more")
    )
