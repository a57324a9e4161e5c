"""Review, label and chunk tables: insert-or-ignore, upsert and loads.

Tables are Parquet, partitioned by app_id, so that loads and merges for an app read its partition only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedmill import params


def first_of_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return batch.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def insert_or_ignore(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` to be appended: existing keys win, of equal keys in the batch the first row wins. A row with a null in
    its key cannot be told from its replay and is left out."""
    keyed = batch.dropna(subset=keys)
    return first_of_key(keyed, keys, order).join(existing.select(*keys), keys, "left_anti")


#: Up to so many apps of a batch are named in the filter of a table's partitions.
MOST_NAMED = 1000


def of_same_apps(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a table that a merge of ``batch`` can meet: those of its apps, whose partitions alone are read. A batch of
    more than MOST_NAMED apps meets all."""
    apps = [r.app_id for r in batch.select("app_id").distinct().limit(MOST_NAMED + 1).collect()]
    return existing if len(apps) > MOST_NAMED else existing.filter(F.col("app_id").isin([a for a in apps if a is not None]) | (F.col("app_id").isNull() if None in apps else F.lit(False)))


def review_rows(batch: DataFrame) -> DataFrame:
    """Reviews as they are stored: a missing vote is a negative one, a missing flag is false."""
    flag = F.coalesce("is_near_duplicate", F.lit(False)) if "is_near_duplicate" in batch.columns else F.lit(False)
    return batch.withColumns({"voted_up": F.coalesce("voted_up", F.lit(False)), "is_near_duplicate": flag, "weighted_vote_score": F.expr("try_cast(weighted_vote_score as double)")})


def classification_rows(batch: DataFrame, threshold: float = params.CONFIDENCE) -> DataFrame:
    """Labels as they are stored: the secondary list as JSON text, low confidence marked for review."""
    return batch.withColumns({"needs_review": F.col("confidence") < threshold, "secondary_categories": F.to_json(F.coalesce("secondary_categories", F.array().cast("array<string>")))})


def upsert(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` with the rows of ``batch`` put in by key: a new row replaces the old, of equal keys in the batch the last row wins. A row
    with a null in its key cannot be told from its replay and is left out."""
    last = first_of_key(batch.dropna(subset=keys), keys, [F.desc(c) for c in order]).select(*existing.columns)
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("app_id").parquet(path)


def overwrite_apps(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the apps that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_id").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_reviews(reviews: DataFrame, app_id: str | None = None, exclude_duplicates: bool = True) -> DataFrame:
    out = reviews if app_id is None else reviews.filter(F.col("app_id") == app_id)
    return out.filter(~F.col("is_near_duplicate")) if exclude_duplicates else out


def load_classifications(labels: DataFrame, app_id: str | None = None) -> DataFrame:
    """Stored labels with the secondary list parsed; empty or missing text gives an empty list."""
    out = labels if app_id is None else labels.filter(F.col("app_id") == app_id)
    return out.withColumn("secondary_categories", F.coalesce(F.from_json("secondary_categories", "array<string>"), F.array().cast("array<string>")))


def count_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("n_reviews"))


def unclassified_reviews(reviews: DataFrame, labels: DataFrame, app_id: str | None = None) -> DataFrame:
    return load_reviews(reviews, app_id).join(labels.select("review_id"), "review_id", "left_anti")


def classified_reviews(reviews: DataFrame, labels: DataFrame, app_id: str | None = None) -> DataFrame:
    """Reviews, without near-duplicates, with their labels, without the category other."""
    parsed = load_classifications(labels, app_id).filter("primary_category <> 'other'")
    kept = ["review_id", "primary_category", "secondary_categories", "confidence", "needs_review"]
    return load_reviews(reviews, app_id).select("review_id", "app_id", "review_text", "voted_up", "timestamp", "playtime_hours", "weighted_vote_score").join(parsed.select(*kept), "review_id")
