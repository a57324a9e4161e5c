"""Incremental ingestion of landed review pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedmill.operators.reviews import clean_reviews, extract_review_fields
from feedmill.schemas import REVIEW, REVIEW_PAGE
from feedmill.sources.tables import append, insert_or_ignore, of_same_apps, review_rows


def stream_reviews(spark: SparkSession, pages_dir: str, table_path: str, checkpoint: str, files_per_batch: int | None = None):
    """Start a query that appends new reviews of the pages below ``pages_dir`` to the table and ends when all are read.

    The table is the state: late and replayed pages meet their keys there, so no watermark is needed, and a
    batch that is run again after a failure finds the rows that it has written. A batch reads the partitions of
    its own apps only; a review belongs to one app. Reviews without id are left out.
    """
    reader = spark.readStream.schema(REVIEW_PAGE)
    pages = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(pages_dir)
    rows = pages.filter((F.col("success") != 0) & (F.size("reviews") > 0)).select("app_id", "page", F.posexplode("reviews").alias("pos", "review"))

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        existing = spark.read.schema(REVIEW).parquet(table_path) if there else spark.createDataFrame([], REVIEW)
        batch.persist()
        clean = review_rows(clean_reviews(extract_review_fields(batch)))
        new = insert_or_ignore(clean, of_same_apps(existing, batch), ["review_id"], ["page", "pos"])
        append(new.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) {f.name}" for f in existing.schema]), table_path)
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
