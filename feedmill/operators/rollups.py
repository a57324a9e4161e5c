"""Day rollups of reviews: cluster metrics of any day from signed sums, quantiles and frequent words of any period from sketches.

Deltas are additive: inserted reviews count, deleted ones count negatively, and a batch is its reviews' sums for each app, category and
day and for each word. Batches are committed by name, once each, by one rename of a pointer. Windows are differences of
prefix sums over days, so another ``as_of`` reads days, not reviews.

Sketches are kept for each app and day and merged to any period: KLL for quantiles, a bounded table of counted items for words.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedmill import params
from feedmill.functions.text import half_even, keyword, words
from feedmill.operators.clusters import KEYS, cluster_samples
from feedmill.operators.stats import keyword_counts
from feedmill.storage import Workspace, names_in, publish, read_text

_REVIEW = (*KEYS, "review_id", "timestamp", "voted_up", "playtime_hours", "weighted_vote_score", "review_text")
_DAYS = "app_id string, category string, day date, n bigint, bad bigint, hours decimal(38,6)"
_WORDS = "app_id string, category string, word string, n bigint"
_SAMPLES = "app_id string, category string, review_id string, weighted_vote_score double, text string"
_GONE = "app_id string, category string, review_id string"


def day_sums(reviews: DataFrame, sign: int = 1) -> DataFrame:
    """Rows of _DAYS: how many reviews of a category and day there are, how many are negative, and their hours; times ``sign``. Reviews
    without timestamp are those of day null."""
    d = reviews.filter("category is not null").groupBy(*KEYS, F.to_date("timestamp").alias("day"))
    return d.agg((sign * F.count("*")).alias("n"), (sign * F.count_if(~F.col("voted_up"))).alias("bad"), (sign * F.coalesce(F.sum(F.col("playtime_hours").cast("decimal(28,6)")), F.lit(0))).cast("decimal(38,6)").alias("hours"))


def metrics_of(days: DataFrame, as_of: list[datetime.date], window_days: int = params.WINDOW_DAYS, least: int = params.MIN_CLUSTER) -> DataFrame:
    """``clusters.cluster_metrics`` at the start of each day in ``as_of``, with that day, from sums of rows of _DAYS. Hours of null are left out of
    the mean there and here count as 0, so they must not be null."""
    days = days.groupBy(*KEYS, "day").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("hours").alias("hours"))
    totals = days.groupBy(*KEYS).agg(F.sum("n").alias("total_reviews"), F.sum("bad").alias("bad"), F.sum("hours").alias("hours"), F.sum(F.when(F.col("day").isNotNull(), F.col("n"))).alias("timed"))
    # a cluster has as many rows here as days, whatever its reviews
    upto = days.filter("day is not null").select(*KEYS, "day", F.sum("n").over(Window.partitionBy(*KEYS).orderBy("day")).alias("upto"))
    asked = upto.select(*KEYS, "day", "upto", F.explode(F.array(*[F.lit(d) for d in as_of])).alias("as_of"))
    before = lambda n: F.coalesce(F.max_by(F.when(F.col("day") < F.date_sub("as_of", n), F.col("upto")), F.when(F.col("day") < F.date_sub("as_of", n), F.col("day"))), F.lit(0))
    cut = asked.groupBy(*KEYS, "as_of").agg(before(window_days).alias("cut"), before(2 * window_days).alias("before"))
    every = totals.filter(F.col("total_reviews") >= least).withColumn("as_of", F.explode(F.array(*[F.lit(d) for d in as_of])))
    d = every.join(cut, [*KEYS, "as_of"], "left").select(
        *KEYS, "as_of", "total_reviews", "bad", "hours", (F.coalesce("timed", F.lit(0)) - F.coalesce("cut", F.lit(0))).alias("recent_reviews"), (F.coalesce("cut", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("prior_reviews")
    )
    ratio = F.when(F.col("prior_reviews") == 0, F.col("recent_reviews").cast("double")).otherwise(half_even(F.col("recent_reviews") / F.col("prior_reviews")))
    shares = [half_even(F.col("bad") / F.col("total_reviews") * 100).alias("negative_pct"), half_even(F.col("hours").cast("double") / F.col("total_reviews")).alias("avg_playtime_hours")]
    return d.select("as_of", *KEYS, "total_reviews", "recent_reviews", "prior_reviews", ratio.alias("velocity_ratio"), *shares)


class ClusterRollup:
    """The rollup of all batches so far, at ``path``. Reviews (app_id, category, review_id, timestamp, voted_up, playtime_hours, weighted_vote_score,
    review_text) with equal review_id are not looked for: a batch inserts new reviews and deletes reviews that earlier batches inserted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Apply a batch, as a whole and once: a name that is there already changes nothing."""
        if batch in names_in(self.spark, f"{self.path}/batches"):
            return
        token = uuid.uuid4().hex
        for k, (given, sign) in enumerate(((inserted, 1), (deleted, -1))):
            if given is None:
                continue
            with Workspace(self.spark) as work:
                # whatever the batch comes from is run once
                rows = work.settle(given.filter("category is not null").select(*[c for c in given.columns if c in _REVIEW]))
                day_sums(rows, sign).write.parquet(f"{self.path}/data/{token}/days/{k}")
                keyword_counts(rows, KEYS).withColumn("n", sign * F.col("n")).write.parquet(f"{self.path}/data/{token}/words/{k}")
                if sign > 0:
                    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("weighted_vote_score").desc_nulls_last(), "review_id"))
                    best = rows.select(*KEYS, "review_id", "weighted_vote_score").withColumn("k", rank).filter(F.col("k") <= params.SAMPLES).drop("k")
                    texts = rows.select(*KEYS, "review_id", F.substring("review_text", 1, params.SAMPLE_CHARS).alias("text"))
                    best.join(texts, [*KEYS, "review_id"]).write.parquet(f"{self.path}/data/{token}/samples/{k}")
                else:
                    rows.select(*KEYS, "review_id").write.parquet(f"{self.path}/data/{token}/gone/{k}")
        publish(self.spark, f"{self.path}/batches/{batch}", json.dumps({"token": token}))

    def _part(self, name: str, schema: str) -> DataFrame:
        tokens = [json.loads(read_text(self.spark, f"{self.path}/batches/{b}"))["token"] for b in names_in(self.spark, f"{self.path}/batches") if not b.startswith(".")]
        paths = [f"{self.path}/data/{t}/{name}/{k}" for t in tokens for k in names_in(self.spark, f"{self.path}/data/{t}/{name}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def days(self) -> DataFrame:
        return self._part("days", _DAYS).groupBy(*KEYS, "day").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("hours").cast("decimal(38,6)").alias("hours"))

    def keywords(self, n: int = params.CLUSTER_KEYWORDS) -> DataFrame:
        """(app_id, category, top_keywords); equal counts by word."""
        counts = self._part("words", _WORDS).groupBy(*KEYS, "word").agg(F.sum("n").alias("n")).filter("n > 0")
        top = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= n)
        return top.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("top_keywords"))

    def samples(self, reviews: DataFrame | None = None) -> DataFrame:
        """(app_id, category, sample_reviews). Each batch keeps its best few of a cluster, whose best are the cluster's. A cluster that has lost one of
        them is sampled again from ``reviews``, the reviews as they are now; without ``reviews`` it has what is left."""
        kept, gone = self._part("samples", _SAMPLES), self._part("gone", _GONE)
        lost = kept.join(gone, [*KEYS, "review_id"], "left_semi").select(*KEYS).distinct()
        whole = kept.join(gone, [*KEYS, "review_id"], "left_anti") if reviews is None else kept.join(lost, KEYS, "left_anti")
        out = cluster_samples(whole.withColumnRenamed("text", "review_text"))
        return out if reviews is None else out.unionByName(cluster_samples(reviews.join(lost, KEYS, "left_semi")))

    def clusters(self, as_of: list[datetime.date], reviews: DataFrame | None = None) -> DataFrame:
        """``clusters.build_clusters`` at the start of each day in ``as_of``, with that day."""
        d = metrics_of(self.days(), as_of).join(self.keywords(), KEYS, "left").join(self.samples(reviews), KEYS, "left")
        return d.withColumn("top_keywords", F.coalesce("top_keywords", F.array().cast("array<string>")))


# sketches

#: Counted words of a sketch. A word's count is too small or large by at most the words of the period over about three quarters of this.
ITEMS = 4096


def day_sketches(reviews: DataFrame) -> DataFrame:
    """(app_id, day, n, hours, words): for each app and day the number of reviews, a KLL sketch of playtime_hours and one of the words that
    ``keyword_counts`` counts; null where a day has none. Null hours are left out. A review without timestamp is of day null."""
    day = reviews.withColumn("day", F.to_date("timestamp"))
    known = day.filter("playtime_hours is not null").groupBy("app_id", "day").agg(F.expr("kll_sketch_agg_double(playtime_hours)").alias("hours"))
    hours = _beside(day.groupBy("app_id", "day").agg(F.count("*").alias("n")), known, "app_id", "day")
    each = day.select("app_id", "day", F.explode(words(F.lower("review_text"))).alias("w")).select("app_id", "day", keyword(F.col("w")).alias("word"))
    each = each.filter((F.length("word") > 1) & ~F.col("word").isin(params.STOP_WORDS))
    counted = each.groupBy("app_id", "day").agg(F.expr(f"approx_top_k_accumulate(word, {ITEMS})").alias("words"))
    return _beside(hours, counted, "app_id", "day")


def _beside(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """``left`` with the other columns of ``right`` for equal keys, null ones too; null where there are none."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, same, "left").drop(*[f"__{k}" for k in keys])


def fold_sketches(days: DataFrame, *period: str) -> DataFrame:
    """The sketches of ``days``, of whatever days are in it, merged for each app and each value of the columns ``period``."""
    keys = ("app_id", *period)
    folded = days.groupBy(*keys).agg(F.sum("n").alias("n"))
    for name, merge in (("hours", "kll_merge_agg_double(hours)"), ("words", f"approx_top_k_combine(words, {ITEMS})")):
        folded = _beside(folded, days.filter(F.col(name).isNotNull()).groupBy(*keys).agg(F.expr(merge).alias(name)), *keys)
    return folded


def sketched(folded: DataFrame, quantiles: tuple[float, ...] = (0.5,), n: int = params.KEYWORDS) -> DataFrame:
    """``folded`` with ``quantiles`` of the hours (an array, one for each asked) and ``keywords``, the ``n`` most frequent words with their counts; the
    exact ways are ``stats.basic_stats`` and ``stats.keyword_frequency``."""
    of = F.array(*[F.expr(f"kll_sketch_get_quantile_double(hours, {float(q)}D)") for q in quantiles])
    top = F.transform(F.expr(f"approx_top_k_estimate(words, {int(n)})"), lambda x: F.struct(x["item"].alias("word"), x["count"].alias("n")))
    return folded.withColumns({"quantiles": F.when(F.col("hours").isNotNull(), of), "keywords": F.when(F.col("words").isNotNull(), top)}).drop("hours", "words")
