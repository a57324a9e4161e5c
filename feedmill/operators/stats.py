"""Basic statistics, keyword counts and token usage."""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedmill import params
from feedmill.functions.text import half_even, keyword, words

#: Different words that a task counts before it hands their counts on.
HELD_WORDS = 1 << 19


def _moment(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def basic_stats(reviews: DataFrame, approximate: bool = False, overall: bool = False) -> DataFrame:
    """Totals, shares, means and the median of each app; ``overall``: of all apps in one row without ``app_id``, with total 0 and
    nulls if there are no reviews. The exact median shuffles distinct values; ``approximate`` bounds that."""
    up = F.sum(F.coalesce(F.col("voted_up"), F.lit(False)).cast("bigint"))
    total = F.count("*")
    median = F.percentile_approx("playtime_hours", 0.5) if approximate else F.median("playtime_hours")
    share = lambda n: half_even(n / total * 100)
    return (reviews.groupBy() if overall else reviews.groupBy("app_id")).agg(
        total.alias("total_reviews"), up.alias("positive_count"), (total - up).alias("negative_count"), share(up).alias("positive_pct"), share(total - up).alias("negative_pct"),
        half_even(F.avg("playtime_hours")).alias("avg_playtime_hours"), half_even(median).alias("median_playtime_hours"), half_even(F.avg("votes_up")).alias("avg_votes_up"),
        F.sum(F.col("is_near_duplicate").cast("bigint")).alias("duplicate_count"), _moment(F.min("timestamp")).alias("earliest_review"), _moment(F.max("timestamp")).alias("latest_review"),
    )


def keyword_counts(texts: DataFrame, keys: list[str], text_col: str = "review_text", order_col: str | None = None) -> DataFrame:
    """(keys, word, n): words without edge punctuation, of two characters or more, that are no stop words; counted before the
    shuffle. With ``order_col``, the order of the texts, also ``seen``: where the word stands first (text, place in it)."""
    if order_col is None:
        return _task_counts(texts, keys, text_col).groupBy(*keys, "word").agg(F.sum("n").alias("n"))
    w = texts.select(*keys, F.col(order_col).alias("__o"), F.posexplode(words(F.lower(text_col))).alias("__p", "w")).select(*keys, "__o", "__p", keyword(F.col("w")).alias("word"))
    counts = [F.count("*").alias("n"), F.min(F.struct("__o", "__p")).alias("seen")]
    return w.filter((F.length("word") > 1) & ~F.col("word").isin(params.STOP_WORDS)).groupBy(*keys, "word").agg(*counts)


def _task_counts(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, word, n): the words of ``keyword_counts`` counted in each task, to be added up. No row is made for a single word; ``str.split`` has
    the white space of ``words``."""
    edge, stop, most, k = params.WORD_EDGE, frozenset(params.STOP_WORDS), HELD_WORDS, len(keys)
    out = texts.select(*keys).schema.add("word", "string").add("n", "long")

    def run(batches):
        def counted():
            rows = [(key, w, n) for key, count in held.items() for word, n in count.items() if len(w := word.strip(edge)) > 1 and w not in stop]
            columns = [pa.array([key[i] for key, _, _ in rows], t) for i, t in enumerate(types)]
            columns += [pa.array([w for _, w, _ in rows], pa.string()), pa.array([n for _, _, n in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        held, size, types, names = {}, 0, [], [*keys, "word", "n"]
        for batch in batches:
            types = [batch.column(i).type for i in range(k)]
            groups = zip(*(batch.column(i).to_pylist() for i in range(k))) if k else repeat((), batch.num_rows)
            for key, text in zip(groups, batch.column(k)):
                if not text.is_valid:
                    continue
                count = held.setdefault(key, Counter())
                size -= len(count)
                count.update(text.as_py().split())
                size += len(count)
                if size > most:
                    yield counted()
                    held, size = {}, 0
        if held:
            yield counted()

    return texts.select(*keys, F.lower(text_col).alias("__text")).mapInArrow(run, out)


def keyword_frequency(texts: DataFrame, n: int = params.KEYWORDS, text_col: str = "review_text", order_col: str | None = None) -> DataFrame:
    """The ``n`` most frequent words; equal counts by word, or with ``order_col`` by where they are seen first."""
    tie = "word" if order_col is None else "seen"
    return keyword_counts(texts, [], text_col, order_col).orderBy(F.desc("n"), tie).limit(n).select("word", "n")


def keywords_by(texts: DataFrame, keys: list[str], n: int = params.CLUSTER_KEYWORDS, text_col: str = "review_text", order_col: str | None = None) -> DataFrame:
    """(keys, rank, word, n): the ``n`` most frequent words of each group; ties as in ``keyword_frequency``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "word" if order_col is None else "seen")
    return keyword_counts(texts, keys, text_col, order_col).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(*keys, "word", "n", "rank")


def token_usage(log: DataFrame) -> DataFrame:
    """Input and output tokens of each node and, with a null node and is_total 1, of all."""
    return log.rollup("node").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.grouping("node").cast("int").alias("is_total"))
