"""Cluster metrics from signed day sums against those from reviews; sketches against exact quantiles and counts."""

import datetime
import random

from pyspark.sql import functions as F

from feedmill import params
from feedmill.functions.text import keyword, words
from feedmill.operators import stats
from feedmill.operators.clusters import build_clusters
from feedmill.operators.rollups import ClusterRollup, day_sketches, fold_sketches, sketched

ROW = "review_id string, app_id string, category string, timestamp timestamp, voted_up boolean, playtime_hours double, weighted_vote_score double, review_text string"


def reviews(n, seed=1):
    rnd = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    word = lambda: rnd.choice(["crash", "lag", "bug", "menu", "sound", "price", "story", "boss"]) + rnd.choice(["", "!", "s"])
    when = lambda: rnd.choice([None] + [start + datetime.timedelta(days=rnd.randint(0, 120), seconds=rnd.choice([0, 1, 86399]))] * 9)
    return [(f"r{i}", f"app{i % 2}", rnd.choice(["a", "b", "c", None]), when(), rnd.random() < 0.5, rnd.randint(0, 999) / 10, rnd.choice([None, rnd.random()]), " ".join(word() for _ in range(6))) for i in range(n)]


def rows_of(df):
    return sorted((r.app_id, r.category, r.total_reviews, r.recent_reviews, r.prior_reviews, r.velocity_ratio, r.negative_pct, r.avg_playtime_hours, r.top_keywords, r.sample_reviews) for r in df.collect())


def test_rolling_equals_rebuilt(spark, tmp_path):
    rows = reviews(400)
    df = spark.createDataFrame(rows, ROW)
    part = F.substring("review_id", 2, 9).cast("int")
    rollup = ClusterRollup(spark, str(tmp_path / "r"))
    rollup.commit("1", df.filter(part % 3 == 0))
    rollup.commit("2", df.filter(part % 3 != 0))
    gone = df.filter(part % 4 == 1)
    rollup.commit("3", deleted=gone)
    rollup.commit("3", deleted=df)  # a replay
    left = df.filter(part % 4 != 1)
    dates = [datetime.date(2024, 3, 1), datetime.date(2024, 4, 30), datetime.date(2030, 1, 1), datetime.date(2000, 1, 1)]
    got = rollup.clusters(dates, left).cache()
    for d in dates:
        assert rows_of(got.filter(F.col("as_of") == d)) == rows_of(build_clusters(left, F.lit(str(d)).cast("timestamp")))
    assert ClusterRollup(spark, str(tmp_path / "none")).clusters(dates).count() == 0


def test_a_batch_is_run_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(reviews(200), ROW)
    rollup = ClusterRollup(spark, str(tmp_path / "r"))
    rollup.commit("1", df.mapInArrow(passed, ROW))
    rollup.commit("2", deleted=df.limit(50).mapInArrow(passed, ROW))
    assert seen.value == 250


def test_words_are_counted_in_tasks(spark, monkeypatch):
    """Equal to counts of single words, for every kind of white space, edges, null texts and keys, and when counts are handed on early."""
    monkeypatch.setattr(stats, "HELD_WORDS", 3)
    chars = "".join(chr(c) for c in [*range(1, 0x3100), 0xFEFF, 0x1F600])
    texts = [chars, "x".join(chars), "a  The\tcrash, crash! (crash) -- \u0130X \u2003it's-", "", " ", None, "same same Same"]
    df = spark.createDataFrame([(k, t) for k in ("a", None) for t in texts], "k string, t string")
    one = df.select("k", F.explode(words(F.lower("t"))).alias("w")).select("k", keyword(F.col("w")).alias("word"))
    want = one.filter((F.length("word") > 1) & ~F.col("word").isin(params.STOP_WORDS)).groupBy("k", "word").agg(F.count("*").alias("n"))
    got = stats.keyword_counts(df, ["k"], "t")
    key = lambda r: (r.k or "", r.word, r.n)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.columns == want.columns
    assert stats.keyword_counts(df.limit(0), ["k"], "t").count() == 0
    assert {r.word: r.n for r in stats.keyword_counts(df, [], "t").collect()}["crash"] == 6


def test_sketches_of_any_period(spark):
    rows = reviews(20_000, 2) + [("x", "app9", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ROW)
    days = day_sketches(df)
    for period, own in (("2024-01-01", "2024-01-31"), ("2024-01-15", "2024-04-10")):
        one = days.filter(F.col("day").between(period, own))
        got = {r.app_id: r for r in sketched(fold_sketches(one), (0.1, 0.5, 0.9), 8).collect()}
        exact = df.filter(F.to_date("timestamp").between(period, own))
        words = {(r.app_id, r.word): r.n for r in stats.keyword_counts(exact, ["app_id"]).collect()}
        for app, r in got.items():
            hours = sorted(x[0] for x in exact.filter(F.col("app_id") == app).select("playtime_hours").collect())
            assert r.n == len(hours)
            for q, v in zip((0.1, 0.5, 0.9), r.quantiles):
                below, upto = sum(h < v for h in hours) / len(hours), sum(h <= v for h in hours) / len(hours)
                assert below - 0.02 <= q <= upto + 0.02  # KLL of 200: 1.65 % of rank with 99 in 100
            assert {w.word: w.n for w in r.keywords}.items() <= {w: n for (a, w), n in words.items() if a == app}.items()  # fewer words than are tracked: exact
            assert sorted((w.n for w in r.keywords), reverse=True) == sorted((n for (a, _), n in words.items() if a == app), reverse=True)[:8]
    empty = {r.app_id: r for r in sketched(fold_sketches(days.filter("day is null"))).collect()}["app9"]
    assert empty.n == 1 and empty.quantiles is None
