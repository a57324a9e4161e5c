from datetime import datetime

from pyspark.sql import functions as F

from feedmill.operators import clusters, neardup, reviews, stats
from feedmill.plans.oracles import ORACLES
from feedmill.plans.queries import QUERIES
from feedmill.schemas import RAW_REVIEW, REVIEW_PAGE
from feedmill.sources import pages, tables


def raw(spark, *rows):
    full = [dict(dict(recommendationid="1", review="good old words here", voted_up=True, timestamp_created=0, steam_purchase=True, received_for_free=False, votes_up=1, votes_funny=0, weighted_vote_score="0.5", author=("u", 9)), **r) for r in rows]
    names = ["recommendationid", "review", "voted_up", "timestamp_created", "steam_purchase", "received_for_free", "votes_up", "votes_funny", "weighted_vote_score", "author"]
    return spark.createDataFrame([("a", 0, i, tuple(r[n] for n in names)) for i, r in enumerate(full)], f"app_id string, page int, pos int, review {RAW_REVIEW}")


def test_extract(spark):
    d = raw(spark, {}, {"received_for_free": True}, {"steam_purchase": None}, {"recommendationid": "2", "author": None, "votes_up": None}, {"recommendationid": "3", "author": ("u", 15), "weighted_vote_score": "bad"})
    got = {r.review_id: r for r in reviews.extract_review_fields(d).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert got["1"].playtime_hours == 0.2 and got["3"].playtime_hours == 0.3 and got["2"].playtime_hours == 0.0
    assert got["2"].votes_up == 0 and got["3"].weighted_vote_score == 0.0 and got["1"].timestamp == datetime(1970, 1, 1)


def test_clean_filters_before_dedup(spark):
    d = raw(spark, {"review": "ok"}, {"review": "enough words in here"}, {"recommendationid": "2", "review": None}, {"recommendationid": "3", "review": "a b c d"}, {"recommendationid": "4", "review": "abcdefgh"}, {"recommendationid": "5", "review": "a b cd"})
    got = {r.review_id: r.review_text for r in reviews.clean_reviews(reviews.extract_review_fields(d)).collect()}
    assert got == {"1": "enough words in here", "3": "a b c d", "5": "a b cd"}


def test_pages_end_and_cut(spark, tmp_path):
    one = lambda i: {"recommendationid": str(i), "review": "x"}
    rows = [("a", 0, 1, [one(0), one(1)]), ("a", 1, 1, [one(2)]), ("a", 2, 0, [one(3)]), ("a", 3, 1, [one(4)]), ("b", 0, 1, []), ("b", 1, 1, [one(5)])]
    import json

    (tmp_path / "p.json").write_text("\n".join(json.dumps({"app_id": a, "page": p, "success": s, "reviews": r}) for a, p, s, r in rows))
    got = pages.read_review_pages(spark, str(tmp_path))
    assert got.schema.simpleString() == spark.createDataFrame([], REVIEW_PAGE).schema.simpleString()
    ids = lambda d: sorted(r.review.recommendationid for r in d.collect())
    assert ids(pages.raw_reviews(got)) == ["0", "1", "2"] and ids(pages.raw_reviews(got, 2)) == ["0", "1"]


def test_tables(spark, tmp_path):
    schema = "review_id string, app_id string, voted_up boolean, weighted_vote_score string, pos int"
    existing = spark.createDataFrame([("1", "a", True, "0.1", 0)], schema)
    batch = spark.createDataFrame([("1", "a", False, "0.2", 0), ("2", "a", None, "0.3", 2), ("2", "a", True, "0.4", 1), ("3", "b", None, "x", 3)], schema)
    new = tables.insert_or_ignore(tables.review_rows(batch), existing, ["review_id"], ["pos"])
    got = {r.review_id: (r.voted_up, r.weighted_vote_score) for r in new.collect()}
    assert got == {"2": (True, 0.4), "3": (False, None)}
    path = str(tmp_path / "t")
    tables.append(new, path)
    assert tables.insert_or_ignore(tables.review_rows(batch), spark.read.parquet(path), ["review_id"], ["pos"]).filter("review_id <> '1'").count() == 0
    up = tables.upsert(batch.select("review_id", "app_id", "pos"), existing.select("review_id", "app_id", "pos"), ["review_id"], ["pos"])
    again = tables.upsert(batch.select("review_id", "app_id", "pos"), up, ["review_id"], ["pos"])
    assert sorted(map(tuple, up.collect())) == sorted(map(tuple, again.collect())) == [("1", "a", 0), ("2", "a", 2), ("3", "b", 3)]


def test_labels_table(spark):
    d = spark.createDataFrame([("1", "a", '["x"]'), ("2", "a", ""), ("3", "b", None)], "review_id string, app_id string, secondary_categories string")
    assert [r.secondary_categories for r in tables.load_classifications(d).orderBy("review_id").collect()] == [["x"], [], []]
    s = tables.classification_rows(spark.createDataFrame([("1", ["x"], 0.69), ("2", None, 0.7)], "review_id string, secondary_categories array<string>, confidence double")).orderBy("review_id").collect()
    assert [(r.secondary_categories, r.needs_review) for r in s] == [('["x"]', True), ("[]", False)]


def flags(spark, texts, t=0.5, method="exact", parts=3):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(texts)], "app_id string, pos bigint, review_text string").repartition(parts)
    return [r.is_near_duplicate for r in neardup.near_duplicate_flags(d, t, method).orderBy("pos").collect()]


def test_near_duplicate_order(spark):
    base = [f"w{i}" for i in range(12)]
    a, b, c = " ".join(base), " ".join(["x", *base[2:], "y"]), " ".join(["x", *base[4:], "y", "z", "q"])
    assert flags(spark, [a, b, c]) == [False, True, False]  # a ~ b, b ~ c, a !~ c
    assert flags(spark, [c, b, a]) == [False, True, False]
    assert flags(spark, [b, a, c]) == [False, True, True]
    assert flags(spark, [a, a.upper(), a]) == [False, True, True]
    assert flags(spark, ["a b", "a b", None, ""]) == [False] * 4
    assert flags(spark, [a, b, c], parts=1) == flags(spark, [a, b, c], parts=7)


def test_near_duplicate_members(spark):
    texts = ["a b c d", "x y z x y z x", "A  b\nc D", "a b", None, "y z x y z x y", "a b c d"]
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)] + [("b", 9, "a b c d")], "app_id string, pos bigint, review_text string")
    got = sorted(tuple(r) for r in neardup.near_duplicate_members(d).collect())
    assert got == [("a", 0, 0), ("a", 1, 1), ("a", 2, 0), ("a", 3, None), ("a", 4, None), ("a", 5, 1), ("a", 6, 0), ("b", 9, 9)]
    assert "near_duplicate_members" in QUERIES and "near_duplicate_members" in ORACLES


def test_lsh_finds_what_exact_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = docs.select(F.lit("a").alias("app_id"), F.col("doc_id").alias("pos"), F.col("text").alias("review_text"))
    exact = {(r.first, r.second) for r in neardup.near_duplicate_pairs(d, 0.8).select(F.col("first"), F.col("second")).toPandas().itertuples(index=False)}
    lsh = {(r.first, r.second) for r in neardup.near_duplicate_pairs(d, 0.8, "lsh").select("first", "second").toPandas().itertuples(index=False)}
    assert lsh <= exact and len(lsh) >= 0.98 * len(exact)


def test_clusters(spark):
    day = lambda n: datetime.fromtimestamp(1711843200 - n * 86400)
    rows = [("a", "c1", day(30), False), ("a", "c1", day(60), True), ("a", "c1", day(-5), None), ("a", "c1", None, False), ("a", "c2", day(1), True), ("a", "c2", day(1), True)]
    rows += [("a", "c3", day(1), True)] * 4 + [("a", "c4", None, True)] * 3 + [("a", None, day(1), True)] * 3
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "app_id string, category string, timestamp timestamp, voted_up boolean, playtime_hours double")
    d = d.withColumn("voted_up", F.coalesce("voted_up", F.lit(False)))
    got = {r.category: r for r in clusters.cluster_metrics(d, F.timestamp_seconds(F.lit(1711843200))).collect()}
    assert sorted(got) == ["c1", "c3", "c4"]
    assert (got["c1"].total_reviews, got["c1"].recent_reviews, got["c1"].prior_reviews, got["c1"].negative_pct) == (4, 2, 1, 75.0)
    assert got["c3"].velocity_ratio == 4.0 and got["c4"].velocity_ratio == 0.0


def test_rank(spark):
    d = spark.createDataFrame([("a", "A", 50, 2.0, 80.0), ("a", "B", 25, 4.0, 60.0)], "app_id string, category string, total_reviews bigint, velocity_ratio double, negative_pct double")
    got = {r.category: (r.priority_score, r.priority_rank) for r in clusters.rank_clusters(d).collect()}
    assert got == {"A": (77.0, 1), "B": (63.0, 2)}


def test_keywords(spark):
    d = spark.createDataFrame([("(Crash!) crash... the -- x don't lag",), (None,)], "review_text string")
    assert [(r.word, r.n) for r in stats.keyword_frequency(d).collect()] == [("crash", 2), ("lag", 1)]


def test_stats_and_usage(spark):
    d = spark.createDataFrame([("a", True, 1.0, 2, False, datetime(2024, 1, 1)), ("a", False, 2.0, 3, True, None)], "app_id string, voted_up boolean, playtime_hours double, votes_up bigint, is_near_duplicate boolean, timestamp timestamp")
    r = stats.basic_stats(d).first()
    assert (r.total_reviews, r.positive_count, r.negative_pct, r.median_playtime_hours, r.duplicate_count) == (2, 1, 50.0, 1.5, 1)
    assert stats.basic_stats(d.limit(0)).count() == 0
    log = spark.createDataFrame([("x", 1, 2), ("x", 3, 4), ("y", 5, 6)], "node string, input bigint, output bigint")
    assert sorted((r.is_total, r.input, r.output) for r in stats.token_usage(log).collect()) == [(0, 4, 6), (0, 5, 6), (1, 9, 12)]


def test_samples_and_listing(spark):
    rows = [("a", str(i), "c", i < 2, f"text {i}\nmore", i / 10) for i in range(6)]
    d = spark.createDataFrame(rows, "app_id string, review_id string, primary_category string, voted_up boolean, review_text string, weighted_vote_score double")
    assert [r.voted_up for r in reviews.sample_negatives(d).collect()] == [False]
    assert reviews.sample_negatives(d.withColumn("voted_up", F.lit(True))).count() == 1
    r = reviews.negative_listing(d).first()
    assert (r.n_negative, r.n_more) == (4, 1) and r.previews.startswith("[2] text 2 more / ")
    s = clusters.cluster_samples(d.withColumnRenamed("primary_category", "category")).first()
    assert s.sample_reviews[0] == "text 5\nmore" and len(s.sample_reviews) == 5


def test_keyword_ties_by_first_place(spark):
    d = spark.createDataFrame([("a", 2, "zebra apple"), ("a", 1, "mango, zebra mango"), ("b", 0, "berry apple"), ("b", 3, None)], "app_id string, pos int, review_text string")
    got = [(r.word, r.n) for r in stats.keyword_frequency(d, order_col="pos").collect()]
    assert got == [("apple", 2), ("mango", 2), ("zebra", 2), ("berry", 1)]
    assert [r.word for r in stats.keyword_frequency(d).collect()] == ["apple", "mango", "zebra", "berry"]
    by = stats.keywords_by(d.withColumn("pos", -F.col("pos")), ["app_id"], order_col="pos").orderBy("app_id", "rank").collect()
    assert [r.word for r in by] == ["zebra", "mango", "apple", "berry", "apple"]


def test_basic_stats_of_all_apps(spark):
    rows = [("a", True, 1.0, 1, False), ("b", False, 3.0, 2, True)]
    d = spark.createDataFrame(rows, "app_id string, voted_up boolean, playtime_hours double, votes_up int, is_near_duplicate boolean").withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    r = stats.basic_stats(d, overall=True).first()
    assert (r.total_reviews, r.positive_pct, r.avg_playtime_hours, r.duplicate_count) == (2, 50.0, 2.0, 1) and "app_id" not in r.asDict()
    assert stats.basic_stats(d.limit(0), overall=True).first().total_reviews == 0


def test_lsh_finds_pairs_at_the_threshold(spark):
    """2,000 pairs just above the threshold: 16 bands of 8 rows lost several of them."""
    rows = []
    for i in range(2_000):
        w = [f"w{i}x{j}" for j in range(81)]  # 79 shingles; the last six words are others in the copy: 73 of 85 shared
        rows += [("a", 2 * i, " ".join(w)), ("a", 2 * i + 1, " ".join(w[:75] + [f"v{i}x{j}" for j in range(6)]))]
    d = spark.createDataFrame(rows, "app_id string, pos long, review_text string").repartition(4)
    got = neardup.near_duplicate_pairs(d, method="lsh").collect()
    assert len(got) == 2_000 and all(abs(r.similarity - 73 / 85) < 1e-12 for r in got)


def test_pages_are_not_dealt_by_app(spark):
    """Pages stay where they were read: an app's pages, of which one app may have most, do not meet in one task."""
    page = "app_id string, page int, success int, reviews array<struct<recommendationid:string>>"
    d = spark.createDataFrame([("a", 0, 1, [("1",)]), ("a", 1, 0, [("2",)]), ("a", 2, 1, [("3",)]), ("b", 0, 1, [("4",), ("5",)]), (None, 0, 1, [("6",)]), ("c", 0, None, [("7",)])], page)
    rows = pages.raw_reviews(d)
    assert sorted((r.app_id, r.page, r.pos, r.review.recommendationid) for r in rows.collect()) == [("a", 0, 0, "1"), ("b", 0, 0, "4"), ("b", 0, 1, "5")]
    assert "SortMergeJoin" not in pages.raw_reviews(d)._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" in rows._jdf.queryExecution().sparkPlan().toString()
