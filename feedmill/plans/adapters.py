"""The jobs' inputs derived from the bench tables, by the same integer rules in Spark and in the comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedmill import params

_CATEGORY_LIST = ",".join(params.CATEGORIES)
TITLES = [
    "Patch 1.3.2 — Hotfix", "Patch 1.3.0 — The Frosthollow Update", "Stability Update", "Update 1.12.30", "Release Notes for March", "Fixed Matchmaking Issues", "Some News Post",
    "Weekend Event: Double XP!", "Watch the Developer Livestream", "Season 2: Now Available!", "The Neowsletter #5", "Hades II v1.0 Is Now Available!",
]

#: Both engines read these; ``string`` is a type name in both.
REVIEWS = """
select cast(doc_id as string) as review_id, 'app' || cast(doc_id % 3 as string) as app_id, 'u' || cast(doc_id % 97 as string) as steam_id, text as review_text,
  (doc_id * 7) % 10 < 6 as voted_up, 1711843200 - (doc_id * 13 % 120) * 86400 as created, doc_id * 37 % 9000 as minutes, doc_id % 23 as votes_up, doc_id % 5 as votes_funny,
  cast(doc_id * 7919 % 1000 as double) / cast(1000 as double) as weighted_vote_score, doc_id % 11 <> 0 as paid, doc_id % 13 = 0 as gift, doc_id % 9 = 0 as is_near_duplicate, doc_id as pos,
  cast(floor((doc_id * 37 % 9000 + 3) / 6) as double) / cast(10 as double) as playtime_hours
from documents
"""
LABELS = f"""
select cast(doc_id as string) as review_id, 'app' || cast(doc_id % 3 as string) as app_id, split_part('{_CATEGORY_LIST}', ',', cast(doc_id % 10 + 1 as int)) as primary_category,
  case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then '[]' else '["' || split_part('{_CATEGORY_LIST}', ',', cast(doc_id % 9 + 1 as int)) || '"]' end as secondary_categories,
  cast(doc_id * 31 % 101 as double) / cast(100 as double) as confidence, doc_id as pos
from documents where doc_id % 4 <> 0
"""
_BODY = (
    "'{\"primary_category\": \"' || case when doc_id % 8 = 3 then 'fun' else split_part('" + _CATEGORY_LIST + "', ',', cast(doc_id % 10 + 1 as int)) end || '\", \"secondary_categories\": [\"' || "
    "case when doc_id % 8 = 6 then 'other' when doc_id % 8 = 7 then split_part('" + _CATEGORY_LIST + "', ',', cast(doc_id % 10 + 1 as int)) else split_part('" + _CATEGORY_LIST + "', ',', cast(doc_id % 7 + 1 as int)) end || "
    "'\"], \"confidence\": ' || case when doc_id % 8 = 4 then '1.2' else '0.' || lpad(cast(doc_id * 31 % 100 as string), 2, '0') end || ', \"reasoning\": \"' || case when doc_id % 8 = 5 then 'too short' else 'reason number ' || cast(doc_id as string) end || '\"}'"
)
RESPONSES = f"""
select cast(doc_id as string) as review_id, 'app' || cast(doc_id % 3 as string) as app_id, doc_id as pos,
  case when doc_id % 8 = 1 then '```json' || chr(10) || {_BODY} || chr(10) || '```' when doc_id % 8 = 2 then {_BODY} || ' That is all.' else {_BODY} end as response_text
from documents
"""
TONE_RESPONSES = f"""
select cast(doc_id as string) as review_id,
  case when doc_id % 5 = 4 then 'The tone is angry' else '{{"tone": "' || split_part('{",".join([*params.TONES, "happy"])}', ',', cast(doc_id % 9 + 1 as int)) || '"}}' || case when doc_id % 5 = 3 then ' as it seems' else '' end end as response_text
from documents
"""
SUMMARY_RESPONSES = """
select doc_id, case doc_id % 4 when 0 then '<summary> ' || text || ' </summary>' when 1 then 'So: <summary>' || text || '</summary> Done.' when 2 then '<summary>' || text else ' ' || text || ' ' end as response_text
from documents
"""
TOKEN_LOG = "select role as node, cast(turn as int) as iteration, cast(length(text) as bigint) as input, cast(turn + 1 as bigint) as output from conversations"


def _split_title() -> str:
    return "|".join(TITLES)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the bench tables that it reads from."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations") if f"from {t}" in sql}
    for t in frames:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **frames)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reviews; ``pos`` is their order."""
    return view(spark, sf_dir, REVIEWS).withColumn("timestamp", F.timestamp_seconds("created")).drop("created", "minutes", "paid", "gift")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, page, pos, review) as they come out of landed pages."""
    d = view(spark, sf_dir, REVIEWS)
    author = F.struct(F.col("steam_id").alias("steamid"), F.col("minutes").alias("playtime_forever"))
    review = F.struct(
        F.col("review_id").alias("recommendationid"), F.col("review_text").alias("review"), "voted_up", F.col("created").alias("timestamp_created"), F.col("paid").alias("steam_purchase"), F.col("gift").alias("received_for_free"),
        "votes_up", "votes_funny", F.col("weighted_vote_score").cast("string").alias("weighted_vote_score"), author.alias("author"),
    )
    return d.select("app_id", F.floor(F.col("pos") / 300).cast("int").alias("page"), F.col("pos").cast("int").alias("pos"), review.alias("review"))


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages: the raw reviews of an app by the hundred."""
    rows = raw_reviews(spark, sf_dir).groupBy("app_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "review"))).alias("r"))
    return rows.select("app_id", "page", F.lit(1).alias("success"), F.lit("*").alias("cursor"), F.transform("r", lambda x: x["review"]).alias("reviews"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labels, the secondary categories as JSON text."""
    return view(spark, sf_dir, LABELS).withColumn("needs_review", F.col("confidence") < params.CONFIDENCE)


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.concat(F.element_at(F.split(F.lit(_split_title()), r"\|"), (F.col("page_id") % 12 + 1).cast("int")), F.lit(" "), F.floor(F.col("page_id") / 24).cast("string"))
    feed = F.element_at(F.array(F.lit(params.DEFAULT_FEED), F.lit("blog"), F.lit(None)), (F.col("page_id") % 3 + 1).cast("int"))
    return d.select(
        F.concat(F.lit("app"), (F.col("page_id") % 3).cast("string")).alias("app_id"), F.col("page_id").cast("string").alias("gid"), F.col("page_id").alias("pos"), title.alias("title"), "url", F.col("html").alias("contents"),
        (F.lit(1704067200) + F.col("page_id") * 3600).alias("date"), feed.alias("feedname"), F.when(F.col("page_id") % 2 == 0, "Community").alias("feedlabel"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-up release notes: the lines of each document as bold text, bullets, headed lines and plain lines in turn.
    Some have no id, some share one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = lambda line, i: F.when(i % 4 == 0, F.concat(F.lit("[b]"), line, F.lit("[/b]"))).when(i % 4 == 1, F.concat(F.lit("[*] "), line)).when(i % 4 == 2, F.concat(F.lit("[ SOUND ]\n"), line)).otherwise(line)
    contents = F.concat(F.lit("[img]http://i.example.com/"), (F.col("doc_id") % 7).cast("string"), F.lit('.png[/img]<img src="http://i.example.com/1.png">\n'), F.array_join(F.transform(F.split("text", "\n"), mark), "\n"))
    return d.select(
        F.concat(F.lit("app"), (F.col("doc_id") % 3).cast("string")).alias("app_id"), F.when(F.col("doc_id") % 40 == 8, "same").when(F.col("doc_id") % 40 != 7, F.col("doc_id").cast("string")).alias("gid"), F.concat(F.lit("Patch "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("").alias("url"), contents.alias("contents"), (F.lit(1704067200) + F.col("doc_id") * 3600).alias("date"), F.lit("patch").alias("news_type"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; some have an embedding."""
    d, e = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings"))
    return d.join(e, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("app"), (F.col("doc_id") % 3).cast("string")).alias("app_id"), "text", "embedding",
        F.concat(F.lit("v"), (F.col("doc_id") % 5).cast("string")).alias("patch_version"), F.lit("General").alias("section"),
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, app_id, text): the rows of ``chunks``; no text is shuffled, as embeddings only say which chunks are there several times."""
    d, e = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings"))
    several = e.groupBy("vec_id").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    rows = d.join(F.broadcast(several), F.col("doc_id") == F.col("vec_id"), "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))))
    return rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("app"), (F.col("doc_id") % 3).cast("string")).alias("app_id"), "text")


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th vector with the whole text of its document."""
    c = chunks(spark, sf_dir).filter("embedding is not null and cast(chunk_id as bigint) % 25 = 0")
    return c.select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "app_id", F.col("text").alias("query_text"), "embedding", F.element_at(F.lit(params.CATEGORIES), (F.col("chunk_id").cast("bigint") % 10 + 1).cast("int")).alias("category"))


def assessments(hits: DataFrame) -> DataFrame:
    """One assessment a query: the hits of even rank are relevant, every seventh query has too few, every eleventh a confidence out of range."""
    n = F.substring("query_id", 2, 20).cast("bigint")
    rel = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") % 2 == 0, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"])
    return hits.groupBy("query_id").agg(rel.alias("relevant_ids")).select(
        "query_id", "relevant_ids", F.when(n % 7 == 0, False).when(n % 2 == 0, True).alias("is_sufficient"), F.when(n % 11 == 0, 1.5).otherwise(F.lit(0.25)).alias("confidence"), F.lit(0).alias("retries"), F.lit(True).alias("assessed")
    )
