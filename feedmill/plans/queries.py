"""The registered queries: each operator over the bench tables, by the adapters."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedmill import params
from feedmill.functions import labels as label_rules
from feedmill.functions import text as T
from feedmill.operators import blockmax, chunking, clusters, evidence, ivfpq, labels, neardup, neardup_index, news, retrieval, reviews, rollups, stats
from feedmill.plans import adapters as A
from feedmill.schemas import REVIEW
from feedmill.sources import pages, tables
from feedmill.sources.versioned import VersionedTable
from feedmill.storage import settle, shared_dir
from feedmill.streaming.ingest import stream_reviews
from feedmill.streaming.stateful import stream_reviews_stateful

AS_OF = "2024-03-31 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _text(*cols):
    return [F.array_join(F.col(c), ",").alias(c) for c in cols]


def _epoch(c="timestamp"):
    return F.unix_timestamp(c).alias("created")


# sources and sinks


def read_review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    A.review_pages(spark, sf_dir).write.json(path)
    rows = pages.raw_reviews(pages.read_review_pages(spark, path))
    return rows.select("app_id", "page", "pos", F.col("review.recommendationid").alias("review_id"), F.col("review.author.playtime_forever").alias("minutes"))


def news_pipeline(spark, sf_dir):
    items = pages.kept_news(A.news_items(spark, sf_dir).filter(F.col("feedname").isin(params.DEFAULT_FEED, "blog")))
    return items.select("app_id", "gid", "title", "feedname", "news_type")


def _stored(spark, sf_dir):
    r = A.reviews(spark, sf_dir)
    return r.filter("pos % 2 = 0"), r.unionByName(r.filter("pos % 10 = 1").withColumns({"pos": F.col("pos") + 100_000_000, "votes_up": F.lit(-1).cast("bigint")}))


def insert_or_ignore_reviews(spark, sf_dir):
    existing, batch = _stored(spark, sf_dir)
    new = tables.insert_or_ignore(tables.review_rows(batch), existing, ["review_id"], ["pos"])
    return new.select("review_id", "app_id", "voted_up", "votes_up", "playtime_hours", "is_near_duplicate", F.length("review_text").alias("n_chars"))


def insert_or_ignore_classifications(spark, sf_dir):
    stored = A.labels(spark, sf_dir)
    batch = tables.load_classifications(stored)
    new = tables.insert_or_ignore(tables.classification_rows(batch), stored.filter("pos % 3 = 0"), ["review_id"], ["pos"])
    return new.select("review_id", "app_id", "primary_category", "secondary_categories", "confidence", "needs_review")


def upsert_chunks(spark, sf_dir):
    old = A.chunks(spark, sf_dir).select("chunk_id", "app_id", "text", F.lit(0).alias("version"))
    new = old.filter("cast(chunk_id as bigint) % 3 = 0").withColumns({"text": F.concat(F.lit("v2 "), "text"), "version": F.lit(1)})
    extra = new.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))
    done = tables.upsert(new.unionByName(extra), old, ["chunk_id"], ["version"])
    return done.select("chunk_id", "app_id", "version", F.md5("text").alias("text_md5"))


def versioned_upsert_chunks(spark, sf_dir):
    """The merge of ``upsert_chunks`` in a versioned table, the new chunks put in twice, then its last version read."""
    old = A.chunks(spark, sf_dir).select("chunk_id", "app_id", "text", F.lit(0).alias("version"))
    new = old.filter("cast(chunk_id as bigint) % 3 = 0").withColumns({"text": F.concat(F.lit("v2 "), "text"), "version": F.lit(1)})
    extra = new.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))
    table = VersionedTable(spark, shared_dir(spark), "chunk_id string, app_id string, text string, version int", ["chunk_id"])
    table.append(old, ["version"])
    for _ in range(2):
        table.upsert(new.unionByName(extra), ["version"])
    return table.read().select("chunk_id", "app_id", "version", F.md5("text").alias("text_md5"))


def indexed_insert_reviews(spark, sf_dir):
    """The batch of ``insert_or_ignore_reviews`` merged into a versioned table by its Bloom index; the whole table is read."""
    existing, batch = _stored(spark, sf_dir)
    table = VersionedTable(spark, shared_dir(spark), f"{REVIEW}, pos bigint", ["review_id"])
    table.append(existing, ["pos"])
    table.insert_or_ignore(tables.review_rows(batch), ["pos"], ("batches", 0))
    table.insert_or_ignore(tables.review_rows(batch).limit(0), ["pos"], ("batches", 1))
    return table.read().select("review_id", "app_id", "voted_up", "votes_up", "playtime_hours", "is_near_duplicate", F.length("review_text").alias("n_chars"))


def load_reviews(spark, sf_dir):
    return tables.load_reviews(A.reviews(spark, sf_dir), "app1").select("review_id", "app_id", "voted_up", "playtime_hours")


def count_reviews(spark, sf_dir):
    return tables.count_reviews(A.reviews(spark, sf_dir))


def load_classifications(spark, sf_dir):
    return tables.load_classifications(A.labels(spark, sf_dir)).select("review_id", "primary_category", *_text("secondary_categories"), "confidence")


# projections and filters


def extract_review_fields(spark, sf_dir):
    d = reviews.extract_review_fields(A.raw_reviews(spark, sf_dir))
    return d.select("review_id", "app_id", "steam_id", "voted_up", _epoch(), "playtime_hours", "votes_up", "votes_funny", "weighted_vote_score", F.length("review_text").alias("n_chars"))


def clean_reviews(spark, sf_dir):
    return reviews.clean_reviews(reviews.extract_review_fields(A.raw_reviews(spark, sf_dir))).select("review_id", "app_id", "review_text")


def retrieval_gate(spark, sf_dir):
    return evidence.retrieval_gate(A.labels(spark, sf_dir)).select("review_id", "primary_category", "should_retrieve")


def sample_negative_reviews(spark, sf_dir):
    return reviews.sample_negatives(_classified(spark, sf_dir)).select("app_id", "primary_category", "review_id", "voted_up")


# joins


def unclassified_reviews(spark, sf_dir):
    return tables.unclassified_reviews(A.reviews(spark, sf_dir), A.labels(spark, sf_dir)).select("review_id", "app_id")


def _classified(spark, sf_dir):
    return tables.classified_reviews(A.reviews(spark, sf_dir), A.labels(spark, sf_dir))


def classified_reviews(spark, sf_dir):
    return _classified(spark, sf_dir).select("review_id", "app_id", "voted_up", _epoch(), "playtime_hours", "weighted_vote_score", "primary_category", *_text("secondary_categories"), "confidence", "needs_review")


def near_duplicate_pairs(spark, sf_dir):
    d = neardup.near_duplicate_pairs(A.reviews(spark, sf_dir))
    return d.select("app_id", "first", "second", F.round("similarity", 6).alias("similarity"))


def near_duplicate_flags(spark, sf_dir):
    return neardup.near_duplicate_flags(A.reviews(spark, sf_dir)).select("review_id", "app_id", "is_near_duplicate")


def near_duplicate_flags_banded(spark, sf_dir):
    """The flags without a list of pairs."""
    return neardup_index.flags_without_pairs(A.reviews(spark, sf_dir)).select("review_id", "app_id", "is_near_duplicate")


def near_duplicate_flags_incremental(spark, sf_dir):
    """The flags of three batches of reviews, each held against the representatives stored before it."""
    r = A.reviews(spark, sf_dir)
    step = F.lit((r.agg(F.max("pos")).first()[0] or 0) // 3 + 1)
    index, out = neardup_index.NearDuplicateIndex(spark, shared_dir(spark)), None
    for k in range(3):
        part = index.flags(r.filter(F.floor(F.col("pos") / step) == k), str(k)).select("review_id", "app_id", "is_near_duplicate")
        out = part if out is None else out.unionByName(part)
    return out


def clean_pipeline(spark, sf_dir):
    clean = reviews.clean_reviews(reviews.extract_review_fields(A.raw_reviews(spark, sf_dir)))
    return neardup.near_duplicate_flags(clean.withColumn("pos", F.col("pos").cast("bigint"))).select("review_id", "app_id", "is_near_duplicate")


def near_duplicate_lsh(spark, sf_dir):
    d = neardup.near_duplicate_pairs(A.reviews(spark, sf_dir), method="lsh")
    return d.select("app_id", "first", "second", F.round("similarity", 6).alias("similarity"))


def near_duplicate_members(spark, sf_dir):
    return neardup.near_duplicate_members(A.reviews(spark, sf_dir))


# retrieval


def bm25_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return d.select("item_id", F.array_join(T.bm25_tokens(F.col("text")), " ").alias("tokens"))


def bm25_chunk_tokens(spark, sf_dir):
    return A.chunks(spark, sf_dir).select("chunk_id", F.array_join(T.bm25_tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


def bm25_index_stats(spark, sf_dir):
    _, terms = retrieval.bm25_stats(A.chunks(spark, sf_dir))
    return terms.select("app_id", "term", "df", F.round("idf", 6).alias("idf"))


def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(A.chunks(spark, sf_dir), A.retrieval_queries(spark, sf_dir)).select("query_id", "app_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def vector_topk_quantised(spark, sf_dir):
    """Nearest chunks by the quantised index; approximate, so it has no SQL: recall is tested against ``vector_topk``."""
    index = ivfpq.build_index(A.chunks(spark, sf_dir))
    return ivfpq.search(index, A.retrieval_queries(spark, sf_dir)).select("query_id", "app_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def bm25_topk_postings(spark, sf_dir):
    """The same top k by all postings of the queries' terms."""
    return retrieval.bm25_topk(A.chunk_texts(spark, sf_dir), A.retrieval_queries(spark, sf_dir)).select("query_id", "app_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark, sf_dir):
    return blockmax.search(blockmax.build_index(A.chunk_texts(spark, sf_dir)), A.retrieval_queries(spark, sf_dir)).select("query_id", "app_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _lists(spark, sf_dir):
    c, q = A.chunks(spark, sf_dir), A.retrieval_queries(spark, sf_dir)
    return settle(retrieval.vector_topk(c, q)), settle(retrieval.bm25_topk(c, q))


def rrf_fusion(spark, sf_dir):
    return retrieval.rrf_fusion(*_lists(spark, sf_dir)).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), *_text("retrievers"), "rank")


def rrf_fusion_early(spark, sf_dir):
    """The same fused lists, read from the top as far as they can change them."""
    return retrieval.rrf_fusion_early(*_lists(spark, sf_dir), first=4).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), *_text("retrievers"), "rank")


def retriever_overlap(spark, sf_dir):
    return retrieval.retriever_overlap(*_lists(spark, sf_dir))


def rerank_topn(spark, sf_dir):
    fused = retrieval.rrf_fusion(*_lists(spark, sf_dir))
    d = retrieval.rerank(fused, A.retrieval_queries(spark, sf_dir), A.chunks(spark, sf_dir))
    return d.select("query_id", "chunk_id", F.round("relevance_score", 6).alias("relevance_score"), "rank")


def _hits(spark, sf_dir):
    c = A.chunks(spark, sf_dir)
    found = settle(retrieval.hybrid_retrieve(c, A.retrieval_queries(spark, sf_dir)))
    return found.join(c.select("app_id", "chunk_id", "patch_version", "section"), ["app_id", "chunk_id"])


def hybrid_retrieve(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "app_id", "chunk_id", "rank", "patch_version", F.round("rrf_score", 6).alias("rrf_score"))


def _packages(spark, sf_dir):
    hits = settle(_hits(spark, sf_dir))
    return evidence.evidence_packages(A.retrieval_queries(spark, sf_dir), hits, A.assessments(hits))


def evidence_packages(spark, sf_dir):
    d = _packages(spark, sf_dir)
    return d.select("query_id", "retrieval_decision", "retrieval_reasoning", "confidence", *_text("relevant_ids", "source_ids", "sources"), "valid")


def citation_audit(spark, sf_dir):
    packages = _packages(spark, sf_dir)
    drafts = packages.select("query_id", F.slice("source_ids", 1, 2).alias("cited_ids"))
    return evidence.citation_audit(drafts, packages).select("query_id", *_text("unsupported"), "supported")


def evidence_prompts(spark, sf_dir):
    return evidence.evidence_prompts(_hits(spark, sf_dir), A.retrieval_queries(spark, sf_dir)).select("query_id", F.md5("prompt").alias("prompt_md5"))


def source_prompts(spark, sf_dir):
    hits = settle(_hits(spark, sf_dir))
    packages = evidence.evidence_packages(A.retrieval_queries(spark, sf_dir), hits, A.assessments(hits))
    return evidence.source_prompts(packages, hits).select("query_id", F.md5("prompt").alias("prompt_md5"))


def encode_chunks(spark, sf_dir):
    """The chunks with vectors of an encoder that only measures them: characters and spaces."""

    @F.pandas_udf("array<float>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [float(len(t)), float(t.count(" "))])

    d = retrieval.encode_chunks(A.chunks(spark, sf_dir).drop("embedding"), measure)
    return d.select("chunk_id", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"))


# statistics and clusters


def basic_stats(spark, sf_dir):
    return stats.basic_stats(A.reviews(spark, sf_dir))


def keyword_frequency(spark, sf_dir):
    return stats.keyword_frequency(A.reviews(spark, sf_dir))


def keywords_first_seen(spark, sf_dir):
    return stats.keyword_frequency(A.reviews(spark, sf_dir), order_col="pos")


def _clustered(spark, sf_dir):
    return _classified(spark, sf_dir).withColumnRenamed("primary_category", "category")


def keywords_by_category(spark, sf_dir):
    return stats.keywords_by(_clustered(spark, sf_dir), ["app_id", "category"])


def build_clusters(spark, sf_dir):
    d = clusters.build_clusters(_clustered(spark, sf_dir), _as_of())
    return d.select("app_id", "category", "total_reviews", "recent_reviews", "prior_reviews", "velocity_ratio", "negative_pct", "avg_playtime_hours", *_text("top_keywords"), F.md5(F.array_join("sample_reviews", "|")).alias("samples_md5"))


def rolling_clusters(spark, sf_dir):
    """The clusters at two days from a rollup: the reviews come in two batches, with the second more that a third takes out again."""
    d = _clustered(spark, sf_dir)
    odd = F.col("review_id").cast("bigint") % 2 == 1
    more = d.filter(odd).withColumns({"review_id": F.concat(F.lit("again"), "review_id"), "review_text": F.concat(F.lit("once more "), "review_text")})
    rollup = rollups.ClusterRollup(spark, shared_dir(spark))
    rollup.commit("1", d.filter(~odd))
    rollup.commit("2", d.filter(odd).unionByName(more))
    rollup.commit("3", deleted=more)
    got = rollup.clusters([datetime.date(2024, 3, 31), datetime.date(2024, 2, 29)], d)
    return got.select(F.col("as_of").cast("string").alias("as_of"), "app_id", "category", "total_reviews", "recent_reviews", "prior_reviews", "velocity_ratio", "negative_pct", "avg_playtime_hours", *_text("top_keywords"), F.md5(F.array_join("sample_reviews", "|")).alias("samples_md5"))


def sketched_periods(spark, sf_dir):
    """Median hours of each app and month from merged day sketches; ``close`` is whether 0.02 of rank or less is between them and the exact median."""
    d = A.reviews(spark, sf_dir)
    month = lambda c: F.date_format(c, "yyyy-MM")
    got = rollups.sketched(rollups.fold_sketches(rollups.day_sketches(d).withColumn("month", month("day")), "month"))
    both = d.select("app_id", month("timestamp").alias("month"), "playtime_hours").join(got, ["app_id", "month"])
    v = F.col("quantiles")[0]
    return both.groupBy("app_id", "month").agg(F.max("n").alias("n_reviews"), ((F.avg((F.col("playtime_hours") < v).cast("int")) <= 0.52) & (F.avg((F.col("playtime_hours") <= v).cast("int")) >= 0.48)).alias("close"))


def rank_clusters(spark, sf_dir):
    return clusters.rank_clusters(clusters.cluster_metrics(_clustered(spark, sf_dir), _as_of()))


def event_clusters(spark, sf_dir):
    """The same metrics over events with real times: the type as category, the value as hours, a window of ten days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = e.select(F.lit("all").alias("app_id"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("user_id") % 3 != 0).alias("voted_up"), F.round(F.col("value"), 1).alias("playtime_hours"))
    return clusters.rank_clusters(clusters.cluster_metrics(d, F.lit("2024-01-31 00:00:00").cast("timestamp"), window_days=10))


def cluster_prompts(spark, sf_dir):
    ranked = clusters.rank_clusters(clusters.build_clusters(_clustered(spark, sf_dir), _as_of()))
    return clusters.cluster_prompts(ranked).select("app_id", "category", F.md5("prompt").alias("prompt_md5"))


def negative_review_listing(spark, sf_dir):
    return reviews.negative_listing(_classified(spark, sf_dir))


def token_usage_rollup(spark, sf_dir):
    return stats.token_usage(A.view(spark, sf_dir, A.TOKEN_LOG))


# news


def _typed(spark, sf_dir):
    return news.dedup_by_title(A.news_items(spark, sf_dir)).withColumn("news_type", T.news_type(F.col("title"), F.col("contents")))


def dedup_news_by_title(spark, sf_dir):
    return news.dedup_by_title(A.news_items(spark, sf_dir)).select("app_id", "gid", "title", "date")


def classify_news_type(spark, sf_dir):
    return A.news_items(spark, sf_dir).select("gid", T.news_type(F.col("title"), F.col("contents")).alias("news_type"))


def news_type_counts(spark, sf_dir):
    return news.news_type_counts(_typed(spark, sf_dir))


def feed_distribution(spark, sf_dir):
    return news.feed_distribution(pages.kept_news(A.news_items(spark, sf_dir)))


def strip_markup(spark, sf_dir):
    return A.notes(spark, sf_dir).select("gid", F.md5(T.strip_markup(F.col("contents"))).alias("text_md5"))


def extract_image_urls(spark, sf_dir):
    return A.notes(spark, sf_dir).select("gid", F.array_join(T.image_urls(F.col("contents")), ",").alias("urls"))


def section_headers(spark, sf_dir):
    return chunking.section_headers(A.notes(spark, sf_dir)).select("gid", "line_no", "section")


def chunk_news(spark, sf_dir):
    return chunking.chunk_news(A.notes(spark, sf_dir)).select("chunk_id", "section", "patch_version", "patch_date", "app_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def split_long_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(T.split_long(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("Patch | General: "))).alias("seg", "body"))
    return d.select("doc_id", "seg", F.md5("body").alias("body_md5"))


# labels


def validate_classifications(spark, sf_dir):
    d = label_rules.validate_responses(A.view(spark, sf_dir, A.RESPONSES))
    return d.select("review_id", "valid", "error", "primary_category", *_text("secondary_categories"), "confidence", "reasoning", "needs_review")


def classification_run_summary(spark, sf_dir):
    """A run over the backlog that stops after 40 successes of each app."""
    backlog = tables.unclassified_reviews(A.reviews(spark, sf_dir), A.labels(spark, sf_dir)).select("review_id", "app_id", "pos")
    judged = label_rules.validate_responses(A.view(spark, sf_dir, A.RESPONSES)).select("review_id", "valid")
    return labels.run_summary(labels.run_outcomes(backlog.join(judged, "review_id"), limit=40))


def normalize_tones(spark, sf_dir):
    return A.view(spark, sf_dir, A.TONE_RESPONSES).select("review_id", label_rules.tone(F.col("response_text")).alias("tone"))


def extract_summaries(spark, sf_dir):
    return A.view(spark, sf_dir, A.SUMMARY_RESPONSES).select("doc_id", F.md5(T.summary_text(F.col("response_text"))).alias("summary_md5"))


# streaming


def _land(spark, sf_dir, landed):
    """Four files of landed pages, or as many as keep a file at 100,000 reviews."""
    n = max(4, -(-A.reviews(spark, sf_dir).count() // 100_000))
    A.review_pages(spark, sf_dir).repartition(n, "app_id", "page").write.json(landed)


def stream_ingest_reviews(spark, sf_dir):
    """The landed pages streamed into an empty table, then the table read."""
    landed, table = shared_dir(spark), shared_dir(spark)
    _land(spark, sf_dir, landed)
    stream_reviews(spark, landed, table, shared_dir(spark), files_per_batch=2).awaitTermination()
    d = tables.read_table(spark, table, REVIEW)
    return d.select("review_id", "app_id", "voted_up", "playtime_hours", "votes_up", F.length("review_text").alias("n_chars"))


def stateful_ingest_reviews(spark, sf_dir):
    """The landed pages streamed through a keyed state store into an empty versioned table, then the table read."""
    landed = shared_dir(spark)
    _land(spark, sf_dir, landed)
    table = VersionedTable(spark, shared_dir(spark), REVIEW, ["review_id"])
    stream_reviews_stateful(spark, landed, table, shared_dir(spark), files_per_batch=2).awaitTermination()
    return table.read().select("review_id", "app_id", "voted_up", "playtime_hours", "votes_up", F.length("review_text").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_clusters, read_review_pages, news_pipeline, insert_or_ignore_reviews, insert_or_ignore_classifications, upsert_chunks, load_reviews, count_reviews, load_classifications,
        extract_review_fields, clean_reviews, retrieval_gate, sample_negative_reviews, unclassified_reviews, classified_reviews, near_duplicate_pairs, near_duplicate_flags, near_duplicate_lsh, near_duplicate_members,
        clean_pipeline, bm25_tokens, bm25_chunk_tokens, bm25_index_stats, vector_topk, bm25_topk, rrf_fusion, retriever_overlap, rerank_topn, hybrid_retrieve, evidence_packages, citation_audit, evidence_prompts, source_prompts, encode_chunks,
        basic_stats, keyword_frequency, keywords_first_seen, keywords_by_category, build_clusters, event_clusters, cluster_prompts, negative_review_listing, token_usage_rollup, dedup_news_by_title, classify_news_type,
        news_type_counts, feed_distribution, strip_markup, extract_image_urls, section_headers, chunk_news, split_long_text, validate_classifications, classification_run_summary, normalize_tones,
        extract_summaries, stream_ingest_reviews, versioned_upsert_chunks, indexed_insert_reviews, stateful_ingest_reviews, near_duplicate_flags_banded, near_duplicate_flags_incremental, bm25_topk_postings, vector_topk_quantised, rolling_clusters, sketched_periods, rrf_fusion_early,
    )
}
