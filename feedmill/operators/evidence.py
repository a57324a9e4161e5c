"""Evidence packages: retrieval gate, decisions, cited sources, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedmill import params
from feedmill.functions.text import two_places


def retrieval_gate(reviews: DataFrame) -> DataFrame:
    """``reviews`` with ``should_retrieve``: whether release notes are expected to help their category."""
    return reviews.withColumn("should_retrieve", F.coalesce(F.col("primary_category").isin(params.RETRIEVAL_CATEGORIES), F.lit(False)))


def evidence_packages(queries: DataFrame, hits: DataFrame, assessments: DataFrame) -> DataFrame:
    """One package a query (query_id, category): sources are the hits that the assessment calls relevant, in hit order.

    skipped: the category needs no retrieval. insufficient: no assessment came, its confidence is out of 0..1
    (then ``valid`` is false), it names no relevant hit or says that they do not suffice (missing: they do).
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    found = hits.groupBy("query_id").agg(ordered("chunk_id").alias("source_ids"))
    d = retrieval_gate(queries.withColumnRenamed("category", "primary_category")).join(found, "query_id", "left").join(assessments, "query_id", "left")
    none = F.array().cast("array<string>")
    relevant, enough, confidence = F.coalesce("relevant_ids", none), F.coalesce("is_sufficient", F.lit(True)), F.coalesce("confidence", F.lit(0.0))
    answered, valid = F.col("assessed").isNotNull(), confidence.between(0.0, 1.0)
    ids = F.coalesce("source_ids", none)
    sources = F.filter(ids, lambda c: F.array_contains(relevant, c))
    used = F.col("should_retrieve") & answered & valid
    decision = F.when(~F.col("should_retrieve"), "skipped").when(used & (F.size(relevant) > 0) & enough, "retrieved").otherwise("insufficient")
    attempts = F.coalesce("retries", F.lit(0)) + 1
    why = (
        F.when(~F.col("should_retrieve"), F.concat(F.lit("Category '"), F.coalesce("primary_category", F.lit("")), F.lit("' needs no retrieval")))
        .when(~answered, "Retrieval or assessment failed").when(~valid, "Confidence out of range")
        .when(enough, F.format_string("Retrieved %d relevant chunks with confidence %.2f", F.size(sources), two_places(confidence))).otherwise(F.format_string("Evidence insufficient after %d retrieval attempts", attempts))
    )
    return d.select(
        "query_id", decision.alias("retrieval_decision"), why.alias("retrieval_reasoning"), F.when(used, confidence).otherwise(0.0).alias("confidence"), F.when(used, relevant).otherwise(none).alias("relevant_ids"),
        F.when(used, ids).otherwise(none).alias("source_ids"), F.when(used, sources).otherwise(none).alias("sources"), (~answered | valid).alias("valid"),
    )


def citation_audit(drafts: DataFrame, packages: DataFrame) -> DataFrame:
    """Per draft (query_id, cited_ids) the cited ids that its package does not call relevant, sorted, and whether there are none."""
    d = drafts.join(packages.select("query_id", "relevant_ids"), "query_id", "left")
    none = F.array().cast("array<string>")
    bad = F.array_sort(F.array_except(F.coalesce("cited_ids", none), F.coalesce("relevant_ids", none)))
    return d.select("query_id", bad.alias("unsupported"), (F.size(bad) == 0).alias("supported"))


#: What stands for no hits and for no sources.
NO_CHUNKS = "(no chunks retrieved — retrieval returned empty results)"
NO_SOURCES = "<evidence_sources>No relevant sources retrieved.</evidence_sources>"


def _numbered(scored: bool):
    """An aggregate: the hits of a group in rank order, numbered from 0, with version and section (and relevance), each followed by
    the quoted text."""
    head = F.concat(
        F.lit("] chunk_id="), F.coalesce("chunk_id", F.lit("unknown")), F.lit(" version="), F.coalesce("patch_version", F.lit("unknown")), F.lit(" section="), F.coalesce("section", F.lit("unknown")),
        *([F.format_string(" relevance=%.2f", two_places(F.coalesce("relevance_score", F.lit(0.0))))] if scored else []),
    )
    line = F.concat(head, F.lit('\n    "'), F.coalesce("text", F.lit("")), F.lit('"'))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("["), i.cast("string"), x["line"])), "\n")


def evidence_prompts(hits: DataFrame, queries: DataFrame | None = None, scored: bool = True) -> DataFrame:
    """Per query its hits as numbered lines. With ``queries`` (query_id) each of them has a row; one without hits says so."""
    found = hits.groupBy("query_id").agg(_numbered(scored).alias("prompt"))
    if queries is None:
        return found
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("prompt", F.lit(NO_CHUNKS)).alias("prompt"))


def source_prompts(packages: DataFrame, hits: DataFrame) -> DataFrame:
    """Per package its relevant sources, numbered from 0 in hit order, in an ``evidence_sources`` element; one without sources says so."""
    used = packages.select("query_id", F.explode("sources").alias("chunk_id")).join(hits, ["query_id", "chunk_id"])
    found = used.groupBy("query_id").agg(_numbered(False).alias("lines"))
    text = F.concat(F.lit("<evidence_sources>\n"), "lines", F.lit("\n</evidence_sources>"))
    return packages.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce(text, F.lit(NO_SOURCES)).alias("prompt"))
