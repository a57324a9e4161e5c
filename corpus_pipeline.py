"""The corpus pipeline: documents that are neither toxic nor without language, of near copies one, without
benchmark passages, as byte-level BPE tokens. Each stage works on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedmill.llm import decontaminate as overlap
from feedmill.llm import language_id, toxicity
from feedmill.llm.byte_bpe import encode_digests
from feedmill.llm.common import remove, row_of, shared_dir, table
from feedmill.llm.minhash_dedup import deduplicate
from feedmill.llm.queries import TOXIC_FROM, doc_fold, known_labels

#: A document whose best language is this far off (cosine) has none: three deviations of unrelated bundles, below
#: every clean text of the held-out fold.
LEAST_LANGUAGE_SCORE = 0.095


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the scorer learns from the labelled ones among ``docs``.

    Null and empty texts have the score of no terms and stay; rows that share an id or text are judged alike, each by
    itself; long texts are read whole; an empty table stays empty; columns of any name stay as they are.
    """
    machine = toxicity.train(docs, known_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs.select(row_of(docs).alias("row"), "text"), machine, passed=["row"])
    return scored.filter(F.col("score") < TOXIC_FROM).select("row.*")


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are in no known language; profiles are learned from ``docs`` that name theirs.

    Null texts and texts without letters go; rows without ``lang`` are judged like others; repeated rows repeat;
    long texts are read whole; an empty table stays empty; columns of any name stay as they are.
    """
    prototypes = language_id.train(docs.filter(doc_fold(3) != 1))
    found = language_id.predict(docs.select(row_of(docs).alias("row"), "text"), prototypes, passed=["row"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Documents without words are nobody's copies and stay; of rows that share an id one stays, rows without id all do;
    long texts are read whole; an empty table stays empty; columns of any name stay as they are.
    """
    return deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or a shorter item whole.

    Null and empty texts stay; repeated rows are judged alike; long texts are read whole; an empty table stays empty, an
    empty benchmark drops nothing; columns of any name stay as they are.
    """
    return overlap.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of tokens and the digests of ids and decoded bytes; a null text is an empty one, repeated
    rows repeat, long texts are read whole, an empty table stays empty, other columns are not read."""
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode),
]

#: The stages learn models and match near copies; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next; what two stages ago was written is then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            if before:
                remove(spark, before)
            docs, before = spark.read.schema(docs.schema).parquet(path), path
    return docs
