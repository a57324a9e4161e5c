"""Checks of label responses: model output as text in, validated columns out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedmill import params
from feedmill.functions.text import trim_white
from feedmill.schemas import RESPONSE


def strip_fence(text: Column) -> Column:
    """Text that starts with three backticks without its first and last line."""
    lines = F.split(text, "\n")
    inner = trim_white(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    return F.when(text.startswith("```"), inner).otherwise(text)


@F.pandas_udf(T.BooleanType())
def is_json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text as a whole is one JSON object; the built-in parsers accept text after the value."""

    def strict(text) -> bool:
        try:
            return isinstance(json.loads(text), dict)
        except (TypeError, ValueError, RecursionError):
            return False

    for batch in texts:
        yield batch.map(strict).astype(bool)


def validate_responses(responses: DataFrame, threshold: float = params.CONFIDENCE) -> DataFrame:
    """``responses`` (review_id, response_text, optional stop_reason, ...) with the label columns, ``valid`` and ``error``.

    error names the first rule that fails: refusal, empty, json, primary, secondary, confidence, reasoning. The
    primary category is taken out of the secondary ones. Label columns are null where the response is not valid.
    """
    raw = trim_white(F.coalesce("response_text", F.lit("")))
    body = strip_fence(raw)
    stop = F.col("stop_reason") if "stop_reason" in responses.columns else F.lit(None).cast("string")
    d = responses.withColumns({"__raw": raw, "__body": body}).withColumn("__r", F.from_json("__body", RESPONSE)).withColumn("__ok", is_json_object(F.col("__body")))
    r = F.col("__r")
    known = lambda c: F.coalesce(c.isin(params.CATEGORIES), F.lit(False))
    second = F.coalesce(r["secondary_categories"], F.array().cast("array<string>"))
    number = F.expr("try_cast(__r.confidence as double)")
    error = (
        F.when(F.coalesce(stop == "refusal", F.lit(False)), "refusal").when(F.col("__raw") == "", "empty").when(~F.col("__ok") | r.isNull(), "json")
        .when(~known(r["primary_category"]), "primary").when(~F.forall(second, lambda c: known(c) & (c != "other")), "secondary")
        .when(number.isNull() | F.isnan(number) | ~number.between(0.0, 1.0), "confidence").when(F.coalesce(F.length(r["reasoning"]), F.lit(0)) < 10, "reasoning")
    )
    d = d.withColumn("error", error).withColumn("valid", F.col("error").isNull())
    only = lambda c: F.when(F.col("valid"), c)
    d = d.withColumns({
        "primary_category": only(r["primary_category"]), "secondary_categories": only(F.filter(second, lambda c: c != r["primary_category"])),
        "confidence": only(number), "reasoning": only(r["reasoning"]), "needs_review": only(number < threshold),
    })
    return d.drop("__raw", "__body", "__r", "__ok")


def tone(text: Column) -> Column:
    """The tone that a response names; neutral for anything else. Text after the first JSON value is passed over."""
    named = F.get_json_object(strip_fence(trim_white(F.coalesce(text, F.lit("")))), "$.tone")
    return F.when(named.isin(params.TONES), named).otherwise("neutral")
