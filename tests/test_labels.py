import json

import pytest
from pyspark.sql import functions as F

from feedmill.functions.labels import tone, validate_responses
from feedmill.operators.labels import run_outcomes, run_summary

GOOD = {"primary_category": "technical_issues", "secondary_categories": ["ui_controls"], "confidence": 0.92, "reasoning": "it does not start"}


def check(spark, text, stop=None):
    d = spark.createDataFrame([("1", text, stop)], "review_id string, response_text string, stop_reason string")
    return validate_responses(d).first()


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None), ({"primary_category": "fun"}, "primary"), ({"primary_category": None}, "primary"), ({"secondary_categories": ["other"]}, "secondary"), ({"secondary_categories": ["technical_issues"]}, None),
        ({"confidence": 1.2}, "confidence"), ({"confidence": "0.9"}, None), ({"confidence": "high"}, "confidence"), ({"reasoning": "too short"}, "reasoning"), ({"secondary_categories": None}, None),
    ],
)
def test_rules(spark, change, error):
    r = check(spark, json.dumps({**GOOD, **change}))
    assert r.error == error and r.valid == (error is None)
    if change.get("secondary_categories") == ["technical_issues"]:
        assert r.secondary_categories == []


def test_texts(spark):
    good = json.dumps(GOOD)
    assert check(spark, f"```json\n{good}\n```").valid and check(spark, f"  {good}\n").valid
    assert check(spark, good + " so it is").error == "json" and check(spark, "[]").error == "json" and check(spark, "").error == "empty" and check(spark, None).error == "empty"
    assert check(spark, good, "refusal").error == "refusal"
    assert check(spark, json.dumps({**GOOD, "confidence": 0.6})).needs_review is True


@pytest.mark.parametrize("text, expected", [('{"tone": "angry"}', "angry"), ('```\n{"tone": "angry"}\n```', "angry"), ('{"tone": "angry"} as I see it', "angry"), ('{"tone": "happy"}', "neutral"), ("angry", "neutral"), ("{}", "neutral"), (None, "neutral")])
def test_tone(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(tone(F.col("t"))).first()[0] == expected


def test_run_limit(spark):
    d = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, True, True])], "app_id string, pos bigint, valid boolean")
    one = lambda limit: [tuple(r)[1:] for r in run_summary(run_outcomes(d, limit)).collect()]
    assert one(2) == [(3, 2, 1)] and one(None) == [(4, 3, 1)] and one(0) == [] and one(9) == [(4, 3, 1)]
    many = spark.range(1000).select(F.lit("a").alias("app_id"), F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("valid"))
    assert run_summary(run_outcomes(many, 100)).first()[1:] == (298, 100, 198)
