"""Explicit schemas (DDL) of the inputs and tables."""

RAW_REVIEW = (
    "struct<recommendationid: string, review: string, voted_up: boolean, timestamp_created: bigint, steam_purchase: boolean, "
    "received_for_free: boolean, votes_up: bigint, votes_funny: bigint, weighted_vote_score: string, "
    "author: struct<steamid: string, playtime_forever: bigint>>"
)
REVIEW_PAGE = f"app_id string, page int, success int, cursor string, reviews array<{RAW_REVIEW}>"
NEWS_ITEM = "struct<gid: string, appid: bigint, title: string, url: string, contents: string, date: bigint, feedname: string, feedlabel: string>"
NEWS_PAGE = f"app_id string, appnews struct<newsitems: array<{NEWS_ITEM}>>"
REVIEW = (
    "review_id string, app_id string, steam_id string, review_text string, voted_up boolean, timestamp timestamp, "
    "playtime_hours double, votes_up bigint, votes_funny bigint, weighted_vote_score double, is_near_duplicate boolean"
)
CLASSIFICATION = (
    "review_id string, app_id string, primary_category string, secondary_categories array<string>, confidence double, "
    "reasoning string, needs_review boolean, model_used string, classified_at timestamp"
)
RESPONSE = "struct<primary_category: string, secondary_categories: array<string>, confidence: string, reasoning: string>"
