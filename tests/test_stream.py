import json

from feedmill.schemas import REVIEW
from feedmill.sources.tables import read_table
from feedmill.streaming.ingest import stream_reviews


def page(app, n, ids):
    one = lambda i: {"recommendationid": i, "review": f"review number {i} here", "voted_up": True, "timestamp_created": 0, "steam_purchase": True, "received_for_free": False, "author": {"steamid": "u", "playtime_forever": 60}}
    return json.dumps({"app_id": app, "page": n, "success": 1, "reviews": [one(i) for i in ids]})


def test_stream_is_idempotent(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    (src / "a.json").write_text(page("a", 0, ["1", "2", "1"]))
    (src / "b.json").write_text(page("a", 1, ["2", "3"]))
    run = lambda: stream_reviews(spark, str(src), table, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    run()
    ids = lambda: sorted(r.review_id for r in read_table(spark, table, REVIEW).collect())
    assert ids() == ["1", "2", "3"]
    (src / "c.json").write_text(page("a", 0, ["1", "2", "4", None]))  # a replayed page with one new review and one without id
    run()
    assert ids() == ["1", "2", "3", "4"]
