from pyspark.sql import functions as F

from feedmill.operators import chunking, news
from feedmill.sources import pages

ITEM = "app_id string, gid string, pos int, title string, url string, contents string, date bigint, feedname string, feedlabel string, news_type string"


def item(gid="g1", title="Patch 1.3.2 — Hotfix", contents="", date=0, pos=0, feed="f"):
    return ("a", gid, pos, title, "u", contents, date, feed, None, "patch")


def chunks(spark, *items):
    return chunking.chunk_news(spark.createDataFrame(list(items), ITEM)).orderBy("chunk_id").collect()


def test_chunks(spark):
    c = "[b]Bug Fixes[/b]\n[list]\n[*] Fixed a crash in the second dungeon\n[/list]\n[ SOUND ]\n- Fixed music\n- Tuned footsteps volume\n- tiny\nhttps://example.com/x"
    got = chunks(spark, item(contents=c))
    assert [(r.chunk_id, r.section, r.text) for r in got] == [
        ("g1-0", "Bug Fixes", "Patch 1.3.2 — Hotfix | Bug Fixes: Fixed a crash in the second dungeon"), ("g1-1", "SOUND", "Patch 1.3.2 — Hotfix | SOUND: Fixed music"), ("g1-2", "SOUND", "Patch 1.3.2 — Hotfix | SOUND: Tuned footsteps volume"),
    ]
    assert got[0].patch_date == "1970-01-01" and got[0].image_urls == []


def test_chunk_edges(spark):
    forty, more = "a" * 38 + ",1", "a" * 39 + ",1"
    got = chunks(spark, item(contents=f"{forty}\n{more}\n- 1.5x damage for all bows"))
    assert [r.text.split(": ", 1)[1] for r in got] == [more, "5x damage for all bows"] and got[0].section == "General"
    got = chunks(spark, item(title=" # ", contents="\nFirst line 1.0\n- a change that matters"))
    assert got[0].patch_version == "First line 1.0"
    assert chunks(spark, item(title=None, contents=None)) == []
    long = " ".join(f"Sentence {i} says, something." for i in range(40))
    got = chunks(spark, item(contents=long))
    assert len(got) > 1 and all(len(r.text) <= 500 for r in got)
    assert " ".join(r.text.split(": ", 1)[1] for r in sorted(got, key=lambda r: int(r.chunk_id[3:]))) == long


def test_items_that_share_an_id_are_cut_each_by_itself(spark):
    sound, plain = "- one change of ten\n[ SOUND ]\n- another change here", "- a third change for all\n- a fourth change for all"
    for gid, name in ((None, "unknown"), ("g", "g")):
        got = chunks(spark, item(gid, title="A", contents=sound), item(gid, title="B", contents=plain), item(gid, title="B", contents=plain))
        assert sorted((r.text, r.chunk_id) for r in got) == [
            ("A | General: one change of ten", f"{name}-0"), ("A | SOUND: another change here", f"{name}-1"),
            ("B | General: a fourth change for all", f"{name}-1"), ("B | General: a fourth change for all", f"{name}-1"), ("B | General: a third change for all", f"{name}-0"), ("B | General: a third change for all", f"{name}-0"),
        ]


def test_chunking_has_no_shuffle_and_takes_many_lines(spark):
    d = spark.createDataFrame([item(contents="\n".join(f"- change number {i} of many" if i % 7 else "Bug Fixes" for i in range(20_000)))], ITEM)
    plan = chunking.chunk_news(d)
    assert plan.count() == 20_000 - len(range(0, 20_000, 7)) and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_title_dedup(spark):
    rows = [item("1", " Patch A ", date=5), item("2", "patch a", date=9, pos=1), item("3", "Patch A", date=None, pos=2), item("4", None, date=1, pos=3)]
    d = news.dedup_by_title(spark.createDataFrame(rows, ITEM))
    assert sorted(r.gid for r in d.collect()) == ["2", "4"]
    tie = news.dedup_by_title(spark.createDataFrame([item("1", "x", date=1, pos=1), item("2", "X", date=1, pos=0)], ITEM))
    assert [r.gid for r in tie.collect()] == ["2"]


def test_news_pages(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"app_id": "a", "appnews": {"newsitems": [{"gid": "1", "title": "Patch 1", "feedname": "f"}, {"gid": "2", "title": "Free weekend", "feedname": "f"}, {"gid": "3", "title": "Other", "feedname": "g"}]}}\n{"app_id": "b"}')
    items = pages.news_items(pages.read_news_pages(spark, str(tmp_path)), ["f"])
    assert [(r.gid, r.news_type) for r in pages.kept_news(items).collect()] == [("1", "patch")]


def test_counts(spark):
    d = spark.createDataFrame([item("1"), item("2", feed=None)], ITEM)
    r = news.news_type_counts(d).first()
    assert (r.patch, r.content_update, r.event) == (2, 0, 0)
    assert {(r.kind, r.value, r.n) for r in news.feed_distribution(d).collect()} == {("feedname", "f", 1), ("feedname", "<missing>", 1), ("feedlabel", "<missing>", 2)}
    assert chunking.section_headers(d.withColumn("contents", F.lit("Bug Fixes\n- x"))).filter("gid = '1'").first().section == "Bug Fixes"
