"""Versioned tables: atomic merges, concurrent and killed writers, files passed over by the index; the stateful stream over them."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from feedmill.operators.reviews import clean_reviews, extract_review_fields
from feedmill.schemas import REVIEW
from feedmill.sources import pages as landed
from feedmill.sources import versioned
from feedmill.sources.versioned import VersionedTable
from feedmill.storage import names_in, publish, read_text
from feedmill.streaming.stateful import stream_reviews_stateful
from tests.test_stream import page

ROW = "id string, app_id string, v int, n int"


def table(spark, path, buckets=2):
    return VersionedTable(spark, str(path), ROW, ["id"], buckets)


def batch(spark, rows):
    return spark.createDataFrame(rows, ROW)


def content(t, **kw):
    return sorted(tuple(r) for r in t.read(**kw).collect())


def test_publish_is_exclusive(spark, tmp_path):
    path = str(tmp_path / "v" / "1")
    assert publish(spark, path, "first ä") and not publish(spark, path, "second")
    assert read_text(spark, path) == "first ä" and names_in(spark, str(tmp_path / "v")) == ["1"] and names_in(spark, str(tmp_path / "none")) == []


def test_merges_and_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert content(t) == []
    t.insert_or_ignore(batch(spark, [("1", "a", 1, 0), ("2", "a", 1, 1), ("2", "a", 9, 2), ("3", "b b/%", 1, 3), (None, "a", 1, 4), ("4", None, 1, 5)]), ["n"])
    first = [("1", "a", 1, 0), ("2", "a", 1, 1), ("3", "b b/%", 1, 3)]
    assert content(t) == first
    t.upsert(batch(spark, [("2", "a", 2, 6), ("2", "a", 3, 7), ("5", "a", 1, 8), (None, "a", 1, 9)]), ["n"])
    second = [("1", "a", 1, 0), ("2", "a", 3, 7), ("3", "b b/%", 1, 3), ("5", "a", 1, 8)]
    assert content(t) == second and content(t, version=1) == first and content(t, app_id="b b/%") == first[2:]
    t.insert_or_ignore(batch(spark, [("2", "a", 0, 0), ("6", "c", 1, 1)]), ["n"])
    t.insert_or_ignore(batch(spark, []), ["n"])
    assert content(t) == second + [("6", "c", 1, 1)]
    for k in range(3):  # a replay changes nothing
        t.upsert(batch(spark, [("2", "a", 3, 7)]), ["n"])
    assert content(t) == second + [("6", "c", 1, 1)]


def test_numbered_batches_are_applied_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for number in (0, 1, 0, 1):
        t.append(batch(spark, [(f"x{number}", "a", 1, 0)]), ["n"], ("s", number))
    assert [r[0] for r in content(t)] == ["x0", "x1"]


def test_killed_writer_leaves_whole_versions(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.insert_or_ignore(batch(spark, [("1", "a", 1, 0)]), ["n"])

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versioned, "publish", killed)
    with pytest.raises(KeyboardInterrupt):  # all is written but the pointer
        t.upsert(batch(spark, [("1", "a", 2, 0), ("2", "a", 2, 0)]), ["n"])
    monkeypatch.undo()
    assert content(t) == [("1", "a", 1, 0)]
    t.upsert(batch(spark, [("1", "a", 3, 0)]), ["n"])
    assert content(t) == [("1", "a", 3, 0)] and t.versions() == [1, 2]


def test_two_writers(spark, tmp_path):
    """Both start from the same version; the later merges again on the other's, so no row of either is lost."""
    path = tmp_path / "t"
    table(spark, path).insert_or_ignore(batch(spark, [("1", "a", 0, 0)]), ["n"])
    gate, failed = threading.Barrier(2, timeout=60), []

    class Meeting(VersionedTable):
        met = False

        def _commit(self, *args):
            if not self.met:
                self.met = True
                gate.wait()
            return super()._commit(*args)

    def write(k):
        try:
            Meeting(spark, str(path), ROW, ["id"], 2).upsert(batch(spark, [(f"w{k}", "a", k, k), ("1", "a", k, k)]), ["n"])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert not failed
    got = content(table(spark, path))
    assert [r[0] for r in got] == ["1", "w1", "w2"] and got[0][2] in (1, 2) and table(spark, path).versions() == [1, 2, 3]


def test_index_passes_files_over(spark, tmp_path):
    """Files without any key of the batch are not opened; the result equals an anti-join with all rows."""
    t = VersionedTable(spark, str(tmp_path / "t"), ROW, ["id"], 1)
    rows = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("a").alias("app_id"), F.lit(1).alias("v"), F.col("id").cast("int").alias("n"))
    for k in range(8):
        t.append(rows.filter(F.col("n") % 8 == k), ["n"])
    new = rows.filter("n < 20").withColumn("id", F.concat(F.lit("new"), "id"))
    t.insert_or_ignore(new.filter("n < 10"), ["n"])
    assert t.opened <= 3 and t.opened + t.passed == 8
    t.insert_or_ignore(new.unionByName(rows.filter("n in (3, 11)")), ["n"])  # both in one file, one key each
    assert 1 <= t.opened - 1 <= 4 and t.opened + t.passed == 9
    assert t.read().count() == 40_020 and t.read().select("id").distinct().count() == 40_020
    t.compact()
    assert t.read().count() == 40_020 and t._manifest(t._pointer()).select("file").distinct().count() <= 4
    t.expire(1)
    assert t.read().count() == 40_020 and len(t.versions()) == 1


def test_texts_are_shuffled_once(spark, tmp_path):
    """A merge shuffles its batch once; files that lose all their rows or none are not rewritten."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executorSummary("driver").totalShuffleWrite()

    t = VersionedTable(spark, str(tmp_path / "t"), "id string, app_id string, text string, version int", ["id"], 2)
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 512) for k in range(12)])
    rows = spark.range(4_000).select(F.concat(F.lit("k"), "id").alias("id"), F.concat(F.lit("a"), (F.col("id") % 2).cast("string")).alias("app_id"), text.alias("text"), F.lit(0).alias("version"))
    before = shuffled()
    t.append(rows, ["version"])
    t.upsert(rows.withColumn("version", F.lit(1)), ["version"])
    size = sum(p.stat().st_size for p in (tmp_path / "t" / "data").rglob("*.parquet")) / 2
    assert shuffled() - before < 2.6 * size
    assert t.read().groupBy("version").count().collect() == [(1, 4_000)] and t.opened == len({r.file for r in t._manifest(t._pointer(1)).collect()})
    files = lambda app: {r.file for r in t._manifest(t._pointer()).filter(F.col("app_id") == app).collect()}
    other, own = files("a1"), files("a0")
    t.upsert(rows.filter("id = 'k8'").withColumn("version", F.lit(2)), ["version"])  # all but one row of a file stay
    assert files("a1") == other and len(own - files("a0")) == 1
    assert {tuple(r) for r in t.read().groupBy("version").count().collect()} == {(1, 3_999), (2, 1)}
    t.insert_or_ignore(rows.filter("id in ('k8', 'k9')").unionByName(rows.filter("id = 'k9'").withColumn("id", F.lit("k9b"))).withColumn("version", F.lit(3)), ["version"])
    assert {tuple(r) for r in t.read().groupBy("version").count().collect()} == {(1, 3_999), (2, 1), (3, 1)}


def test_stateful_stream_equals_batch(spark, tmp_path):
    """Late and replayed pages, a restart between batches, a lost checkpoint: the table is that of one batch merge."""
    src = tmp_path / "in"
    src.mkdir()
    rnd = random.Random(1)
    t = VersionedTable(spark, str(tmp_path / "t"), REVIEW, ["review_id"], 2)
    run = lambda cp, name: stream_reviews_stateful(spark, str(src), t, str(tmp_path / cp), files_per_batch=2, name=name).awaitTermination()
    for k in range(3):
        (src / f"{k}.json").write_text(page("a", k, [str(rnd.randint(0, 30)) for _ in range(12)] + ["same", None]))
    run("cp", "s")
    ids = lambda: sorted(r.review_id for r in t.read().collect())
    once = ids()
    assert len(once) == len(set(once)) and "same" in once
    (src / "3.json").write_text((src / "0.json").read_text().replace("\n", " "))  # a replayed page
    (src / "4.json").write_text(page("b", 0, ["late", "b1"]))
    run("cp", "s")
    assert ids() == sorted([*once, "late", "b1"])
    run("lost", "s2")  # all pages again, with the ids in the table as the first state
    assert ids() == sorted([*once, "late", "b1"])
    raw = landed.read_review_pages(spark, str(src)).select("app_id", "page", F.posexplode("reviews").alias("pos", "review"))
    want = clean_reviews(extract_review_fields(raw)).dropna(subset=["review_id"])
    assert ids() == sorted(r.review_id for r in want.collect())
    assert json.loads(read_text(spark, f"{t.path}/versions/{t.versions()[-1]:012d}"))["applied"].keys() == {"s", "s2"}
