import math
from collections import Counter

from pyspark.sql import functions as F

from feedmill.operators import evidence
from feedmill.operators import retrieval as R

CHUNK = "app_id string, chunk_id string, text string, embedding array<float>"
QUERY = "app_id string, query_id string, query_text string, embedding array<float>"


def lists(spark, rows):
    return spark.createDataFrame([("q", "a", c, r) for r, c in enumerate(rows)], "query_id string, app_id string, chunk_id string, rank int")


def test_rrf(spark):
    got = R.rrf_fusion(lists(spark, ["c1", "c2"]), lists(spark, ["c2", "c3"])).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.rrf_score, 6)) for r in got] == [("c2", 0.03306), ("c1", 0.016667), ("c3", 0.016393)] and got[0].retrievers == ["vector", "bm25"]
    tie = R.rrf_fusion(lists(spark, ["c1"]), lists(spark, ["c9"])).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["c1", "c9"]
    o = R.retriever_overlap(lists(spark, ["c1", "c2"]), lists(spark, ["c2", "c3"])).first()
    assert (o.n_vector, o.n_bm25, o.n_both) == (2, 2, 1)


def test_early_fusion_equals_full_lists(spark):
    """Deep lists with some, many and no chunks in common, of unequal length, and one list alone; few are read to their ends."""
    import random

    rnd, v, b = random.Random(4), [], []
    for q in range(8):
        ids = [f"c{i}" for i in range(400)]
        a, other = rnd.sample(ids, [400, 30, 300, 0][q % 4]), rnd.sample(ids if q % 3 else ids[:40], 40 if q % 3 == 0 else 250)
        if q == 5:
            other = sorted(a, key=lambda c: a.index(c) + rnd.randint(0, 9))
        v += [(f"q{q}", "a", c, r) for r, c in enumerate(a)]
        b += [(f"q{q}", "a", c, r) for r, c in enumerate(other)]
    kinds = "query_id string, app_id string, chunk_id string, rank int"
    v, b = spark.createDataFrame(v, kinds), spark.createDataFrame(b, kinds)
    rows = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, r.rrf_score, tuple(r.retrievers)) for r in d.collect())
    got = R.rrf_fusion_early(v, b).cache()
    assert rows(got) == rows(R.rrf_fusion(v, b)) and len(rows(got)) == 96
    assert max(r.depth for r in got.collect()) <= 192
    assert R.rrf_fusion_early(v.limit(0), b.limit(0)).count() == 0


def test_vector_threshold_after_cut(spark):
    chunks = [("a", f"c{i}", "", [1.0, i / 100]) for i in range(10)] + [("a", "zero", "", [0.0, 0.0]), ("a", "none", "", None), ("b", "other", "", [1.0, 0.0])]
    far = [("a", "far", "", [0.29, math.sqrt(1 - 0.29**2)])]
    q = spark.createDataFrame([("a", "q", "", [1.0, 0.0])], QUERY)
    got = R.vector_topk(spark.createDataFrame(chunks, CHUNK), q).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [f"c{i}" for i in range(8)] and [r.rank for r in got] == list(range(8))
    assert R.vector_topk(spark.createDataFrame(far, CHUNK), q).count() == 0
    assert R.vector_topk(spark.createDataFrame([("a", "edge", "", [0.3, math.sqrt(1 - 0.09)])], CHUNK), q).count() == 1


def test_vector_blocks_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "CHUNK_BLOCK", 40)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "PRODUCTS", 50)
    x = np.random.default_rng(0).normal(size=(150, 4)).round(1)
    c = [("a", f"c{i:03}", "", v.tolist()) for i, v in enumerate(x)] + [("a", "short", "", [1.0]), ("a", "nan", "", [float("nan")] * 4)]
    q = [("a", f"q{i}", "", x[i].tolist()) for i in range(10)]
    got = {}
    for r in R.vector_topk(spark.createDataFrame(c, CHUNK), spark.createDataFrame(q, QUERY)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(10):
        d = np.round(1 - u @ u[i], 9)
        assert got[f"q{i}"] == [f"c{j:03}" for j in np.argsort(d, kind="stable")[:8] if d[j] <= 0.7]


def test_encode_and_replace_the_apps_chunks(spark, tmp_path):
    """Vectors are made batch by batch by the hook, and put into the partitions of their apps only."""
    from collections.abc import Iterator

    import pandas as pd

    from feedmill.sources.tables import overwrite_apps

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [float(len(t)), 1.0])

    path, kind = str(tmp_path / "chunks"), "app_id string, chunk_id string, text string, image_urls array<string>"
    overwrite_apps(R.encode_chunks(spark.createDataFrame([("a", "1", "old", []), ("b", "2", "other", ["u"])], kind), embed), path)
    overwrite_apps(R.encode_chunks(spark.createDataFrame([("a", "3", "a new one", [])], kind), embed), path)
    got = sorted((r.app_id, r.chunk_id, r.embedding) for r in spark.read.parquet(path).collect())
    assert got == [("a", "3", [9.0, 1.0]), ("b", "2", [5.0, 1.0])]


def brute_bm25(docs, query):
    toks = {d: t.split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = {d: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()) for d, t in toks.items()}
    return {d: s for d, s in score.items() if s > 0}


def test_bm25(spark, tmp_path):
    docs = {"1": "a b c", "2": "a a d", "3": "a e f g h", "4": "b i", "5": "j k"}
    c = spark.createDataFrame([("x", d, t, None) for d, t in docs.items()], CHUNK)
    for query in ("a b", "b b a", "d", "zzz"):
        got = {r.chunk_id: r.score for r in R.bm25_topk(c, spark.createDataFrame([("x", "q", query, None)], QUERY)).collect()}
        want = brute_bm25(docs, query)
        assert sorted(got) == sorted(want) and all(abs(got[d] - want[d]) < 1e-8 for d in want)
    R.write_bm25_index(c, str(tmp_path / "index"))
    R.write_bm25_index(c.limit(1).withColumn("app_id", F.lit("other")), str(tmp_path / "index"))
    stored = R.read_bm25_index(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([("x", "q", "a b d", None)], QUERY)
    assert {(r.chunk_id, r.score, r.rank) for r in R.bm25_topk(stored, q).collect()} == {(r.chunk_id, r.score, r.rank) for r in R.bm25_topk(c, q).collect()}
    assert R.bm25_topk(c.limit(0), spark.createDataFrame([("x", "q", "a", None)], QUERY)).count() == 0


def test_rerank_ties_keep_order(spark):
    fused = lists(spark, ["c1", "c2", "c3"]).withColumns({"rrf_score": F.lit(0.1), "retrievers": F.array(F.lit("vector"))})
    chunks = spark.createDataFrame([("a", "c1", "x", None), ("a", "c2", "lag", None), ("a", "c3", "y", None)], CHUNK)
    got = R.rerank(fused, spark.createDataFrame([("a", "q", "lag spike", None)], QUERY), chunks, n=2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c2", "c1"] and got[0].relevance_score == 0.5


def test_evidence(spark):
    q = spark.createDataFrame([("1", "ui_controls"), ("2", "ui_controls"), ("3", "ui_controls"), ("4", "other"), ("5", "ui_controls"), ("6", "ui_controls"), ("7", None)], "query_id string, category string")
    hits = spark.createDataFrame([(str(i), c, r) for i in range(1, 7) for r, c in enumerate("ba")], "query_id string, chunk_id string, rank int")
    a = [("1", ["a", "b"], True, 0.5, True), ("2", [], True, 0.5, True), ("3", ["a"], False, 0.5, True), ("5", ["a"], None, 0.5, True), ("6", ["a"], True, 1.5, True)]
    p = evidence.evidence_packages(q, hits, spark.createDataFrame(a, "query_id string, relevant_ids array<string>, is_sufficient boolean, confidence double, assessed boolean").withColumn("retries", F.lit(None).cast("int")))
    got = {r.query_id: r for r in p.collect()}
    assert [got[str(i)].retrieval_decision for i in range(1, 8)] == ["retrieved", "insufficient", "insufficient", "skipped", "retrieved", "insufficient", "skipped"]
    assert got["1"].sources == ["b", "a"] and got["6"].valid is False and "confidence 0.50" in got["1"].retrieval_reasoning
    drafts = spark.createDataFrame([("1", ["a", "x"]), ("2", []), ("9", ["y"])], "query_id string, cited_ids array<string>")
    audit = {r.query_id: (r.unsupported, r.supported) for r in evidence.citation_audit(drafts, p).collect()}
    assert audit == {"1": (["x"], False), "2": ([], True), "9": (["y"], False)}


def test_prompts(spark):
    h = spark.createDataFrame([("q", "c2", 1, "v", None, "t2", 0.5), ("q", "c1", 0, None, "s", "t1", None)], "query_id string, chunk_id string, rank int, patch_version string, section string, text string, relevance_score double")
    assert evidence.evidence_prompts(h).first().prompt == '[0] chunk_id=c1 version=unknown section=s relevance=0.00\n    "t1"\n[1] chunk_id=c2 version=v section=unknown relevance=0.50\n    "t2"'


def test_prompts_without_hits(spark):
    h = spark.createDataFrame([("1", "b", 3, "v", "s", "tb"), ("1", "a", 1, "v", "s", "ta")], "query_id string, chunk_id string, rank int, patch_version string, section string, text string")
    q = spark.createDataFrame([("1", ["a", "b"]), ("2", [])], "query_id string, sources array<string>")
    got = {r.query_id: r.prompt for r in evidence.evidence_prompts(h, q, scored=False).collect()}
    assert got == {"1": '[0] chunk_id=a version=v section=s\n    "ta"\n[1] chunk_id=b version=v section=s\n    "tb"', "2": "(no chunks retrieved — retrieval returned empty results)"}
    got = {r.query_id: r.prompt for r in evidence.source_prompts(q, h).collect()}
    assert got["2"] == "<evidence_sources>No relevant sources retrieved.</evidence_sources>"
    assert got["1"].startswith("<evidence_sources>\n[0] chunk_id=a") and got["1"].endswith('"tb"\n</evidence_sources>')
