"""Block-max BM25 against all postings; the quantised vector index against exact search."""

import random

import numpy as np
from pyspark.sql import functions as F

from feedmill.operators import blockmax, ivfpq, retrieval
from feedmill.plans import adapters

CHUNK = "app_id string, chunk_id string, text string"
QUERY = "app_id string, query_id string, query_text string"


def corpus(n, seed=1, lengths=None):
    rnd = random.Random(seed)
    word = lambda: f"w{min(int(rnd.paretovariate(0.5)), 3000)}"
    rows = [(f"app{i % 2}", f"c{i}", " ".join(word() for _ in range(rnd.choice(lengths or [0, 3, 20, 80])))) for i in range(n)]
    return rows + [("app0", "none", None), ("app0", "copy1", rows[6][2]), ("app0", "copy2", rows[6][2]), ("one", "only", "w1 w2")]


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


def test_blockmax_equals_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK_DOCS", 16)
    monkeypatch.setattr(blockmax, "HELD_TOKENS", 2_000)
    rows = corpus(600)
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    asked = [("app0", "q1", "w1"), ("app0", "q2", "w1 w2 w1 w7"), ("app1", "q3", rows[5][2] or "w3"), ("app1", "q4", "absent"), ("app1", "q5", None), ("none", "q6", "w1"), ("app0", "q7", rows[6][2]), ("one", "q8", "w1")]
    queries = spark.createDataFrame(asked, QUERY)
    want = ranked(retrieval.bm25_topk(chunks, queries))
    assert ranked(blockmax.search(blockmax.build_index(chunks), queries)) == want
    # the same by segments, one of them added twice
    path = str(tmp_path / "i")
    for k in (0, 1, 2, 1):
        blockmax.add_segment(chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == k), path, f"s{k}")
    assert ranked(blockmax.search(blockmax.read_index(spark, path), queries)) == want


def test_few_postings_of_frequent_terms_are_read(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK_DOCS", 32)
    chunks = spark.createDataFrame(corpus(6_000, 2, range(5, 300)), CHUNK).repartition(4).cache()
    index, lists = blockmax.build_index(chunks), blockmax.needed_lists
    read = []
    monkeypatch.setattr(blockmax, "needed_lists", lambda i, asked: (read.append(lists(i, asked).agg(F.sum("n")).first()[0] or 0), lists(i, asked))[1])
    # one frequent term; with two, whose largest impacts seldom meet in one chunk, little or nothing is saved at this size
    for asked, most in (([("app0", "q1", "w4"), ("app0", "q2", "w3")], 0.15), ([("app1", "q3", "w9 w20")], 1.01)):
        queries = spark.createDataFrame(asked, QUERY)
        read.clear()
        assert ranked(blockmax.search(index, queries)) == ranked(retrieval.bm25_topk(chunks, queries))
        terms = index.lists.filter("term is not null").join(blockmax.weigh(index, queries).select("app_id", "term").distinct(), ["app_id", "term"], "left_semi")
        assert sum(read) < most * terms.agg(F.sum("n")).first()[0], asked


def test_empty_index(spark, tmp_path):
    none, asked = spark.createDataFrame([], CHUNK), spark.createDataFrame([("a", "q", "x")], QUERY)
    assert blockmax.search(blockmax.build_index(none), asked).count() == 0
    assert blockmax.search(blockmax.read_index(spark, str(tmp_path / "nothing")), asked).count() == 0
    assert blockmax.search(blockmax.build_index(spark.createDataFrame([("a", "c", "x y")], CHUNK)), asked.limit(0)).count() == 0


VECTOR = "app_id string, chunk_id string, embedding array<float>"


def vectors(n, dim, seed=1, centres=40):
    rnd = np.random.default_rng(seed)
    middle = rnd.standard_normal((centres, dim))
    v = middle[rnd.integers(0, centres, n)] + 0.5 * rnd.standard_normal((n, dim))
    return [(f"app{i % 2}", f"c{i}", x.tolist()) for i, x in enumerate(v.astype(np.float32))]


def recall(got, want):
    a, b = ({(r.query_id, r.chunk_id) for r in d.collect()} for d in (got, want))
    return len(a & b) / len(b)


def test_quantised_recall(spark, tmp_path):
    """Clustered vectors of 64 and of 1,536 dimensions, and independent ones, which need visits to more of the cells."""
    for dim, n, spread, visited in ((64, 4_000, 40, ivfpq.VISITED), (1536, 600, 20, ivfpq.VISITED), (64, 3_000, 3_000, 0.7)):
        rows = vectors(n, dim, centres=spread) + [("app0", "zero", [0.0] * dim), ("app0", "null", None), ("app0", "other", [1.0, 2.0])]
        chunks = spark.createDataFrame(rows, VECTOR)
        queries = spark.createDataFrame([(a, f"q{c}", v) for a, c, v in rows[:n:40]], "app_id string, query_id string, embedding array<float>")
        index = ivfpq.build_index(chunks)
        assert recall(ivfpq.search(index, queries, similarity=-1, visited=visited), retrieval.vector_topk(chunks, queries, similarity=-1)) >= 0.95, (dim, spread)
    ivfpq.write_index(chunks, str(tmp_path / "i"))
    stored = ivfpq.search(ivfpq.read_index(spark, str(tmp_path / "i")), queries)
    exact = {(r.query_id, r.chunk_id): r.distance for r in retrieval.vector_topk(chunks, queries).collect()}
    got = {(r.query_id, r.chunk_id): r.distance for r in stored.collect()}
    assert got and all(abs(exact[k] - d) < 1e-8 for k, d in got.items() if k in exact)
    assert ivfpq.search(ivfpq.build_index(chunks.limit(0)), queries).count() == 0 == ivfpq.search(index, queries.limit(0)).count()


def test_common_vector_is_split(spark, monkeypatch):
    """A third of all vectors are one: its list is scanned in parts, ties go by chunk id."""
    monkeypatch.setattr(ivfpq, "PART_ROWS", 50)
    rows = vectors(400, 16) + [("app0", f"s{i:03}", [1.0] * 16) for i in range(200)]
    queries = spark.createDataFrame([("app0", "q", [1.0] * 16)], "app_id string, query_id string, embedding array<float>")
    got = ivfpq.search(ivfpq.build_index(spark.createDataFrame(rows, VECTOR)), queries, visited=1.0).orderBy("rank").collect()
    assert [r.chunk_id for r in got][:8] == [f"s{i:03}" for i in range(8)] and len(got) == 8


def test_long_queries_go_to_shards_whole(spark, monkeypatch):
    """Whole texts as queries: a row for each query and shard, none for each term that a query and a chunk or block share."""
    monkeypatch.setattr(retrieval, "SHARD_POSTINGS", 900)
    monkeypatch.setattr(blockmax, "SHARD_POSTINGS", 900)
    monkeypatch.setattr(retrieval, "GROUP_TERMS", 300)
    monkeypatch.setattr(blockmax, "BLOCK_DOCS", 16)
    rows = corpus(300, 5, [20, 80])
    rows += [("app0", f"same{i}", rows[8][2]) for i in range(20)]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    queries = spark.createDataFrame([(a, f"q{c}", t) for a, c, t in rows[:40]], QUERY)
    met = []
    monkeypatch.setattr(blockmax, "reach", lambda index, weighted: (met.append(weighted.groupBy("query_id").count().agg(F.max("count")).first()[0]), reach(index, weighted))[1])
    got = ranked(retrieval.bm25_topk(chunks, queries))
    assert ranked(blockmax.search(blockmax.build_index(chunks), queries)) == got
    assert all(n <= blockmax.BOUNDED_TERMS for n in met)
    assert "FlatMapCoGroupsInArrow" in retrieval.bm25_topk(chunks, queries)._jdf.queryExecution().executedPlan().toString()
    # brute force; equal chunks have equal scores and come by id
    corpus_, terms = ({r[0] if len(r) == 3 else (r.app_id, r.term): r for r in d.collect()} for d in retrieval.bm25_stats(chunks))
    text = [(a, c, (t or "").split()) for a, c, t in rows]
    want = []
    for a, q, t in text[:40]:
        scores = []
        for b, c, words in text:
            if a == b:
                parts = [terms[a, w].idf * blockmax._impact(words.count(w), len(words), corpus_[a].avgdl) for w in t]
                scores.append((-round(sum(parts), 9), c))
        want += [(f"q{q}", i, c, round(-s, 6)) for i, (s, c) in enumerate(sorted(x for x in scores if x[0] < 0)[:8])]
    assert got == sorted(want)


def test_search_shuffles_less_than_the_texts(spark, monkeypatch):
    """Blocks go to shards once, as one row each; lists of terms that no short query asks for are shuffled nowhere, also where tables are too large to broadcast."""
    monkeypatch.setattr(blockmax, "BLOCK_DOCS", 64)
    rnd = random.Random(3)
    words = lambda i: " ".join([f"own{i}x{j}" for j in range(60)] + [f"w{min(int(rnd.paretovariate(0.5)), 500)}" for _ in range(60)])
    rows = [(f"app{i % 2}", f"c{i}", words(i)) for i in range(4_000)]
    chunks, store = spark.createDataFrame(rows, CHUNK).repartition(4), spark.sparkContext._jsc.sc().statusStore()
    queries = spark.createDataFrame([(a, f"q{c}", t) for a, c, t in rows[:12]] + [("app0", "s1", "w1 w7"), ("app1", "s2", "w3")], QUERY)
    want = ranked(retrieval.bm25_topk(chunks, queries))
    index, small = blockmax.build_index(chunks), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(blockmax, "weigh", lambda *_, w=blockmax.settle(blockmax.weigh(index, queries)): w)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), store.executorSummary("driver").totalShuffleWrite())[1]
        before = shuffled()
        assert ranked(blockmax.search(index, queries)) == want
        assert shuffled() - before < sum(len(t) for _, _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    many = np.arange(70_000) % 65_000
    for top in (0, 255, 256, 65_535, 65_536):
        packed = blockmax._packed(np.append(many[many <= top], top))
        assert packed.itemsize == (1 if top < 256 else 2 if top < 65_536 else 4) and (blockmax._numbers(packed.tobytes(), len(packed)) == packed).all() and packed[-1] == top
    assert len(blockmax._numbers(b"", 0)) == 0


def test_chunk_texts_are_those_of_the_chunks(spark, tmp_path):
    """A vector that is there twice repeats its chunk in both."""
    spark.createDataFrame([(0, "a b"), (1, None), (2, "c"), (None, "d")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, [1.0]), (2, [1.0]), (2, [2.0]), (9, [1.0]), (None, [1.0]), (None, [2.0])], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    own = adapters.chunk_texts(spark, str(tmp_path))
    key = lambda r: str(tuple(r))
    assert sorted(own.collect(), key=key) == sorted(adapters.chunks(spark, str(tmp_path)).select(*own.columns).collect(), key=key) and own.count() == 5


reach = blockmax.reach


def test_queries_are_repeated_for_their_cells_a_few_at_a_time(spark, monkeypatch):
    """What a task holds for the cells that its queries visit is bounded, whatever the number of queries and cells."""
    rows = vectors(2_000, 16, centres=60)
    chunks = spark.createDataFrame(rows, VECTOR)
    queries = spark.createDataFrame([(a, f"q{c}", v) for a, c, v in rows[::4]], "app_id string, query_id string, embedding array<float>").coalesce(1)
    index = ivfpq.build_index(chunks, cells=200)
    want = sorted((r.query_id, r.chunk_id, r.distance) for r in ivfpq.search(index, queries).collect())
    monkeypatch.setattr(ivfpq, "VISIT_NUMBERS", 5_000)
    assert want and sorted((r.query_id, r.chunk_id, r.distance) for r in ivfpq.search(index, queries).collect()) == want
