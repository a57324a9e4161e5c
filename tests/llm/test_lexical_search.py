"""Ranked lexical search against the definition of its scores."""

import math
import random
import re

import numpy as np

from feedmill.llm import lexical_search
from feedmill.llm.lexical_search import Builder, search, terms_of

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(d, words(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        rows = []
        for d, w in held:
            m, score = 100 - 25 + (25 * len(w) * n) // max(total, 1), 0
            for t in words(text):
                tf, df = w.count(t), sum(t in set(x) for _, x in held)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                rows.append((-score, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def same(spark, docs, items, k=20):
    got = sorted((tuple(r) for r in search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k).collect()), key=str)
    assert got == brute(docs, items, k)


def test_terms():
    text = "Ab-cd ÄÖ 12x_y\x0bZ\x7fé ü 😀!"
    assert [t.decode("utf-8", "surrogatepass") for t in terms_of(text)] == words(text)
    assert terms_of(None) == terms_of(" .,-") == []


def test_scores_ties_and_odd_rows(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 60}" for _ in range(400)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    docs = [(i, text(rnd.choice([1, 3, 20, 60]))) for i in range(60)] + [(200 + i, "w1 w2 copy") for i in range(30)]  # many ties at the k-th place
    docs += [(7, docs[7][1]), (None, "w1 w2 copy"), (None, None), (900, ""), (901, " .!"), (902, "w1 " * 2_000 + "Seldom")]
    items = [(1, "w1 W2 copy w2"), (2, "seldom w1"), (3, text(40)), (4, "nothing here"), (5, None), (6, "")]
    same(spark, docs, items)
    same(spark, docs, items, 3)


def test_same_id_empty_tables_and_other_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b", "x"), (2, "b", "y")], DOCS + ", `query.x` string"), spark.createDataFrame([(1, "b"), (1, "a"), (None, "b"), (None, "zzz")], ITEMS)
    got = sorted((r.item_id or 0, r.rank, r.doc_id) for r in search(docs, items).collect())
    assert [g for g in got if g[0] == 1] == [(1, 1, 1)] and len({g[2] for g in got if not g[0]}) == 2
    assert search(docs.limit(0), items).count() == search(docs, items.limit(0)).count() == 0


def test_several_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{min(int(rnd.paretovariate(0.7)), 40)}" for _ in range(n))
    same(spark, [(i, text(rnd.randint(1, 30))) for i in range(80)], [(i, text(12)) for i in range(20)], 5)


def test_stops_early_and_strictly():
    """Two terms, one document that is best in both: few documents are looked up. Equal scores at the end are all considered."""
    n = 5_000
    vocabulary = {b"a": 0, b"b": 1}
    texts = [b"x " * 19 + (b"a " * (1 + i % 3) if i % 2 else b"b ") for i in range(n)]
    texts[1234] = b"a a a a a a b b b b b b"
    builder = Builder(vocabulary, np.array([900, 700]), n, n * 20)
    for i, t in enumerate(texts):
        builder.add(i, t.split())
    shard, ids = builder.shard()
    found, scores = shard.search([(0, 1), (1, 1)], 1)
    assert [ids[d] for d in found] == [1234] and shard.accessed < 200
    # many equal scores: the smallest ids win although they come up last
    builder.clear()
    for i in range(300):
        builder.add(300 - i, [b"a", b"x"])
    shard, ids = builder.shard()
    found, _ = shard.search([(0, 2)], 5)
    assert [ids[d] for d in found] == [1, 2, 3, 4, 5]
