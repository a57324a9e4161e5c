"""Near-duplicates, components, decontamination, byte-level BPE, neighbours, licences and token counts."""

import random
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedmill.llm import ann_search, decontaminate, license_scan, minhash_dedup
from feedmill.llm.byte_bpe import Coder, encode_documents, merge_tree, read_ranks
from feedmill.llm.common import Workspace, shared_dir
from feedmill.llm.components import components
from feedmill.llm.license_texts import KNOWN_LICENSES
from feedmill.llm.minhash_dedup import deduplicate, near_duplicates
from feedmill.llm.token_counts import TokenCounts, piece_count, word_count

DOCS = "doc_id bigint, text string, n_shingles string"


def union_find(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(rnd.randint(1000, 1300), rnd.randint(1000, 1300)) for _ in range(220)] + [(7, 7)]
    d = spark.createDataFrame(links, "a bigint, b bigint")
    want = {k: v for k, v in union_find([x for x in links if x[0] != x[1]]).items()}
    with Workspace(spark) as work:
        assert {r.node: r.component for r in components(d, work).collect()} == want
        assert components(d.limit(0), work).count() == 0


def brute_components(rows):
    sets, inverted, links = {}, defaultdict(list), []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in inverted[s])
        links += [(j, i) for j, n in common.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            inverted[s].append(i)
    found = union_find(links)
    return {i: (len(sets[i]), found.get(i, i)) for i in sets}


def test_near_duplicates(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for group in range(12):
        base = [word() for _ in range(rnd.choice([40, 80, 200]))]
        for _ in range(rnd.choice([1, 2, 8, 25])):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 30)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    shared = " ".join(word() for _ in range(60))
    rows += [(n + i, shared + " " + " ".join(word() for _ in range(40))) for i in range(40)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "é b"), (9006, "x " * 30_000), (9007, "X " * 20_000)]
    got = near_duplicates(spark.createDataFrame([(i, t, "own") for i, t in rows], DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text, None), (None, text, "x"), (None, None, "x"), (3, "other words are in here now", "x")], DOCS)
    got = near_duplicates(d).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = deduplicate(d)
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3]
    assert near_duplicates(d.limit(0)).count() == 0 and deduplicate(d.limit(0)).count() == 0


def test_near_duplicates_that_share_one_table_only(spark, monkeypatch):
    """Of the half keys of all documents only two are shared, by chance; one pair is linked all the same."""
    own_keys = minhash_dedup.half_keys

    def keys(least):
        out = own_keys(least) + least.sum(dtype=np.uint64)
        out[[5, minhash_dedup.MX + 7]] = 5, 7
        return out

    monkeypatch.setattr(minhash_dedup, "half_keys", keys)
    text = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(200)), "x"), (2, text, "x"), (3, text + " end", "x")], DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 2}


def test_near_duplicates_in_a_large_group(spark):
    """2,600 edited copies of one text, their similarities from 0.3 to 0.95, so many links and many that just miss."""
    rnd, base = random.Random(8), [f"b{i}" for i in range(70)]
    rows = []
    for i in range(2600):
        copy = list(base)
        for k in range(rnd.randint(0, 9)):
            copy[rnd.randrange(70)] = rnd.choice([f"e{i}x{k}", f"common{rnd.randrange(30)}"])
        rows.append((i, " ".join(copy)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    place = {s: k for k, s in enumerate({s for x in sets for s in x})}
    bits = [sum(1 << place[s] for s in x) for x in sets]
    links = []
    for i, x in enumerate(bits):
        for j in range(i):
            common = (x & bits[j]).bit_count()
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                links.append((j, i))
    want = union_find(links)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(i, t, "own") for i, t in rows], DOCS)).collect()}
    assert got == {i: want.get(i, i) for i in range(2600)}
    assert 100 < len(set(got.values())) < 2500


def test_deduplicate_with_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "p", 1, 2, 3.5), (2, "A b c d e f", "q", 3, 4, 4.5)], "Doc_id bigint, TEXT string, `k` string, kept int, `row` int, `component.id` double")
    got = deduplicate(d)
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", "p", 1, 2, 3.5)]


def brute_hits(texts, items, window):
    spans = defaultdict(set)
    for i, b in items:
        w = decontaminate.words(b)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            spans[tuple(w[k : k + size])].add(str(i))
    out = []
    for t in texts:
        w, found = decontaminate.words(t), set()
        mask = [False] * len(w)
        for size in {len(s) for s in spans}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in spans:
                    found |= spans[tuple(w[k : k + size])]
                    mask[k : k + size] = [True] * size
        out.append((len(w), sum(mask), sorted(found)))
    return out


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_contamination(spark, monkeypatch, block):
    rnd = random.Random(3)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    say = lambda n: " ".join(rnd.choice(["a", "B", "ç", "zz", "9"]) for _ in range(n))
    items = [(i, say(rnd.randint(0, 14))) for i in range(9)] + [(50, None), (3, say(5))]
    texts = [say(rnd.randint(0, 80)) for _ in range(30)] + [None, "", "a-b!B", say(30_000)]
    d = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id bigint, text string, items string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(d, b, window=4).collect()}
    want = brute_hits(texts, items, 4)
    assert [got[i] for i in range(len(texts))] == want
    clean = decontaminate.decontaminate(d, b, window=4)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, w in enumerate(want) if not w[1]}


MEMORY = """
import random, resource, sys, time
sys.path.insert(0, sys.argv[1])
from feedmill.llm import decontaminate as D
rnd = random.Random(1)
say = lambda n: " ".join(rnd.choices(VOCABULARY, k=n))
VOCABULARY = ["w%d" % i for i in range(5000)]
long = say(5000)
items = [("long", long)] + [(str(i), say(200)) for i in range(6500)]
assert sum(len(t) for _, t in items) > 6_000_000
test = D.TestSet(items, 10)
texts = [D.words(say(20000)) for _ in range(20)] + [D.words(say(100) + " " + long)]
masks, found = D.mark_shard(test, texts)
assert masks[-1].sum() == 5000 and "long" in found[-1] and not any(m.any() for m in masks[:-1])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_of_a_full_block_with_a_long_item():
    root = str(Path(decontaminate.__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", MEMORY, root], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 1000


def test_decontaminate_with_clashing_names(spark):
    words = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, words, b"p", 3), (2, "other", b"q", 4)], "id bigint, Text string, HIT binary, `n_hit` int")
    b = spark.createDataFrame([(7, words)], "Item_id bigint, TEXT string")
    got = decontaminate.decontaminate(d, b)
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(2, "other", bytearray(b"q"), 4)]


def test_contamination_empty_and_longest(spark):
    d = spark.createDataFrame([(1, "x the cat sat on the mat y"), (2, "the cat sat"), (2, "the cat sat")], "doc_id bigint, text string")
    b = spark.createDataFrame([("t", "a cat sat on the rug")], "item_id string, text string")
    assert {r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0} and decontaminate.contamination(d.limit(0), b).count() == 0
    got = {r.item_pos: (r.n_match, r.doc_id, r.doc_pos) for r in decontaminate.longest_matches(d, b).collect()}
    assert got[1] == (4, 1, 2) and got[4] == (1, 1, 1) and 0 not in got and 5 not in got


def test_byte_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = read_ranks(path)
    coder, model = Coder(ranks, merge_tree(ranks), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["", " ", "a" * 5000, " " * 3000, "Don't <|endoftext|> 12345 naïve 日本語 🙂🙂 \n\n\t x", "é" * 999] + ["".join(rnd.choice("aethinsrd éäß 01'\n.") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        ids = coder.encode(t)
        assert ids == model.encode_ordinary(t) and coder.decode(ids) == t.encode()
    d = spark.createDataFrame([(1, None, 5), (2, "hello world", 5), (2, "hello world", 5)], "doc_id bigint, text string, n_tokens int")
    got = encode_documents(d, path, P.PATTERN).collect()
    assert [r.n_tokens for r in got] == [0, 2, 2] and bytes(got[1].decoded) == b"hello world" and bytes(got[0].decoded) == b""
    assert encode_documents(d.limit(0), path, P.PATTERN).count() == 0
    odd = d.select(d.doc_id.alias("x.id"), d.text.alias("t`x"), d.n_tokens.alias("ids"))
    assert [tuple(r)[:2] for r in encode_documents(odd, path, P.PATTERN, "x.id", "t`x").collect()] == [(1, 0), (2, 2), (2, 2)]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 16)), rng.normal(size=16) + 0.01 * rng.normal(size=(80, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(600, None, 1), (620, [0.0] * 16, 1), (640, [float("nan")] * 16, 1), (641, [1.0] * 15 + [None], 1), (642, [float("inf")] * 16, 1), (643, [1.0] * 3, 1), (None, [1.0] * 16, 1), (644, x[7].tolist(), 1), (660, x[20].tolist(), 1)]
    d = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann_search.nearest(d.filter("vec_id % 20 = 0"), d, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = [*range(580), 644, 660]
    m = np.concatenate([x, x[[7, 20]]]).astype(float)
    found = 0
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, hits in got.items():
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        s = m @ m[ids.index(q)]
        want = sorted((-s[k], i) for k, i in enumerate(ids) if i != q)[:20]
        found += len({h[1] for h in hits} & {i for _, i in want})
        assert [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits) and all(abs(h[2] - s[ids.index(h[1])]) < 1e-9 for h in hits)
    assert found >= 0.9 * 20 * len(got)
    few = d.filter("vec_id < 4")
    assert sorted((r.query_id, r.rank) for r in ann_search.nearest(few.filter("vec_id = 0"), few).collect()) == [(0, 1), (0, 2), (0, 3)]
    assert ann_search.nearest(d.limit(0), d.limit(0)).count() == 0 and ann_search.nearest(d.filter("vec_id = 600"), d).count() == 0


def ann_table(kind, n=50_000, dim=64):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, dim))
    if kind == "clustered":
        x = rng.standard_normal((500, dim))[rng.integers(0, 500, n)] + 0.35 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * rng.lognormal(0, 0.7, (n, 1)) if kind == "uneven" else x


@pytest.mark.parametrize("kind,most", [("even", 0.1), ("clustered", 0.02), ("uneven", 0.1)])
def test_collisions_prune(kind, most):
    """Recall and the share of pairs that are verified, over shards as the search deals them."""
    x, k = ann_table(kind), 20
    ids = np.arange(len(x))
    asked, shards = ids[::1000], -(-len(x) // ann_search.SHARD_ROWS)
    found, verified = defaultdict(list), 0
    for s in range(shards):
        own = ids[ids * 7919 % shards == s]
        shard = ann_search.Shard(own, x[own])
        for q, (rows, scores) in zip(asked, shard.search(asked, x[asked], k)):
            found[q] += zip(-scores, shard.ids[rows])
        verified += shard.verified
    hits = 0
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({i for _, i in sorted(found[q])[:k]} & set(np.argsort(-score)[:k]))
    assert verified < most * len(asked) * len(x) and hits >= 0.9 * k * len(asked)


@pytest.mark.parametrize("kind", ["even", "clustered", "uneven"])
@pytest.mark.parametrize("dim", [64, 256])
def test_recall_over_many_shards(kind, dim):
    """64 shards: a query loses no neighbour by how ids fall into them."""
    x, k, shards = ann_table(kind, 16_000, dim), 20, 64
    ids = np.arange(len(x))
    asked, found, hits = ids[::800], defaultdict(list), 0
    for s in range(shards):
        shard = ann_search.Shard(ids[ids % shards == s], x[ids % shards == s])
        for q, (rows, scores) in zip(asked, shard.search(asked, x[asked], k)):
            found[q] += zip(-scores, shard.ids[rows])
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({i for _, i in sorted(found[q])[:k]} & set(np.argsort(-score)[:k]))
    assert hits >= 0.95 * k * len(asked)


def test_search_costs_few_products(spark):
    """Finding a query's neighbours takes the CPU of a few products with all vectors, and no two shards and blocks wait for each other in one small task."""
    x, ids = ann_table("even", 32_768), np.arange(32_768)
    shard = ann_search.Shard(ids, x)

    def least(work):
        took = []
        for _ in range(4):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: list(shard.search(ids[:20], x[:20], 20))) < 6 * least(lambda: [np.einsum("ij,j->i", x, x[i]) for i in range(20)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:200])], "vec_id bigint, embedding array<double>")
    assert "REPARTITION_BY_NUM" in ann_search.nearest(d, d)._jdf.queryExecution().executedPlan().toString()


def test_collisions_and_near_groups():
    """Collisions are those of windows over the projections but for rounding; equal vectors collide always, and all of a group of copies are candidates."""
    x = np.concatenate([ann_table("even", 3000, 16), np.repeat(ann_table("even", 1, 16), 2000, axis=0)])
    ids = np.arange(len(x))[::-1].copy()
    shard = ann_search.Shard(ids, x)
    (r,), at = shard.ranges, np.append(x[5], 0) @ shard.hashes * ann_search.LEVELS + ann_search.MIDDLE
    p = np.column_stack([x, np.zeros(len(x))]) @ shard.hashes
    for radius in (0.1, 0.7, 1.4):
        want = (np.abs(p - p[5]) <= radius).sum(axis=1)
        assert np.abs(r.collisions(at, radius)[np.argsort(r.rows)] - want).max() <= 20 and abs(r.collisions(at, radius).mean() - want.mean()) < 1
    assert r.collisions(at, 0.0)[np.argsort(r.rows)][5] == ann_search.FUNCTIONS
    (rows, scores), = shard.search(ids[4000:4001], x[4000:4001], 20)
    assert sorted(ids[rows]) == list(range(20)) and np.allclose(scores, 1)


def test_nearest_of_several_lengths_and_clashing_names(spark):
    rows = [(i, [float(i + 1), float(j == 0)] + [1.0] * (j * 2), 1, 2, 3) for j in range(2) for i in range(j * 3, j * 3 + 3)]
    d = spark.createDataFrame(rows, "Vec_ID bigint, `__v` array<double>, `__id` int, rank int, `__d` int")
    got = ann_search.nearest(d, d, k=5, vector_col="__v").collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(a, b) for a in range(6) for b in range(6) if a != b and (a < 3) == (b < 3)}


def test_licenses(spark):
    mit = next(t for k, kind, t in KNOWN_LICENSES if k == "MIT" and kind == "text")
    changed = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;")
    rows = [(1, mit), (2, changed), (3, mit + " extra"), (4, "text\n# Released under the MIT Licence\nmore\nLicensed under CC BY 4.0."), (5, None), (6, ""), (7, "!!"), (1, mit), (8, "x " * 50_000 + "\nReleased under the MIT License.")]
    d = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id bigint, text string, license string")
    got = sorted((r.doc_id, r.license, r.n_notices, r.notices) for r in license_scan.scan_licenses(d).collect())
    assert got == [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, ""), (4, None, 2, "CC-BY-4.0,MIT"), (5, None, 0, ""), (6, None, 0, ""), (7, None, 0, ""), (8, None, 1, "MIT")]
    assert license_scan.scan_licenses(d.limit(0)).count() == 0


def test_licenses_of_any_words_and_from_a_table(spark):
    waiver = "This work is dedicated to the public domain by its author."
    d = spark.createDataFrame([(1, waiver.upper()), (2, "x\n" + waiver), (3, "Released under the MIT License.")], "doc_id bigint, text string")
    known = [("waiver", "text", waiver), ("void", "text", "!!"), ("MIT", "notice", "Released under the MIT License.")]
    for licenses in (known, spark.createDataFrame(known, "license string, kind string, body string")):
        got = sorted((r.doc_id, r.license, r.notices) for r in license_scan.scan_licenses(d, licenses).collect())
        assert got == [(1, "waiver", "waiver"), (2, None, "waiver"), (3, "MIT", "MIT")]
    assert {r.license for r in license_scan.scan_licenses(d, []).collect()} == {None}


CHANGES = "op string, source string, lang string, tokenizer string, tokens bigint, old_source string, old_lang string, old_tokenizer string, old_tokens bigint, extra int"


def test_token_counts(spark):
    counts = TokenCounts(spark, shared_dir(spark))
    assert counts.totals().count() == 0
    batch = lambda *rows: spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], CHANGES)
    first = batch(("insert", "s", "en", "t1", 5), ("insert", "s", "en", "t1", 5), ("insert", None, None, "t1", 2), ("insert", "s", "de", "t1", None), ("other", "s", "en", "t1", 9), (None, "s", "en", "t1", 9))
    assert counts.commit("b1", first) and not counts.commit("b1", first)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in counts.totals().collect()}
    assert totals() == {("s", "en", "t1"): (2, 10), (None, None, "t1"): (1, 2), ("s", "de", "t1"): (1, 0)}
    assert counts.commit("b2", batch(("delete", "s", "de", "t1", None), ("revise", "s", "en", "t2", 7, "s", "en", "t1", 5)))
    assert totals() == {("s", "en", "t1"): (1, 5), ("s", "en", "t2"): (1, 7), (None, None, "t1"): (1, 2)}
    assert counts.commit("b3", first.limit(0))
    with pytest.raises(ValueError):
        counts.commit("../b4", first)
    d = spark.createDataFrame([(" a  b\n", ), (None,), ("",), ("x1, é",)], "t string")
    assert [tuple(r) for r in d.select(word_count(F.col("t")), piece_count(F.col("t"))).collect()] == [(2, 2), (0, 0), (0, 0), (2, 4)]


def test_token_counts_of_unfinished_batches_and_compaction(spark, tmp_path):
    row = lambda n: spark.createDataFrame([("insert", "s", "en", "t", n, None, None, None, None, None)], CHANGES)
    path = tmp_path / "counts"
    path.mkdir()
    counts = TokenCounts(spark, str(path))
    assert counts.totals().count() == 0 and counts.compact() == 0
    assert counts.commit("a", row(1)) and counts.commit("b", row(10))
    # a writer that was lost before it could rename its folder, and one that lost the race for an id
    minhash_dedup.settle(row(1000)).write.parquet(str(path / "tmp" / "lost"))
    late = f"{path}/tmp/late"
    row(100).write.parquet(late)
    assert not counts._publish(late, "batches", "b") and not Path(late).exists()
    total = lambda: [(r.docs, r.tokens) for r in counts.totals().collect()]
    assert total() == [(2, 11)]
    assert counts.compact() == 2 and total() == [(2, 11)] and not counts.commit("a", row(5))
    assert counts.commit("c", row(100)) and total() == [(3, 111)]
    counts.drop_folded()
    assert counts._names("batches") == ["c"] and total() == [(3, 111)] and not counts.commit("b", row(5))
    assert counts.compact() == 1 and counts.compact() == 0 and total() == [(3, 111)]
