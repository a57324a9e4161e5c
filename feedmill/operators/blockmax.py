"""BM25 top k by an inverted index in blocks of documents with what a term can add at most in each block.

The tasks that tokenise the chunks also build the blocks, so nothing is shuffled: a block holds up to BLOCK_DOCS chunks of an
app, and for each of its terms the list of chunks with term count and length. Of those the block keeps aside the few
that no other one beats in both count and length: whatever the mean length of the corpus is, one of them has the largest
impact (the BM25 part without idf). So blocks stay valid when the corpus grows, and the index grows by segments.
Most terms of a block are in one or two of its chunks, so a row for each term takes many times what its postings do: a block is
also one row with all of its lists.

A query of more than BOUNDED_TERMS terms, which few blocks could be passed over for, goes to shards of many blocks and sums up all lists of its
terms there; blocks go there as one row each. For the others, whose terms pick their lists where these are read, a search first adds up, from the
few numbers kept aside alone, what a chunk of each block can score at most. Each query then
searches its k most promising blocks; its k-th score there is what any other block must be able to reach, and lists of
blocks that cannot are not read. The result is that of ``retrieval.bm25_topk`` over all postings.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedmill import params
from feedmill.functions.text import bm25_tokens
from feedmill.storage import Workspace, names_in, publish, read_text, settle

#: A block ends at so many chunks or tokens; an open task holds so many tokens of all apps. Queries of a group.
BLOCK_DOCS, BLOCK_TOKENS, HELD_TOKENS, GROUP_QUERIES = 512, 1_000_000, 4_000_000, 1024
#: Queries of more distinct terms sum up all lists of their terms; then, postings of a shard of an app, and terms of all queries of a group.
BOUNDED_TERMS, SHARD_POSTINGS, GROUP_TERMS = 8, 6_000_000, 8_000_000
#: Rows of a table that is broadcast, at most.
FEW_ROWS = 500_000
#: docs and tf are the numbers of ``n`` chunks, see _packed. The block's row without term has its chunks' ids, which docs count from 0, and lengths, all its terms,
#: the chunks of each (df), and all lists one behind the other as docs and tf.
_LISTS = "app_id string, block string, term string, n int, total bigint, best_tf array<int>, best_dl array<int>, docs binary, tf binary, ids array<string>, lengths binary, terms array<string>, df binary"


class BlockIndex(NamedTuple):
    """``lists`` (see _LISTS), ``corpus`` (app_id, n_docs, avgdl) and ``terms`` (app_id, term, df, idf)."""

    lists: DataFrame
    corpus: DataFrame
    terms: DataFrame


def _impact(tf, dl, avgdl):
    """For columns and for arrays of numbers."""
    k1, b = params.BM25_K1, params.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _packed(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 as the smallest kind of integers that holds all of them, as ``_numbers`` reads them."""
    most = values.max(initial=0)
    return np.ascontiguousarray(values, np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    """``n`` numbers."""
    return np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.int32}[len(packed) // n] if n else np.uint8)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each of the lists of ``values`` that end at ``ends``, and of all of them."""
    lists = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
    return pa.concat_arrays([lists, pa.array([values.tobytes()], pa.binary())])


def _block(app, ids: list, tokens: list) -> pa.RecordBatch:
    """The lists of one block, and its row without term. ``total`` sums term counts, in the block's row lengths; ``n`` counts chunks."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    words = (pa.concat_arrays(tokens) if sizes.sum() else pa.array([], pa.string())).dictionary_encode()
    n = len(words.dictionary)
    # one number for each term and chunk: equal ones are counted together and come in order of term, then chunk
    pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = pairs // len(ids), pairs % len(ids)
    dl = sizes[doc]
    df = np.bincount(term, minlength=n)
    ends = np.concatenate([[0], np.cumsum(df)])
    # from short to long, those with more of the term than any before are beaten by none
    order = np.lexsort((-tf, dl, term))
    most = np.maximum.accumulate(term[order] * (tf.max(initial=0) + 1) + tf[order])
    best = order[np.concatenate([[True], most[1:] > most[:-1]])[: len(order)]] if len(order) else order
    best_ends = np.concatenate([[0], np.cumsum(np.bincount(term[best], minlength=n))]).astype(np.int32)
    listed = lambda v: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(best_ends), pa.array(v.astype(np.int32))), pa.nulls(1, pa.list_(pa.int32()))])
    same = lambda x: pa.array([x] * (n + 1), pa.string())
    own = lambda x, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([x], kind)])
    terms = words.dictionary.cast(pa.string())
    columns = [
        same(app), same(uuid.uuid4().hex), pa.concat_arrays([terms, pa.nulls(1, pa.string())]), pa.array(np.append(df, len(ids)).astype(np.int32)),
        pa.array(np.append(np.bincount(term, tf, minlength=n), sizes.sum()).astype(np.int64)), listed(tf[best]), listed(dl[best]), _cut(_packed(doc), ends), _cut(_packed(tf), ends),
        own(ids, pa.list_(pa.string())), own(_packed(sizes).tobytes(), pa.binary()), pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), terms)]),
        own(_packed(df).tobytes(), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["app_id", "block", "term", "n", "total", "best_tf", "best_dl", "docs", "tf", "ids", "lengths", "terms", "df"])


def block_lists(chunks: DataFrame) -> DataFrame:
    """Rows of _LISTS of (app_id, chunk_id, text) chunks; null texts are empty. A row's app may be null; it is in no search."""

    def run(batches):
        held: dict = {}
        total = 0
        for batch in batches:
            tokens = batch.column(2)
            for i, (app, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own, words = held.setdefault(app, [[], [], 0]), tokens[i].values
                own[0].append(chunk), own[1].append(words)
                own[2] += len(words)
                total += len(words)
                if len(own[0]) >= BLOCK_DOCS or own[2] >= BLOCK_TOKENS:
                    total -= own[2]
                    yield _block(app, *held.pop(app)[:2])
            while total > HELD_TOKENS:
                app = max(held, key=lambda a: held[a][2])
                total -= held[app][2]
                yield _block(app, *held.pop(app)[:2])
        for app, (ids, own, _) in held.items():
            yield _block(app, ids, own)

    tokens = bm25_tokens(F.coalesce("text", F.lit("")))
    return chunks.select("app_id", F.col("chunk_id").cast("string").alias("chunk_id"), tokens.alias("t")).mapInArrow(run, _LISTS)


def _with_statistics(lists: DataFrame) -> BlockIndex:
    """Statistics are those of ``retrieval.bm25_stats``: chunks without tokens count as documents, a term of negative idf gets epsilon times
    the mean idf of its app's terms."""
    size = lists.filter("term is null").groupBy("app_id").agg(F.sum("n").alias("n_docs"), F.sum("total").alias("t"))
    corpus = settle(size.select("app_id", "n_docs", (F.col("t") / F.col("n_docs")).alias("avgdl")))
    df = lists.filter("term is not null").groupBy("app_id", "term").agg(F.sum("n").alias("df"))
    # a row for each app
    idf = df.join(F.broadcast(corpus.select("app_id", "n_docs")), "app_id").withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = settle(idf.select("app_id", "term", "df", "idf"))
    mean = idf.groupBy("app_id").agg(F.avg("idf").alias("__mean"))
    terms = idf.join(F.broadcast(mean), "app_id").select("app_id", "term", "df", F.when(F.col("idf") < 0, params.BM25_EPSILON * F.col("__mean")).otherwise(F.col("idf")).alias("idf"))
    return BlockIndex(lists, corpus, terms)


def build_index(chunks: DataFrame) -> BlockIndex:
    return _with_statistics(settle(block_lists(chunks), compression="zstd"))


def add_segment(chunks: DataFrame, path: str, name: str) -> None:
    """Add ``chunks``, which no earlier segment holds, to the index stored below ``path`` as the segment of this name. It appears whole or not at
    all, and once: a name that is there is not added again. Earlier segments are not read."""
    spark = chunks.sparkSession
    if name not in names_in(spark, f"{path}/segments"):
        token = uuid.uuid4().hex
        block_lists(chunks).write.option("compression", "zstd").parquet(f"{path}/data/{token}")
        publish(spark, f"{path}/segments/{name}", json.dumps({"token": token}))


def read_index(spark: SparkSession, path: str) -> BlockIndex:
    """The index of all segments stored so far."""
    tokens = [json.loads(read_text(spark, f"{path}/segments/{n}"))["token"] for n in names_in(spark, f"{path}/segments") if not n.startswith(".")]
    return _with_statistics(spark.read.schema(_LISTS).parquet(*[f"{path}/data/{t}" for t in tokens]) if tokens else spark.createDataFrame([], _LISTS))


def weigh(index: BlockIndex, queries: DataFrame) -> DataFrame:
    """(query_id, app_id, term, w): how much a term's impact counts in a query; a repeated term counts each time."""
    asked = queries.select("query_id", "app_id", F.explode(bm25_tokens(F.coalesce("query_text", F.lit("")))).alias("term")).groupBy("query_id", "app_id", "term").agg(F.count("*").alias("qtf"))
    return asked.join(index.terms.select("app_id", "term", "idf"), ["app_id", "term"]).select("query_id", "app_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def _of_terms(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of the lists that are of a term in ``asked``, picked where they are read if these terms are few."""
    terms = asked.select("app_id", "term").distinct()
    return lists.join(F.broadcast(terms) if terms.count() <= FEW_ROWS else terms, ["app_id", "term"], "left_semi")


def reach(index: BlockIndex, weighted: DataFrame) -> DataFrame:
    """(query_id, app_id, block, bound): what a chunk of the block can score at most."""
    lists = _of_terms(index.lists.filter("term is not null").select("app_id", "term", "block", "best_tf", "best_dl"), weighted)
    mean = weighted.join(index.corpus.select("app_id", "avgdl"), "app_id")
    most = F.array_max(F.zip_with("best_tf", "best_dl", lambda tf, dl: _impact(tf, dl, F.col("avgdl"))))
    met = mean.join(lists, ["app_id", "term"])
    return met.groupBy("query_id", "app_id", "block").agg(F.sum(F.col("w") * most).alias("bound")).filter("bound > 0")


def unpruned(bounds: DataFrame, seeds: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The blocks, but for ``seeds``, that can hold a chunk of a query's k best: those whose bound reaches its k-th score so far."""
    kth = found.filter(F.col("rank") == k - 1).select("query_id", F.col("score").alias("kth"))
    rest = bounds.join(seeds, ["query_id", "app_id", "block"], "left_anti").join(kth, "query_id", "left")
    # scores are rounded to nine places, bounds are not
    return rest.filter(F.col("kth").isNull() | (F.col("bound") + 1e-8 >= F.col("kth"))).select("query_id", "app_id", "block")


def needed_lists(index: BlockIndex, asked: DataFrame) -> DataFrame:
    """The lists of (app_id, block, term) that some query asks for."""
    lists = _of_terms(index.lists.filter("term is not null").select("app_id", "block", "term", "n", "docs", "tf"), asked)
    return lists.join(asked.select("app_id", "block", "term").distinct(), ["app_id", "block", "term"], "left_semi")


def _searched(index: BlockIndex, weighted: DataFrame, wanted: DataFrame, k: int, work: Workspace) -> DataFrame:
    """(query_id, app_id, chunk_id, score): the k best of each query in each of its ``wanted`` (query_id, app_id, block)."""
    sizes = wanted.groupBy("app_id", "block").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("groups"))
    asked = work.settle(wanted.join(weighted, ["query_id", "app_id"]).join(sizes, ["app_id", "block"]))
    right = asked.select("app_id", "block", F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("g"), "query_id", "term", "w")
    own = index.lists.filter("term is null").select("app_id", "block", "term", "n", "ids", "lengths")
    rows = needed_lists(index, asked).unionByName(own, allowMissingColumns=True)
    each = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    left = rows.join(asked.select("app_id", "block", "groups").distinct(), ["app_id", "block"]).join(index.corpus.select("app_id", "avgdl"), "app_id").withColumn("g", each).drop("groups")
    kind = weighted.schema["query_id"].dataType.simpleString()

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        query = b.column("query_id").combine_chunks().dictionary_encode() if b.num_rows else None
        whole = pa.array([], pa.string())
        if a.num_rows and b.num_rows:
            own = a.filter(pc.is_null(a.column("term")))
            whole = own.column("ids")[0].values
            lengths = _numbers(own.column("lengths")[0].as_py(), len(whole))
            a = a.filter(pc.is_valid(a.column("term")))
        if a.num_rows and b.num_rows:
            ends = np.concatenate([[0], np.cumsum(a.column("n").to_numpy())])
            docs, tf = (_numbers(b"".join(a.column(c).to_pylist()), ends[-1]) for c in ("docs", "tf"))
            impacts = _impact(tf.astype(np.float64), lengths[docs].astype(np.float64), a.column("avgdl")[0].as_py())
            at = pc.index_in(b.column("term"), a.column("term").combine_chunks()).fill_null(-1).to_numpy()
            of, w = query.indices.to_numpy(), b.column("w").to_numpy()
            order = np.argsort(of, kind="stable")
            order = order[at[order] >= 0]
            bounds = np.searchsorted(of[order], np.arange(len(query.dictionary) + 1))
            for q in range(len(query.dictionary)):
                own = order[bounds[q] : bounds[q + 1]]
                if not len(own):
                    continue
                lo, n = ends[at[own]], ends[at[own] + 1] - ends[at[own]]
                rows = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
                total = np.round(np.bincount(docs[rows], np.repeat(w[own], n) * impacts[rows], minlength=len(whole)), 9)
                good = np.flatnonzero(total > 0)
                if len(good) > k:  # all that score as much as the k-th
                    good = good[total[good] >= np.partition(total[good], len(good) - k)[len(good) - k]]
                out[0].append(np.full(len(good), q)), out[1].append(good), out[2].append(total[good])
        which, hit, scores = (np.concatenate(x) for x in out)
        named = query.dictionary.take(pa.array(which)) if len(which) else b.column("query_id").slice(0, 0)
        app = a.column("app_id")[0].as_py() if len(which) else None
        return pa.table({"query_id": named, "app_id": pa.array([app] * len(which), pa.string()), "chunk_id": whole.take(pa.array(hit)), "score": pa.array(scores)})

    keys = ["app_id", "block", "g"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"query_id {kind}, app_id string, chunk_id string, score double")


def best_of_lists(docs: np.ndarray, impacts: np.ndarray, ends: np.ndarray, n: int, at: np.ndarray, w: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, score): for each query the k of ``n`` chunks with the largest positive score, equal scores in order of the chunks.

    The list of a term, which ends at ``ends``, has a chunk once. ``at`` are the terms (-1: none) and ``w`` the weights of all queries, ``sizes``
    their numbers of terms.
    """
    out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    lo = 0
    for q, size in enumerate(sizes.tolist()):
        own, x = at[lo : lo + size], w[lo : lo + size]
        lo += size
        own, x = own[own >= 0], x[own >= 0]
        if not len(own):
            continue
        # summed in order of the terms
        lists = [slice(*e) for e in zip(ends[own].tolist(), ends[own + 1].tolist())]
        total = np.bincount(np.concatenate([docs[e] for e in lists]), np.repeat(x, ends[own + 1] - ends[own]) * np.concatenate([impacts[e] for e in lists]), minlength=n)
        # those that round to the k-th score or more, then the first k of them
        least = np.partition(total, n - k)[n - k] - 2e-9 if n > k else 0
        good = np.flatnonzero((total >= least) & (total > 0))
        scores = np.round(total[good], 9)
        first = np.argsort(-scores, kind="stable")[:k]
        first = first[scores[first] > 0]
        out[0].append(np.full(len(first), q)), out[1].append(good[first]), out[2].append(scores[first])
    which, hit, scores = (np.concatenate(x) for x in out)
    return which, hit, scores


def _swept(index: BlockIndex, weighted: DataFrame, k: int) -> DataFrame:
    """(query_id, app_id, chunk_id, score): the k best of each query in each shard of its app's blocks, by all lists of its terms. A query goes
    once to each shard with its terms in one row."""
    terms, blocks = index.lists.filter("term is not null"), index.lists.filter("term is null").select("app_id", "block", "ids", "lengths", "terms", "df", "docs", "tf")
    nc = terms.groupBy("app_id").agg(F.ceil(F.sum("n") / SHARD_POSTINGS).alias("__c"))
    nq = weighted.groupBy("app_id").agg(F.ceil(F.count("*") / GROUP_TERMS).alias("__q"))
    n = F.broadcast(nc.join(nq, "app_id").join(index.corpus.select("app_id", "avgdl"), "app_id"))  # a row for each app
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), (F.col(m) - 1).cast("int")))
    asked = weighted.groupBy("query_id", "app_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t")).select("query_id", "app_id", F.col("t.term").alias("terms"), F.col("t.w").alias("w"))
    left = blocks.join(F.broadcast(n.drop("avgdl")), "app_id").withColumn("shard", deal("block", "__c")).withColumn("g", each("__q")).drop("__c", "__q")
    right = asked.join(n, "app_id").withColumn("g", deal("query_id", "__q")).withColumn("shard", each("__c")).drop("__c", "__q")
    kind = weighted.schema["query_id"].dataType.simpleString()

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        which, hit, scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())
        if a.num_rows and b.num_rows:
            held = a.column("ids").combine_chunks()
            order = pc.array_sort_indices(held.flatten())
            ids = held.flatten().take(order)
            place = np.empty(len(ids), np.int32)
            place[order.to_numpy()] = np.arange(len(ids), dtype=np.int32)
            words, avgdl = a.column("terms").combine_chunks().flatten().dictionary_encode(), b.column("avgdl")[0].as_py()
            docs, impacts, df, first = [], [], [], 0
            for n, terms, *packed in zip(pc.list_value_length(held).to_pylist(), pc.list_value_length(a.column("terms")).to_pylist(), *(a.column(c).to_pylist() for c in ("lengths", "df", "docs", "tf"))):
                df.append(_numbers(packed[1], terms))
                own, tf = (_numbers(x, int(df[-1].sum(dtype=np.int64))) for x in packed[2:])
                docs.append(place[first : first + n][own])
                impacts.append(_impact(tf.astype(np.float64), _numbers(packed[0], n)[own].astype(np.float64), avgdl))
                first += n
            docs, impacts = np.concatenate(docs), np.concatenate(impacts)
            term = np.repeat(words.indices.to_numpy(), np.concatenate(df))
            by_term = np.argsort(term, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words.dictionary)))])
            asked = b.column("terms").combine_chunks()
            at = pc.index_in(asked.flatten(), words.dictionary).fill_null(-1).to_numpy()
            which, hit, scores = best_of_lists(docs[by_term], impacts[by_term], ends, len(ids), at, b.column("w").combine_chunks().flatten().to_numpy(), pc.list_value_length(asked).to_numpy(), k)
        app = b.column("app_id")[0].as_py() if b.num_rows else None
        return pa.table({"query_id": b.column("query_id").take(pa.array(which)), "app_id": pa.array([app] * len(which), pa.string()), "chunk_id": ids.take(pa.array(hit)), "score": pa.array(scores)})

    keys = ["app_id", "shard", "g"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"query_id {kind}, app_id string, chunk_id string, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank - 1).filter(F.col("rank") < k)


def search(index: BlockIndex, queries: DataFrame, k: int = params.BM25_K) -> DataFrame:
    """(query_id, app_id, chunk_id, score, rank): as ``retrieval.bm25_topk``; scores equal to nine places by chunk_id. Chunk ids are unique in an app."""
    with Workspace(queries.sparkSession) as work:
        weighted = work.settle(weigh(index, queries))
        short = work.settle(weighted.groupBy("query_id", "app_id").agg(F.count("*").alias("n")).filter(F.col("n") <= BOUNDED_TERMS).select("query_id", "app_id"))
        found = _swept(index, weighted.join(short, ["query_id", "app_id"], "left_anti"), k)
        if not short.isEmpty():
            found = found.unionByName(_bounded(index, work.settle(weighted.join(short, ["query_id", "app_id"], "left_semi")), k, work))
        return settle(_top(found, k).select("query_id", "app_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank")))


def _bounded(index: BlockIndex, weighted: DataFrame, k: int, work: Workspace) -> DataFrame:
    """(query_id, app_id, chunk_id, score) of at least the k best chunks, from the blocks that can hold them."""
    bounds = work.settle(reach(index, weighted))
    first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    seeds = work.settle(bounds.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("query_id", "app_id", "block"))
    found = work.settle(_top(_searched(index, weighted, seeds, k, work), k))
    rest = work.settle(unpruned(bounds, seeds, found, k))
    return found.drop("rank").unionByName(_searched(index, weighted, rest, k, work))
