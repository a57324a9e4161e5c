"""Ranked lexical search over whole texts, by the Best Position Algorithm.

Documents are indexed in shards where they are read. A shard keeps, for each term that some query has, its documents in
order of impact, the integer that the term adds to a document's score. A query reads its terms' lists in parallel
from the top; whatever document comes up is looked up in the query's other lists too (direct access), which gives its whole
score and marks its places there as seen. A list's best position ends its unbroken run of seen places, however they were
seen, so no unseen document can have more of a term than the impact behind it. When the sum of these is strictly below the k-th
best score the query ends; at an equal score an unseen document could still win by its id.

The k-th best is carried from shard to shard of a task, which sends on its k best of each query. Frequent terms of a shard
have arrays over its documents for direct access, rare ones are short enough to be searched whole. Queries travel in blocks of bounded
size; two passes over the texts serve a block, one for the counts of documents and terms, one for the search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedmill.llm.common import Workspace, field, settle

#: Bytes of query texts in a block, about. A shard ends at so many documents or so many places of its lists.
BLOCK_BYTES, SHARD_DOCS, SHARD_PLACES = 4 << 20, 16_384, 4_000_000
#: A term that one of so many documents has is frequent. Documents read from each list in the first step; steps double.
FREQUENT, FIRST_STEP = 8, 16

#: ASCII letters and digits and all characters beyond ASCII make terms.
_TO_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A to Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def weight(documents: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))"""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_norm(n, documents: int, total: int):
    """m of documents with ``n`` terms: 75 plus 25 times the length over the mean length, in whole numbers."""
    return 75 + (25 * n * documents) // max(total, 1)


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """Impact lists of some documents, which are numbered in the order of ties: of equally good ones the lower number wins.

    ``doc``, ``impacts`` and ``bounds`` are the lists, one behind the other; ``dense`` has for frequent terms each document's impact and place.
    """

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((doc, -impacts, term))
        self.n_docs, self.doc, self.impacts = n_docs, doc[order], impacts[order]
        counts = np.bincount(term, minlength=n_terms)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t in np.flatnonzero(counts * FREQUENT > n_docs).tolist():
            docs, values = self.entries(t)
            by_doc, place = np.zeros(n_docs, np.int64), np.full(n_docs, len(docs), np.int32)
            by_doc[docs], place[docs] = values, np.arange(len(docs), dtype=np.int32)
            self.dense[t] = by_doc, place
        self.slot = np.full(n_docs, -1, np.int64)
        self.accessed = 0

    def entries(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[self.bounds[t] : self.bounds[t + 1]], self.impacts[self.bounds[t] : self.bounds[t + 1]]

    def search(self, query: list[tuple[int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of those that score above 0 and not below ``floor``, best first. ``query`` are (term, times)."""
        lists = [(t, times, *self.entries(t)) for t, times in query if self.bounds[t] < self.bounds[t + 1]]
        seen = [np.zeros(len(docs) + 1, bool) for _, _, docs, _ in lists]  # one more: places of documents that are not in the list
        best_at = [0] * len(lists)  # places seen without a gap from the top
        known = np.zeros(self.n_docs, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, step = 0, FIRST_STEP
        while lists:
            read = [docs[lo : lo + step] for _, _, docs, _ in lists]
            new = np.unique(np.concatenate(read))
            new = new[~known[new]]
            known[new] = True
            self.accessed += len(new)
            total = np.zeros(len(new), np.int64)
            self.slot[new] = np.arange(len(new))
            for (t, times, docs, values), marks in zip(lists, seen):
                if t in self.dense:
                    by_doc, place = self.dense[t]
                    total += times * by_doc[new]
                    marks[place[new]] = True
                else:
                    slot = self.slot[docs]
                    hit = np.flatnonzero(slot >= 0)
                    total[slot[hit]] += times * values[hit]
                    marks[hit] = True
            self.slot[new] = -1
            found, scores = np.concatenate([found, new]), np.concatenate([scores, total])
            keep = np.lexsort((found, -scores))[:k]
            found, scores = found[keep], scores[keep]
            bound = 0
            for i, ((_, times, docs, values), marks) in enumerate(zip(lists, seen)):
                marks[-1] = False  # so that the run ends behind the list at the latest
                best_at[i] += int(np.argmin(marks[best_at[i] :]))
                if best_at[i] < len(docs):  # no unseen document has more of the term than the first unseen place
                    bound += times * int(values[best_at[i]])
            kth = max(floor, int(scores[k - 1]) if len(scores) >= k else 0)
            if bound < kth or not bound:
                break
            lo, step = lo + step, step * 2
        good = (scores > 0) & (scores >= floor)
        return found[good], scores[good]


class Builder:
    """Collects documents until a shard is full."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, documents: int, total: int):
        self.vocabulary, self.weights, self.documents, self.total = vocabulary, weights, documents, total
        self.clear()

    def clear(self) -> None:
        self.ids, self.terms, self.tfs, self.ms, self.places = [], [], [], [], 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        """A document that has none of the queries' terms cannot be found and is passed over."""
        known = np.array([t for t in map(self.vocabulary.get, words) if t is not None], np.int64)
        if not len(known):
            return
        terms, tf = np.unique(known, return_counts=True)
        self.ids.append(doc_id), self.terms.append(terms), self.tfs.append(tf), self.ms.append(length_norm(len(words), self.documents, self.total))
        self.places += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.places >= SHARD_PLACES

    def shard(self) -> tuple[Shard, list[int | None]]:
        """The collected documents as a shard, and their ids in its order: ascending, null first."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        sizes = [len(self.terms[i]) for i in order]
        doc = np.repeat(np.arange(len(order)), sizes)
        term, tf = (np.concatenate([x[i] for i in order]) for x in (self.terms, self.tfs))
        m = np.repeat(np.array([self.ms[i] for i in order], np.int64), sizes)
        out = Shard(len(order), doc, term, self.weights[term] * impact(tf.astype(np.int64), m), len(self.weights)), [self.ids[i] for i in order]
        self.clear()
        return out


def _counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> tuple[int, int, np.ndarray]:
    """(N, L, df): documents with a term, all their terms, documents that hold each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, df, n, total = shared.value, np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                words = terms_of(text.as_py())
                n, total = n + bool(words), total + len(words)
                held = {known[w] for w in set(words) & known.keys()}
                df[np.fromiter(held, np.int64, len(held))] += 1
        some = np.flatnonzero(df)
        # the two sums travel as terms -1 and -2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]).astype(np.int64)), pa.array(np.concatenate([[n, total], df[some]]).astype(np.int64))], ["t", "n"])

    rows = docs.select(field(text_col).alias("text")).mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    # as many rows as a block of queries has terms, and two
    got, df = {r.t: r.n for r in rows.collect()}, np.zeros(len(vocabulary), np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return got.get(-1, 0), got.get(-2, 0), df


def _search_block(docs: DataFrame, block: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """(query, doc_id, score) with the k best of each query of ``block`` ((number, text) rows) from every task."""
    vocabulary: dict[bytes, int] = {}
    queries = []
    for number, text in block:
        times: dict[int, int] = {}
        for w in terms_of(text):
            t = vocabulary.setdefault(w, len(vocabulary))
            times[t] = times.get(t, 0) + 1
        queries.append((number, list(times.items())))
    documents, total, df = _counts(docs, vocabulary, id_col, text_col)
    weights = np.array([weight(documents, int(n)) for n in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights, documents, total, queries))

    def run(batches):
        vocabulary, weights, documents, total, queries = shared.value
        builder, best = Builder(vocabulary, weights, documents, total), [([], []) for _ in queries]

        def search():
            shard, ids = builder.shard()
            for i, (_, query) in enumerate(queries):
                own_ids, own_scores = best[i]
                found, scores = shard.search(query, k, own_scores[-1] if len(own_scores) >= k else 0)
                if len(found):
                    rows = sorted([*zip(own_scores, own_ids), *zip(scores.tolist(), [ids[d] for d in found])], key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[:k]
                    best[i] = [r[1] for r in rows], [r[0] for r in rows]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                builder.add(doc_id, terms_of(text.as_py()))
                if builder.full():
                    search()
        if builder.ids:
            search()
        of = [np.full(len(ids), number, np.int64) for (number, _), (ids, _) in zip(queries, best)]
        columns = [np.concatenate([np.zeros(0, np.int64), *of]), [d for ids, _ in best for d in ids], [s for _, scores in best for s in scores]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "doc_id", "score"])

    data = docs.select(field(id_col).cast("bigint").alias("id"), field(text_col).alias("text"))
    return data.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each query, all if fewer, best first,
    equal scores by ascending id, null first.

    A document's score sums weight times impact over the query's terms, repeats included; the numbers are whole. Null texts have
    no terms; a query without terms, or whose terms no document has, finds nothing. Repeated documents are documents each. Queries that share an
    id, or have none, are one: the first by text, null first. Texts are read whole. Empty tables give no rows; other columns are not read.
    """
    with Workspace(docs.sparkSession) as work:
        text = F.coalesce(field(query_text).cast("string"), F.lit(""))
        asked = queries.select(field(query_id).alias("id"), text.alias("text")).groupBy("id").agg(F.min("text").alias("text"))
        # the number of a query and its block: blocks hold about as many bytes each, and are collected one at a time
        numbered = work.settle(asked.withColumn("number", F.monotonically_increasing_id()))
        size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = -(-size // BLOCK_BYTES)
        numbered = numbered.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(max(1, blocks))))
        found = None
        for b in range(blocks):
            block = [(r.number, r.text) for r in numbered.filter(F.col("block") == b).select("number", "text").collect()]
            part = work.settle(_search_block(docs, block, k, id_col, text_col))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return docs.sparkSession.createDataFrame([], numbered.select(F.col("id").alias(query_id)).schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = top.join(numbered.select(F.col("number").alias("query"), "id"), "query")
        return settle(named.select(F.col("id").alias(query_id), "rank", "doc_id", "score"))
