"""Benchmark decontamination by suffix arrays over the training text.

Each task takes the documents of its partition shard by shard, sorts the suffixes of the shard's word
sequence (prefix doubling, as deep as the longest test item) and binary-searches every test suffix in it:
the neighbours of its place give its longest verbatim match, and the suffixes that begin with a whole
window give that window's occurrences. Words that no test item has end a suffix, so they are not sorted.
Texts are compared in steps of a few words, each search from where its bounds are known to agree, in groups of
bounded size, so memory does not grow with the length of an item. The test set goes to the tasks in blocks
of bounded size, one map pass each, one after the other; documents are never shuffled.

Words: A-Z lower-cased, maximal runs of ASCII letters, digits and characters beyond ASCII.
"""

from __future__ import annotations

from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedmill.llm.common import Workspace, field, row_of, settle

#: Bytes of test text per pass; words of training text per suffix array; suffixes compared at once, and words of one step at most.
BLOCK_BYTES, SHARD_WORDS = 8_000_000, 2_000_000
COMPARED, FIRST_STEP, MOST_STEP = 32_768, 4, 64

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


class TestSet:
    """Word numbers (from 1) of the test items, one after the other, with 0 behind each; their windows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items, parts = [], []
        number = lambda w: self.numbers.setdefault(w, len(self.numbers) + 1)
        for item, body in sorted(items, key=lambda x: (str(x[0]), x[1] or "")):
            w = words(body)
            if w:
                self.items.append(str(item))
                parts.append(np.fromiter(map(number, w), np.int32, len(w)))
        sizes = np.array([len(x) for x in parts], np.int64)
        self.depth = int(sizes.max(initial=0))
        self.owner = np.repeat(np.arange(len(parts)), sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        self.left = ends[self.owner] - np.arange(len(self.owner))  # words from here to the item's end
        self.text = np.zeros(len(self.owner) + MOST_STEP, np.int32)
        for x, end in zip(parts, ends):
            self.text[end - len(x) : end] = x
        own = np.minimum(window, sizes)[self.owner]  # size of the item's windows
        self.window_at = np.flatnonzero((self.left >= own) & (self.left > 0))
        self.window_len = own[self.window_at]
        self.bits = max(1, len(self.numbers).bit_length())
        self.per_key = max(1, 62 // self.bits)


def suffix_array(ids: np.ndarray, depth: int, bits: int, per_key: int) -> np.ndarray:
    """Starts of the suffixes of ``ids`` (0 ends a suffix) in order of their first ``depth`` numbers.

    ``ids`` ends with at least ``depth`` zeros.
    """
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    zero = np.flatnonzero(ids == 0)
    run = zero[np.searchsorted(zero, at)] - at
    key = np.zeros(len(at), np.int64)
    for j in range(per_key):
        key = (key << bits) | np.where(run > j, ids[at + np.minimum(j, run)], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    sa, run = at[order], run[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    rank = np.zeros(len(ids), np.int64)
    done = per_key
    while done < depth:
        rank[sa] = group + 1
        same = group[1:] == group[:-1]
        slot = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        slot = slot[run[slot] > done]
        if not len(slot):
            break
        slot = np.flatnonzero(np.isin(group, np.unique(group[slot])))
        s, r = sa[slot], run[slot]
        nxt = np.where(r > done, rank[s + np.minimum(done, r)], 0)
        full = (group[slot] << 31) | nxt
        order = np.argsort(full, kind="stable")
        sa[slot], run[slot], full = s[order], r[order], full[order]
        new = np.zeros(len(sa), bool)
        new[1:] = ~same
        new[slot[1:]] |= full[1:] != full[:-1]
        group = np.cumsum(new)
        done *= 2
    return sa


def _compare(ids, test, place, at, size, known):
    """For suffixes of ``ids`` at ``place`` and of ``test`` at ``at``, of which the first ``known`` words agree: how the first
    ``size`` words compare (-1: the first is smaller, 0: equal, 1) and how many of them agree from the start."""
    sign, agree, step = np.zeros(len(at), np.int8), known.copy(), FIRST_STEP
    open_ = np.flatnonzero(agree < size)
    while len(open_):
        n = agree[open_]
        offset = n[:, None] + np.arange(step)
        a = ids[np.minimum(place[open_][:, None] + offset, len(ids) - 1)]
        b = test[np.minimum(at[open_][:, None] + offset, len(test) - 1)]
        differ = (a != b) & (offset < size[open_][:, None])
        first, rows = differ.argmax(1), np.arange(len(open_))
        found = differ[rows, first]
        sign[open_] = np.where(found, np.where(a[rows, first] < b[rows, first], -1, 1), 0)
        agree[open_] = np.where(found, n + first, np.minimum(n + step, size[open_]))
        open_ = open_[~found & (agree[open_] < size[open_])]
        step = min(MOST_STEP, step * 4)
    return sign, agree


def _bound(ids, sa, test, at, size, after: bool):
    """For each test suffix (start ``at``, ``size`` words): how many suffixes are smaller (with ``after``: or begin with it)."""
    out = np.zeros(len(at), np.int64)
    for start in range(0, len(at), COMPARED):
        own_at, own_size = at[start : start + COMPARED], size[start : start + COMPARED]
        lo, hi = np.zeros(len(own_at), np.int64), np.full(len(own_at), len(sa), np.int64)
        below, above = np.zeros(len(own_at), np.int64), np.zeros(len(own_at), np.int64)  # words that the bounds' suffixes agree in
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            known = np.minimum(below[open_], above[open_])
            sign, agree = _compare(ids, test, sa[mid], own_at[open_], own_size[open_], known)
            less = (sign < 0) | ((sign == 0) & after)
            lo[open_], below[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, agree, below[open_])
            hi[open_], above[open_] = np.where(less, hi[open_], mid), np.where(less, above[open_], agree)
            open_ = open_[lo[open_] < hi[open_]]
        out[start : start + COMPARED] = lo
    return out


def _shared(ids, test, at, size, place):
    """Words that test suffixes and the suffixes at ``place`` have in common from their start."""
    out = np.zeros(len(at), np.int64)
    for start in range(0, len(at), COMPARED):
        own = slice(start, start + COMPARED)
        out[own] = _compare(ids, test, place[own], at[own], size[own], np.zeros(len(at[own]), np.int64))[1]
    return out


def search_shard(test: TestSet, texts: list[list[bytes]]):
    """Longest match of every test suffix in the shard, and the occurrences of the windows.

    Returns (ids, starts of the documents, sa, longest, place of a longest match, window ranges).
    """
    get = test.numbers.get
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.zeros(int(starts[-1]) + test.depth + 1, np.int32)
    for t, s in zip(texts, starts):
        ids[s : s + len(t)] = np.fromiter(map(get, t, repeat(0)), np.int32, len(t))
    sa = suffix_array(ids, test.depth, test.bits, test.per_key)
    at = np.flatnonzero(test.left > 0)
    size = test.left[at]
    if not len(sa) or not len(at):
        none = np.zeros(len(test.window_at), np.int64)
        return ids, starts, sa, at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), none, none
    low = _bound(ids, sa, test.text, at, size, False)
    before, behind = sa[np.maximum(low - 1, 0)], sa[np.minimum(low, len(sa) - 1)]
    a, b = _shared(ids, test.text, at, size, before), _shared(ids, test.text, at, size, behind)
    longest, place = np.maximum(a, b), np.where(a > b, before, behind)
    lo, hi = np.zeros(len(test.window_at), np.int64), np.zeros(len(test.window_at), np.int64)
    reach = np.zeros(len(test.text), np.int64)
    reach[at] = longest
    hit = np.flatnonzero(reach[test.window_at] >= test.window_len)
    if len(hit):
        lo[hit] = _bound(ids, sa, test.text, test.window_at[hit], test.window_len[hit], False)
        hi[hit] = _bound(ids, sa, test.text, test.window_at[hit], test.window_len[hit], True)
    return ids, starts, sa, at, longest, place, lo, hi


def mark_shard(test: TestSet, texts: list[list[bytes]]):
    """Per document a mask of its hit words and the items with occurring windows."""
    ids, starts, sa, _, _, _, lo, hi = search_shard(test, texts)
    edge, found = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
    hit = np.flatnonzero(hi > lo)
    # equal windows have one range of suffixes; each is marked once, with all items that have it
    order = hit[np.lexsort((test.window_len[hit], lo[hit]))]
    new = np.flatnonzero(np.diff(lo[order], prepend=-1) | np.diff(test.window_len[order], prepend=-1))
    for group in np.split(order, new[1:]) if len(order) else ():
        places, size = sa[lo[group[0]] : hi[group[0]]], test.window_len[group[0]]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + size, -1)
        items = set(test.owner[test.window_at[group]].tolist())
        for d in np.unique(np.searchsorted(starts, places, "right") - 1):
            found[d] |= items
    covered = np.cumsum(edge[:-1]) > 0
    return [covered[s : s + len(t)] for t, s in zip(texts, starts)], [{test.items[i] for i in f} for f in found]


def _sent(docs: DataFrame, test: TestSet):
    """A test set's plain values as a broadcast: workers need no copy of this package."""
    return docs.sparkSession.sparkContext.broadcast(SimpleNamespace(**vars(test)))


def test_sets(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """The test items in blocks of about BLOCK_BYTES, one after the other: each is collected when it is asked for."""
    rows = benchmark.select(field(id_col).cast("string").alias("i"), field(text_col).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        yield k == n - 1, TestSet([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], window)


def _shards(batches, column):
    """The batches of about SHARD_WORDS words each, with the words of every row."""
    rows, texts, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows.append(batch)
        own = [words(t.as_py()) for t in batch.column(column)]
        texts += own
        n += sum(map(len, own))
        if n >= SHARD_WORDS:
            yield rows, texts
            rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


def _pass(data: DataFrame, test: TestSet, last: bool) -> DataFrame:
    """One map pass over (row, t, hit, items, n_words, n_hit): the last four with what the items of ``test`` add. The ``last``
    pass returns neither t nor hit."""
    shared = _sent(data, test)
    schema = (data.drop("t", "hit") if last else data).schema

    def run(batches):
        for rows, texts in _shards(batches, 1):
            masks, items = mark_shard(shared.value, texts)
            at = 0
            for batch in rows:
                n = batch.num_rows
                own, hit, named = texts[at : at + n], masks[at : at + n], items[at : at + n]
                at += n
                for k, (bits, before) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    if bits is not None:  # of earlier blocks
                        hit[k] = hit[k] | np.unpackbits(np.frombuffer(bits, np.uint8), count=len(hit[k])).astype(bool)
                        named[k] = {*named[k], *before}
                found = {
                    "row": batch.column(0), "t": batch.column(1), "hit": pa.array([np.packbits(h).tobytes() for h in hit], pa.binary()), "items": pa.array(map(sorted, named), pa.list_(pa.string())),
                    "n_words": pa.array([len(w) for w in own], pa.int64()), "n_hit": pa.array([int(h.sum()) for h in hit], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([found[c] for c in schema.names], schema.names)

    return data.mapInArrow(run, schema)


def _marked(docs: DataFrame, row, text_col: str, benchmark: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """(row, n_words, n_hit, items) of ``docs``: one map pass for each block of test items; with several blocks each pass is written."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("hit", "binary"), ("items", "array<string>"), ("n_words", "bigint"), ("n_hit", "bigint"))]
    data = docs.select(row.alias("row"), field(text_col).alias("t"), *none)
    with Workspace(docs.sparkSession) as work:
        for k, (last, test) in enumerate(test_sets(benchmark, item_id, item_text, window)):
            data = _pass(data, test, last)
            if not last:
                data = work.settle(data)
            elif k:
                data = settle(data)  # what it reads goes with the workspace
    return data.select("row", "n_words", "n_hit", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``,
    ``items`` (ids as strings, sorted), ``contaminated``.

    A window is ``window`` consecutive words of an item; a shorter item that has words is one window. Null
    text has no words, null or wordless items no windows; items that share an id count once; a null id is
    the string None. Rows are independent: repeated rows repeat; empty tables give empty or clean results; other
    columns are not read, whatever their names.
    """
    found = _marked(docs, field(id_col), text_col, benchmark, window, item_id, item_text)
    return found.select(F.col("row").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns, whatever their names; cases as in ``contamination``."""
    return _marked(docs, row_of(docs), text_col, benchmark, window, item_id, item_text).filter("n_hit = 0").select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every suffix of every item (``item_id`` as string, ``item_pos`` in words) the words of its longest
    verbatim match in ``docs`` and where: ``n_match``, ``doc_id``, ``doc_pos``. Of equally long ones the
    smallest id and position found by a shard. Suffixes that match nothing are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    for last, test in test_sets(benchmark, item_id, item_text, 1):
        shared = _sent(docs, test)

        def run(batches, shared=shared):
            test = shared.value
            first = np.concatenate([[True], test.owner[1:] != test.owner[:-1]]) if len(test.owner) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(test.owner)), 0))
            for rows, texts in _shards(batches, 1):
                _, starts, _, at, longest, place, _, _ = search_shard(test, texts)
                hit = np.flatnonzero(longest)
                doc = np.searchsorted(starts, place[hit], "right") - 1
                names = pa.chunked_array([r.column(0) for r in rows]).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([test.items[test.owner[p]] for p in at[hit]], pa.string()), pa.array(at[hit] - begin[at[hit]]), pa.array(longest[hit]), names.take(pa.array(doc)), pa.array(place[hit] - starts[doc])],
                    ["item_id", "item_pos", "n_match", "doc_id", "doc_pos"],
                )

        each = docs.select(field(id_col), field(text_col)).mapInArrow(run, f"item_id string, item_pos bigint, n_match bigint, doc_id {kind}, doc_pos bigint")
        best = each.groupBy("item_id", "item_pos").agg(F.max("n_match").alias("n_match"), F.min_by(F.struct("doc_id", "doc_pos"), F.struct(-F.col("n_match"), "doc_id", "doc_pos")).alias("b"))
        part = best.select("item_id", "item_pos", "n_match", "b.doc_id", "b.doc_pos")
        if not last:
            part = settle(part)
        found = part if found is None else found.unionByName(part)
    return found
