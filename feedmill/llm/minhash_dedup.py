"""Near-duplicate documents by MinHash with tensored banding, confirmed on the full shingle sets.

Each document gets two small collections of half keys: MX of RX minima each and MY of RY minima each. A table
key is a pair of one half key from each, so MX * MY tables of RX + RY minima come from MX * RX + MY * RY
minima, about the root of what the tables hold, times a few. Half keys of the first collection that nobody shares cannot
form a shared table key, so they are dropped before pairs are formed. Candidates are confirmed by exact set sizes:

1. documents with equal shingle sets are one class, represented by its smallest id;
2. in each table bucket all members are held against the bucket's smallest id, links are confirmed,
   components formed;
3. first halves under which some bucket still holds several components are taken again: every two members of
   different components that share such a half, and a second half with it, share a table; unless sizes, signatures (the
   share of equal places lies 4 deviations under what the threshold gives) or bitmaps of the sets (they bound the
   intersection, without error) rule them out, they are confirmed as well, under the first half that the two
   share, and the components are merged.

So a bucket of n copies costs about n pairs, and a candidate pair goes unconfirmed only where both ends are
known to be connected. A third step over whole table keys would carry a document MY times as often, for the same pairs:
the first halves are long enough to be nearly as selective as the tables. A pair at similarity 0.75 shares a
table with probability 0.9998.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedmill.llm.common import Workspace, field, row_of, settle
from feedmill.llm.components import components

SHINGLE = 5
#: Half keys of the two collections, and the minima of each.
MX, RX, MY, RY = 48, 6, 12, 2
#: Minima of the signature: those of the half keys and some more. Two bits of each are kept.
SIGNATURE = 384
#: Equal places of 384 that a pair at 0.75 (expected: 312) reaches but for one in 40,000; at 0.8 all but surely.
LEAST_EQUAL = 280
#: Places of a set's bitmap.
BITMAP = 1024
WORDS_KEPT = 300_000

_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 2**32, (SIGNATURE, 1), np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, (SIGNATURE, 1), np.uint32)
_PLACE = _RNG.integers(0, 2**64, SHINGLE + 1, np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 2**64, max(RX, RY) + 1, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray, turn: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    x = x + np.uint64(turn)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter; empty without words.

    Words: A-Z lower-cased, runs without ASCII white space.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return _mix((w * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    h = w[: n - SHINGLE + 1] * _PLACE[0]
    for j in range(1, SHINGLE):
        h += w[j : n - SHINGLE + 1 + j] * _PLACE[j]
    return np.unique(_mix(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of SIGNATURE hash functions; wide sets are taken in parts."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    for lo in range(0, len(short), 1024):
        part = short[None, lo : lo + 1024] * _MULTIPLY
        part += _ADD
        part = part.min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint64)


def signature(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 of them to a long."""
    bits = (_mix(least, 3) >> np.uint64(62)).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITMAP bits in longs: those at the places of the set's hashes."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(shingles % np.uint64(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def half_keys(least: np.ndarray) -> np.ndarray:
    """MX + MY half keys; the first MX are one collection, the others the second. Half keys of different places differ."""
    first, second = least[: MX * RX].reshape(MX, RX), least[MX * RX : MX * RX + MY * RY].reshape(MY, RY)
    folded = np.concatenate([(first * _FOLD[:RX]).sum(axis=1, dtype=np.uint64), (second * _FOLD[:RY]).sum(axis=1, dtype=np.uint64)])
    return _mix(folded + np.arange(MX + MY, dtype=np.uint64) * _FOLD[-1])


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def sign_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __n, __s1, __s2, __keys, __sig, __map): set size, 128-bit set digest, half keys, signature, bitmap."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            n, s1, s2, keys, sig, maps = [], [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes)
                n.append(len(s))
                if not len(s):
                    s1.append(0), s2.append(0), keys.append(None), sig.append(None), maps.append(None)
                    continue
                least = minima(s)
                s1.append(int(_signed(_mix(s, 1).sum(dtype=np.uint64, keepdims=True))[0]))
                s2.append(int(_signed(_mix(s, 2).sum(dtype=np.uint64, keepdims=True))[0]))
                keys.append(_signed(half_keys(least)))
                sig.append(_signed(signature(least)))
                maps.append(_signed(bitmap(s)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, longs), pa.array(sig, longs), pa.array(maps, longs)],
                ["__id", "__n", "__s1", "__s2", "__keys", "__sig", "__map"],
            )

    source = docs.select(field(id_col).cast("bigint").alias("__id"), field(text_col).alias("__text"))
    return source.mapInArrow(run, "__id bigint, __n bigint, __s1 bigint, __s2 bigint, __keys array<bigint>, __sig array<bigint>, __map array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(__id, __set) of (__id, __text) rows."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            sets = [_signed(shingle_set(t.as_py(), hashes)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["__id", "__set"])

    return docs.mapInArrow(run, "__id bigint, __set array<bigint>")


def _may_link(n1: str, n2: str, s1: str, s2: str) -> Column:
    """Whether set sizes and signatures allow a link: places of two bits are unequal where either bit of the xor is set."""
    unequal = []
    for k in range(SIGNATURE // 32):
        x = f"({s1}[{k}] ^ {s2}[{k}])"
        unequal.append(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {0x5555555555555555}L)")
    return (F.least(n1, n2) * 4 >= F.greatest(n1, n2) * 3) & (F.expr(" + ".join(unequal)) <= SIGNATURE - LEAST_EQUAL)


def _may_overlap(n1: str, n2: str, m1: str, m2: str) -> Column:
    """Whether bitmaps allow a link: each place that only one of the two has stands for a shingle or more that the other set
    lacks, which bounds the intersection from above. Dearer than ``_may_link``, so it comes last."""
    lone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    common = F.least(F.col(n1) - lone(m1, m2), F.col(n2) - lone(m2, m1))
    return common * 7 >= (F.col(n1) + F.col(n2)) * 3


def _confirm(pairs: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets have 100 * intersection >= 75 * union.

    ``docs`` (__id, __text) are all rows; the sets are made anew from the texts of the pairs' ends only.
    """
    ends = pairs.select(F.col("a").alias("__id")).unionByName(pairs.select(F.col("b").alias("__id"))).distinct()
    sets = work.settle(shingle_sets(docs.join(ends.hint("merge"), "__id", "left_semi").select("__id", "__text")))
    # merge joins at every size: texts and sets are never broadcast
    left = pairs.join(sets.select(F.col("__id").alias("a"), F.col("__set").alias("__sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("__id").alias("b"), F.col("__set").alias("__sb")).hint("merge"), "b")
    common = F.size(F.array_intersect("__sa", "__sb"))
    union = F.size("__sa") + F.size("__sb") - common
    return work.settle(both.filter(common * 100 >= union * 75).select("a", "b"))


def _with_bodies(pairs: DataFrame, body: DataFrame) -> DataFrame:
    for end in "ab":
        pairs = pairs.join(body.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("sig").alias(f"s{end}"), F.col("map").alias(f"m{end}")), end)
    return pairs


def _star_links(halves: DataFrame, classes: DataFrame, source: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Step 2. Returns the table rows (rep, x, y) and the confirmed links of all members to their bucket's smallest."""
    seconds = classes.select("rep", F.slice("keys", MX + 1, MY).alias("ys"))
    tables = work.settle(halves.select("rep", "x").join(seconds, "rep").select("rep", "x", F.explode("ys").alias("y")))
    # written, so that the join has a plain shuffle on both sides, which can be split at a hot bucket
    buckets = work.settle(tables.groupBy("x", "y").agg(F.count("*").alias("c"), F.min("rep").alias("a")).filter("c > 1").select("x", "y", "a"))
    stars = work.settle(tables.join(buckets, ["x", "y"]).filter("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    screened = work.settle(_with_bodies(stars, classes).filter(_may_link("na", "nb", "sa", "sb") & _may_overlap("na", "nb", "ma", "mb")).select("a", "b"))
    return tables, _confirm(screened, source, work)


def _cross_links(halves: DataFrame, tables: DataFrame, first: DataFrame, classes: DataFrame, source: DataFrame, work: Workspace) -> DataFrame | None:
    """Step 3. The confirmed links between members of different components of a bucket; None without candidates."""
    named = first.withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep").alias("comp")
    mixed = tables.join(named, "rep", "left").select("x", "y", component).groupBy("x", "y").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.filter("lo <> hi").select("x").distinct()
    open_ = halves.join(mixed, "x", "left_semi").join(named, "rep", "left").select("x", "i", "rep", component)
    earlier, seconds = F.expr("slice(keys, 1, i)").alias("earlier"), F.slice("keys", MX + 1, MY).alias("ys")
    open_ = work.settle(open_.join(classes, "rep").select("x", "rep", "comp", "n", "sig", "map", earlier, seconds))
    a, b = (open_.select(*[F.col(c).alias(f"{c}{s}") for c in open_.columns]) for s in "ab")
    in_table = (F.col("xa") == F.col("xb")) & F.arrays_overlap("ysa", "ysb") & ~F.arrays_overlap("earliera", "earlierb")
    cross = a.join(b, (F.col("compa") < F.col("compb")) & _may_link("na", "nb", "siga", "sigb") & in_table & _may_overlap("na", "nb", "mapa", "mapb"))
    cross = work.settle(cross.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b")).distinct())
    return None if cross.isEmpty() else _confirm(cross, source, work)


def _merge(first: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) after ``links`` between members of the components ``first``."""
    of = lambda c: first.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"c{c}"))
    named = links.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    bridges = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    top = work.settle(components(bridges, work))
    nodes = first.unionByName(top.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    above = top.select(F.col("node").alias("component"), F.col("component").alias("__top"))
    return nodes.join(above, "component", "left").select("node", F.coalesce("__top", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id that links reach, itself
    included) and ``kept`` (id = component_id).

    Two documents are linked if 100 * |intersection| >= 75 * |union| of their sets of distinct 5-word
    shingles; a text of 1 to 4 words has one shingle; null, empty and wordless texts have none and are
    linked with nothing. Ids are whole numbers. Rows that share an id are one node: what one of them is
    linked with, all are, and all have the flag of the id. A row without id stays alone: component null,
    kept true. An empty table gives an empty table; other columns are not read, whatever their names.
    """
    source = docs.select(field(id_col).cast("bigint").alias("__id"), field(text_col).alias("__text"))
    with Workspace(docs.sparkSession) as work:
        signed = work.settle(sign_documents(docs, id_col, text_col))
        real = signed.filter("__n > 0 and __id is not null")
        bodies = F.min("__id").alias("rep"), F.first("__n").alias("n"), F.first("__keys").alias("keys"), F.first("__sig").alias("sig"), F.first("__map").alias("map")
        classes = work.settle(real.groupBy("__s1", "__s2").agg(*bodies))
        firsts = classes.select("rep", F.posexplode(F.slice("keys", 1, MX)).alias("i", "x"))
        shared = work.settle(firsts.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1").select("x"))
        halves = work.settle(firsts.join(shared, "x").select("rep", "i", "x"))
        tables, links = _star_links(halves, classes, source, work)
        found = work.settle(components(links, work))
        more = _cross_links(halves, tables, found, classes, source, work)
        if more is not None:
            found = work.settle(_merge(found, more, work))
        named = classes.select("__s1", "__s2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("__s1", "__s2", F.coalesce("component", "rep").alias("component"))
        # rows without shingles or id are not sent to one key of the join
        narrow = signed.select("__id", "__n", "__s1", "__s2")
        linked = narrow.filter("__n > 0 and __id is not null").join(named, ["__s1", "__s2"]).select("__id", "__n", "component")
        alone = narrow.filter("__n = 0 or __id is null").select("__id", "__n", F.col("__id").alias("component"))
        out = settle(linked.unionByName(alone))
    return out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("__id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever their names; of rows that
    share an id one stays (the one with the least hash of its text; rows without id all stay)."""
    kept = near_duplicates(docs, id_col, text_col).toDF("id", "n", "component", "kept").filter("kept and id is not null").select("id").distinct()
    rows = docs.select(field(id_col).cast("bigint").alias("id"), F.xxhash64(field(text_col)).alias("h"), row_of(docs).alias("row"))
    numbered = rows.filter("id is not null").join(kept, "id").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("h")))
    return numbered.filter("k = 1").select("row.*").unionByName(rows.filter("id is null").select("row.*"))
