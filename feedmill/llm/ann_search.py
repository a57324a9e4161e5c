"""Nearest neighbours by inner product, by query-centred collision counting.

Vectors are hashed by FUNCTIONS random projections, whose values are kept in levels of a byte. Around a query's own
projections windows as wide as a radius are opened, and of every vector it is counted into how many of them it falls. The
vectors with the most collisions are verified by their exact inner products. A vector as near as the k-th best so far falls into
so many of the windows at least with probability 0.87, a nearer one with more: the vectors with so many are verified too, again those
with the most first, as the k-th best draws nearer (recall is measured in the tests). Where it is far inside the radius, nearly
all windows hold what is near, and the radius is narrowed first (virtual rehashing: the same levels, other windows).

A radius that finds the nearest holds about half of all projections, so a list in order of projections would not pass
over much: counting goes through the levels as they lie, a function's bytes at a time.

An added component, which makes all vectors of a range as long as its longest, turns largest inner product into
smallest distance. Vectors are taken in ranges of similar length, the longest first, so that one very long vector
does not blur the others' distances, and a range whose longest cannot reach the k-th best is not opened.

Vectors are dealt to shards by a hash of their id and queries to blocks; every pair of a shard and a block
is one task of bounded bytes that returns its best, and the k best of those are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedmill.llm.common import field

FUNCTIONS = 160
#: A vector collides in a normal number of functions; 0.87 of them have its mean less so many deviations.
BELOW = 1.1
#: The first radius is the median distance to so many sampled vectors: there those a quarter nearer stand out by four deviations.
SAMPLE = 32
#: So many times k vectors with the most collisions are verified first, then twice as many each time. A radius of more than NARROW times the k-th best's distance becomes WIDE times it.
PROBE, NARROW, WIDE = 4, 1.8, 1.2
#: Levels for one deviation of a projection of unit vectors, and the level of 0: 5.3 deviations fit. Vectors counted at a time.
LEVELS, MIDDLE, AT_ONCE = 24.0, 128.0, 8192
#: A range ends at vectors under this part of its longest, but holds so many vectors at least.
RANGE_FALL, RANGE_ROWS = 0.85, 1024
#: Vectors of a shard at most; vectors of a shard and of a block of queries in bytes at most; tasks at least, which small tables get by more blocks.
SHARD_ROWS, MOST_BYTES, LEAST_TASKS = 32_768, 64 << 20, 24


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(dim * 1000 + 5).standard_normal((dim + 1, FUNCTIONS))


def least_collisions(radius: float, distance: float) -> int:
    """In so many windows of the radius a vector at this distance falls at least, but for one in eight. Levels are rounded, see ``collisions``."""
    wide, off = np.sqrt((np.array([radius, distance]) * LEVELS) ** 2 + 1 / 12)
    p = math.erf(wide / off / math.sqrt(2))
    return max(1, math.floor(FUNCTIONS * p - BELOW * math.sqrt(FUNCTIONS * p * (1 - p))))


class Range:
    """Levels of the projections of vectors of similar length; ``rows`` are their places in the shard."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray, room: tuple[np.ndarray, np.ndarray]):
        self.rows, self.ids, self.longest, self.parts, self.room = rows, ids[rows], float(lengths[0]), [], room
        for lo in range(0, len(rows), AT_ONCE):
            unit = vectors[rows[lo : lo + AT_ONCE]] / self.longest
            rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", unit, unit)))
            levels = np.clip(np.rint((np.column_stack([unit, rest]) @ hashes) * LEVELS + MIDDLE), 0, 255)
            self.parts.append(np.ascontiguousarray(levels.T.astype(np.uint8)))
        self.sample = vectors[rows[:: max(1, len(rows) // SAMPLE)]] / self.longest

    def first_radius(self, query: np.ndarray) -> float:
        """``query`` is of length 1."""
        return float(np.median(np.sqrt(np.maximum(0.0, 2 - 2 * (self.sample @ query)))))

    def collisions(self, at: np.ndarray, radius: float) -> np.ndarray:
        """For each vector, into how many windows of this radius around a query's projections (in levels) it falls."""
        wide = np.sqrt((radius * LEVELS) ** 2 + 1 / 12)  # levels are rounded, which adds that much to a difference's variance
        own = np.rint(at)  # an equal vector collides at any radius
        lo, hi = (np.clip(x, 0, 255).astype(np.uint8)[:, None] for x in (np.minimum(np.ceil(at - wide), own), np.maximum(np.floor(at + wide), own)))
        counts, lo_at = np.empty(len(self.rows), np.int16), 0
        for part in self.parts:
            # what is below a window wraps around to more than its width
            off = np.subtract(part, lo, out=self.room[0][: part.size].reshape(part.shape))
            within = np.less_equal(off, hi - lo, out=self.room[1][: part.size].reshape(part.shape)).view(np.uint8)
            counts[lo_at : lo_at + part.shape[1]] = np.add.reduce(within, axis=0, dtype=np.uint8)
            lo_at += part.shape[1]
        return counts


class Shard:
    """The vectors of one shard in ranges of length; ``verified`` counts the exact products computed so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.verified = ids, vectors, 0
        self.hashes = projections(vectors.shape[1])
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        order = np.argsort(-lengths, kind="stable")
        room = np.empty(FUNCTIONS * AT_ONCE, np.uint8), np.empty(FUNCTIONS * AT_ONCE, bool)  # of all ranges and queries
        self.ranges, lo = [], 0
        while lo < len(order):
            own = lengths[order]
            hi = max(int(np.searchsorted(-own, -RANGE_FALL * own[lo])), lo + RANGE_ROWS)
            if len(order) - hi < RANGE_ROWS // 2:
                hi = len(order)
            self.ranges.append(Range(order[lo:hi], vectors, own[lo:hi], self.hashes, ids, room))
            lo = hi

    def search(self, own: np.ndarray, queries: np.ndarray, k: int):
        """Yields (rows, scores) of the k best found of each query, nearest first, without the query's own id."""
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = (np.column_stack([queries / lengths[:, None], np.zeros(len(queries))]) @ self.hashes) * LEVELS + MIDDLE
        for i in range(len(queries)):
            best, scores = np.zeros(0, np.int64), np.zeros(0)
            for r in self.ranges:
                if len(best) == k and scores[-1] > lengths[i] * r.longest * (1 + 1e-12):
                    break  # no vector of this range or of a shorter one can be better
                best, scores = self._search_range(r, at[i], queries[i], lengths[i], own[i], best, scores, k)
            yield best, scores

    def _search_range(self, r: Range, at, query, length, own, best, scores, k):
        most, least, radius, counts = PROBE * k, 0, r.first_radius(query / length), None
        seen = [np.flatnonzero(r.ids == own)]  # the query's own row is no candidate
        self.verified += len(r.sample)
        while True:
            if len(best) == k:
                needed = float(np.sqrt(max(0.0, 2 - 2 * scores[-1] / (length * r.longest))))  # where the k-th best lies
                if radius > NARROW * needed + 1 / LEVELS:
                    radius, counts = WIDE * needed, None
                least = least_collisions(radius, needed)
            if counts is None:
                counts = r.collisions(at, radius)
                for rows in seen:
                    counts[rows] = -1
            hit = np.flatnonzero(counts >= least)
            if len(hit) > most:
                hit = hit[np.argpartition(counts[hit], -most)[-most:]]
            if not len(hit):
                return best, scores
            best, scores = self._verify(r.rows[hit], query, best, scores, k)
            counts[hit] = -1
            seen.append(hit)
            most *= 2

    def _verify(self, rows, query, best, scores, k):
        if not len(rows):
            return best, scores
        self.verified += len(rows)
        rows, scores = np.concatenate([best, rows]), np.concatenate([scores, np.einsum("ij,j->i", self.vectors[rows], query)])
        if len(rows) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(__id, __v) of the rows that take part: an id, a vector that is not null or zero and whose components are all finite numbers."""
    v = field(vector_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(field(id_col).isNotNull() & v.isNotNull() & ok).select(field(id_col).cast("bigint").alias("__id"), v.cast("array<double>").alias("__v"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of ``vectors`` with the largest inner
    product found, ties to the smaller id; fewer if there are fewer.

    Rows that are not usable (see ``usable``) take no part. Inner products are between vectors of equal length: those of
    several lengths are as many tables of their own. A query is not its own neighbour: rows that bear its
    id are left out. Repeated vectors are candidates each; queries that share an id are answered once, by the
    smallest vector. Empty tables give no rows. Columns but for id and vector are not read.
    """
    base, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).groupBy("__id").agg(F.min("__v").alias("__v"))
    by_size = lambda d, n: d.groupBy(F.size("__v").alias("__d")).agg(F.count("*").alias(n))
    room = F.greatest(F.lit(1), F.floor(F.lit(MOST_BYTES) / (F.col("__d") * 8)))
    shards = F.ceil(F.col("__n") / F.least(F.lit(SHARD_ROWS), room))
    blocks = F.greatest(F.ceil(F.col("__q") / room), F.least(F.ceil(F.lit(LEAST_TASKS) / shards), F.col("__q")))
    plan = F.broadcast(by_size(base, "__n").join(by_size(asked, "__q"), "__d").select("__d", shards.cast("int").alias("__shards"), blocks.cast("int").alias("__blocks")))
    deal = lambda n: F.pmod(F.xxhash64("__id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base, asked = (d.withColumn("__d", F.size("__v")).join(plan, "__d") for d in (base, asked))
    left = base.select("__d", deal("__shards").alias("__s"), each("__blocks").alias("__b"), "__id", "__v")
    right = asked.select("__d", each("__shards").alias("__s"), deal("__blocks").alias("__b"), "__id", "__v")

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            shard = Shard(vectors.column("__id").to_numpy(), _matrix(vectors.column("__v")))
            own = queries.column("__id").to_numpy()
            for i, (rows, scores) in enumerate(shard.search(own, _matrix(queries.column("__v")), k)):
                out[0].append(np.full(len(rows), own[i])), out[1].append(shard.ids[rows]), out[2].append(scores)
        a, b, c = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c, pa.float64())})

    keys = ["__d", "__s", "__b"]
    # not merged by their bytes, which are few for the work they make
    apart = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * LEAST_TASKS)
    left, right = (d.repartition(apart, *keys) for d in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
