"""Approximate vector top k by inverted lists of quantised vectors, with exact rescoring.

Vectors, made of length 1, are dealt to the cells of a k-means over a bounded sample; what a vector differs from its
cell's centre by is coded in a byte for every SUB dimensions, by the nearest of 256 code words. A query visits the cells with
the nearest centres, sums up distances from tables of its distances to the code words, and takes its best few candidates.
Their original vectors give the exact distances. Lists are stored by app and cell; large ones are split into parts of
bounded size, so neither a common vector nor a large app makes one task large.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedmill import params
from feedmill.storage import Workspace, settle

#: Dimensions of a code byte; most cells, vectors of a cell on average; bytes of the sample; k-means rounds.
SUB, MOST_CELLS, CELL_ROWS, SAMPLE_BYTES, ROUNDS = 4, 4096, 128, 64 << 20, 8
#: Share of the cells that a query visits, and the least number; candidates for each result; codes of a part of a list; queries of a group.
VISITED, LEAST_VISITED, CANDIDATES, PART_ROWS, GROUP_QUERIES = 0.25, 12, 12, 100_000, 4096
#: Numbers that a task holds at once when queries are repeated for their cells.
VISIT_NUMBERS = 4_000_000


class Quantizer(NamedTuple):
    """``centres`` of the cells and ``words`` (parts, 256, SUB); vectors are padded with zeros to a whole number of parts."""

    centres: np.ndarray
    words: np.ndarray

    def padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.centres.shape[1] - v.shape[1])))

    def cells(self, v: np.ndarray) -> np.ndarray:
        return _nearest(v, self.centres)

    def codes(self, v: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = v - self.centres[cells]
        return np.stack([_nearest(rest[:, m * SUB : m * SUB + SUB], w) for m, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of a cell's coded vectors."""
        rest = (query - self.centres[cell]).reshape(len(self.words), 1, SUB)
        table = ((rest - self.words) ** 2).sum(axis=2)
        return table[np.arange(len(self.words)), codes].sum(axis=1)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size, out = (centres**2).sum(axis=1), []
    step = max(1, 4_000_000 // len(centres))
    for lo in range(0, len(v), step):
        out.append((size - 2 * (v[lo : lo + step] @ centres.T)).argmin(axis=1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _means(v: np.ndarray, k: int, rnd: np.random.Generator) -> np.ndarray:
    """k-means; a cell without vectors keeps its centre."""
    centres = v[rnd.permutation(len(v))[:k]]
    centres = np.concatenate([centres, np.zeros((k - len(centres), v.shape[1]))])
    for _ in range(ROUNDS):
        own = _nearest(v, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, v[:, d], minlength=k) for d in range(v.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, cells: int) -> Quantizer:
    """The quantizer of a sample of vectors of length 1."""
    rnd = np.random.default_rng(11)
    v = np.pad(sample, ((0, 0), (0, -sample.shape[1] % SUB)))
    centres = _means(v, cells, rnd)
    rest = v - centres[_nearest(v, centres)]
    return Quantizer(centres, np.stack([_means(rest[:, lo : lo + SUB], 256, rnd) for lo in range(0, v.shape[1], SUB)]))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _units(rows: DataFrame, *names: str) -> DataFrame:
    """(names, d, v): vectors of length 1; null, zero and not finite ones are left out."""
    v = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    found = rows.filter("size(embedding) > 0").select(*names, v.alias("v")).withColumn("__l", length).filter("__l > 0 and __l < double('infinity')")
    return found.select(*names, F.size("v").alias("d"), F.transform("v", lambda x: x / F.col("__l")).alias("v"))


class VectorIndex(NamedTuple):
    """``lists`` (app_id, d, cell, chunk_id, code), ``vectors`` (app_id, d, chunk_id, v) and the ``quantizers`` of each dimension."""

    lists: DataFrame
    vectors: DataFrame
    quantizers: dict[int, Quantizer]


def build_index(chunks: DataFrame, keep=settle, cells: int | None = None) -> VectorIndex:
    """The index of (app_id, chunk_id, embedding) chunks; its tables are written by ``keep``.

    The quantizer of each dimension is fitted to at most SAMPLE_BYTES of vectors, taken by a hash; every vector is indexed. ``cells``
    is a cell for CELL_ROWS vectors without it.
    """
    vectors = keep(_units(chunks, "app_id", "chunk_id"))
    quantizers = {}
    for r in vectors.groupBy("d").count().collect():  # a row for each dimension
        most = SAMPLE_BYTES // (8 * r.d)
        part = vectors.filter(F.col("d") == r.d)
        if r["count"] > most:
            part = part.filter(F.pmod(F.xxhash64("chunk_id", "app_id"), F.lit(1_000_003)) < int(1_000_003 * most / r["count"]))
        sample = _matrix(part.select("v").toArrow().column("v")) if r["count"] else np.zeros((0, r.d))
        if len(sample):
            quantizers[r.d] = fit(sample, cells or min(MOST_CELLS, max(1, r["count"] // CELL_ROWS)))
    shared = chunks.sparkSession.sparkContext.broadcast(quantizers)  # MOST_CELLS centres and 256 vectors at most for each dimension

    def code(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            d = table.column("d").to_numpy()
            for n in np.unique(d).tolist():
                own = table.filter(pa.array(d == n))
                q = shared.value[n]
                v = q.padded(_matrix(own.column("v")))
                cell = q.cells(v)
                out = own.drop_columns(["v"]).append_column("cell", pa.array(cell.astype(np.int32))).append_column("code", pa.array([c.tobytes() for c in q.codes(v, cell)], pa.binary()))
                yield from out.to_batches()

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    lists = keep(vectors.select("app_id", "chunk_id", "d", "v").mapInArrow(code, f"app_id string, chunk_id {kind}, d int, cell int, code binary"))
    return VectorIndex(lists, vectors, quantizers)


def write_index(chunks: DataFrame, path: str) -> None:
    """Store the index below ``path``, its tables by app, the quantizers as rows."""
    spark = chunks.sparkSession
    with Workspace(spark) as work:
        index = build_index(chunks, work.settle)
        for name in ("lists", "vectors"):
            getattr(index, name).write.mode("overwrite").partitionBy("app_id").parquet(f"{path}/{name}")
        rows = [(d, k, n, row.ravel().tolist()) for d, q in index.quantizers.items() for k, part in (("centre", q.centres), ("words", q.words)) for n, row in enumerate(part)]
        spark.createDataFrame(rows, "d int, kind string, n int, numbers array<double>").write.mode("overwrite").parquet(f"{path}/quantizers")


def read_index(spark: SparkSession, path: str, chunk_type: str = "string") -> VectorIndex:
    own = lambda n, more: spark.read.schema(f"chunk_id {chunk_type}, d int, {more}, app_id string").parquet(f"{path}/{n}")
    parts: dict = {}
    for r in spark.read.schema("d int, kind string, n int, numbers array<double>").parquet(f"{path}/quantizers").orderBy("d", "kind", "n").collect():
        parts.setdefault((r.d, r.kind), []).append(r.numbers)
    quantizers = {d: Quantizer(np.array(rows), np.array(parts[d, "words"]).reshape(-1, 256, SUB)) for (d, kind), rows in parts.items() if kind == "centre"}
    return VectorIndex(own("lists", "cell int, code binary"), own("vectors", "v array<double>"), quantizers)


def search(index: VectorIndex, queries: DataFrame, k: int = params.VECTOR_K, similarity: float = params.SIMILARITY, visited: float = VISITED) -> DataFrame:
    """(query_id, app_id, chunk_id, distance, rank): the k nearest chunks found by cosine distance, then those within 1 - similarity.

    Distances are exact; a near chunk can be missed. ``visited`` is the share of the cells that a query visits. Equal distances by chunk_id.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index.quantizers)
    query_kind, chunk_kind = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (index.lists, "chunk_id")))

    def visits(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            d = table.column("d").to_numpy()
            for n in np.unique(d).tolist():
                q = shared.value.get(n)
                if q is None:
                    continue
                own = table.filter(pa.array(d == n))
                v = q.padded(_matrix(own.column("v")))
                m = min(len(q.centres), max(LEAST_VISITED, int(np.ceil(visited * len(q.centres)))))
                # a few queries at a time: each is repeated, with its vector, for every cell that it visits
                step = max(1, VISIT_NUMBERS // (m * n + len(q.centres)))
                for lo in range(0, len(v), step):
                    far = (q.centres**2).sum(axis=1) - 2 * (v[lo : lo + step] @ q.centres.T)
                    near = np.argpartition(far, m - 1, axis=1)[:, :m]
                    out = own.take(pa.array(np.repeat(np.arange(lo, lo + len(far)), m))).append_column("cell", pa.array(near.ravel().astype(np.int32)))
                    yield from out.to_batches()

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            q, cell = shared.value[a.column("d")[0].as_py()], a.column("cell")[0].as_py()
            codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(a.num_rows, -1)
            for i, v in enumerate(q.padded(_matrix(b.column("v")))):
                distance = q.distances(v, cell, codes)
                near = np.argpartition(distance, most - 1)[:most] if len(distance) > most else np.arange(len(distance))
                rows.append(np.full(len(near), i)), found.append(near), far.append(distance[near])
        which, hit = pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(found).astype(np.int64))
        return pa.table({"query_id": b.column("query_id").take(which), "app_id": b.column("app_id").take(which), "chunk_id": a.column("chunk_id").take(hit), "near": pa.array(np.concatenate(far))})

    most = k * CANDIDATES
    with Workspace(spark) as work:
        asked = work.settle(_units(queries, "query_id", "app_id"))
        visiting = work.settle(asked.select("query_id", "app_id", "d", "v").mapInArrow(visits, f"query_id {query_kind}, app_id string, d int, v array<double>, cell int"))
        place = ["app_id", "d", "cell"]
        parts = index.lists.groupBy(*place).agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).join(visiting.groupBy(*place).agg(F.ceil(F.count("*") / GROUP_QUERIES).alias("groups")), place)
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        left = index.lists.join(parts, place).withColumn("part", deal("chunk_id", "parts")).withColumn("group", each("groups")).drop("parts", "groups")
        right = visiting.join(parts, place).withColumn("group", deal("query_id", "groups")).withColumn("part", each("parts")).drop("parts", "groups")
        keys = [*place, "part", "group"]
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, f"query_id {query_kind}, app_id string, chunk_id {chunk_kind}, near double")
        few = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "chunk_id"))).filter(F.col("r") <= most)
        few = work.settle(few.select("query_id", "app_id", "chunk_id"))
        both = few.join(index.vectors.withColumnRenamed("v", "c"), ["app_id", "chunk_id"]).join(asked, ["query_id", "app_id", "d"])
        dot = F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        exact = both.select("query_id", "app_id", "chunk_id", F.round(1 - dot, 9).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id")) - 1
        return settle(exact.withColumn("rank", rank).filter((F.col("rank") < k) & (F.col("distance") <= 1 - similarity)))
