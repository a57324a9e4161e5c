"""Keyed tables in versions: merges that appear at once or not at all, and open only files that may hold their keys.

A version is a manifest, the list of the table's Parquet files with app and bucket (a hash of the key), and a small pointer
file named by the version's number. A merge writes its files, their index and the next manifest aside and then renames the
pointer into its place, which must be free. Of two writers on one version the later finds it taken and merges
again on top of the other's; one that is killed leaves files that no version names. Earlier versions stay readable until
``expire``. The rename must be atomic and fail if the name is taken, as HDFS's does.

The index is a Bloom filter for each file in blocks of 4 KB: a key sets PROBES bits in one block. A merge looks its keys up
in the blocks of the files of its own apps and buckets; a file none of whose blocks has all bits of a key is not opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedmill.sources.tables import first_of_key
from feedmill.storage import Workspace, names_in, publish, read_text, remove

#: Bits of a block, bits set for a key, keys of a block on average: one lookup in 50 to 100 of an absent key finds all bits set.
BLOCK_BITS, PROBES, BLOCK_KEYS = 32_768, 6, 3_277
#: Parts of a bucket that a merge's shuffle keeps apart: it has up to so many tasks for each bucket, and an app's bucket so many new files.
PARTS = 8
_MANIFEST = "file string, app_id string, bucket int, rows bigint, blocks bigint, token string"


class VersionedTable:
    """A table at ``path`` of rows of ``schema`` (DDL, with ``app_id``) with unique ``keys``. A key belongs to one app; rows with a
    null in a key or without app cannot be told from their replay, or placed, and are left out of every merge.

    ``opened`` and ``passed`` count the files that the last merge had to read and those of its apps and buckets that it had not.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.opened = self.passed = 0

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.path}/versions") if n.isdigit())

    def _pointer(self, version: int | None = None) -> dict:
        have = self.versions()
        if version is None and not have:
            return {"version": 0, "manifest": None, "applied": {}}
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version if version is not None else have[-1]:012d}"))

    def _manifest(self, pointer: dict) -> DataFrame:
        if pointer["manifest"] is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{pointer['manifest']}")

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self, app_id: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; of one app, whose files alone are read. File names pass through the driver."""
        manifest = self._manifest(self._pointer(version))
        files = manifest if app_id is None else manifest.filter(F.col("app_id") == app_id)
        rows = self._rows([r.file for r in files.select("file").distinct().collect()])
        return rows if app_id is None else rows.filter(F.col("app_id") == app_id)

    # merges

    def upsert(self, batch: DataFrame, order: list[str], source: tuple[str, int] | None = None) -> int:
        """Put the rows in by key: a new row replaces the old, of equal keys the last in ``order`` wins. Returns the version."""
        return self._merge(batch, [F.desc(c) for c in order], True, source)

    def insert_or_ignore(self, batch: DataFrame, order: list[str], source: tuple[str, int] | None = None) -> int:
        """Append the rows whose keys are new: existing rows win, of equal keys the first in ``order``. Returns the version.

        ``source`` (name, number) marks a numbered batch; one that is not above the last applied number of its name
        changes nothing, so a batch that is run again after a failure is applied once.
        """
        return self._merge(batch, order, False, source)

    def append(self, batch: DataFrame, order: list[str], source: tuple[str, int] | None = None) -> int:
        """As ``insert_or_ignore`` for rows that are known to be new: no file is opened."""
        return self._merge(batch, order, None, source)

    def _merge(self, batch: DataFrame, order: list, replace: bool | None, source: tuple[str, int] | None) -> int:
        keyed, new = batch.dropna(subset=[*self.keys, "app_id"]), None
        with Workspace(self.spark) as work:
            if replace is False:
                keyed = work.settle(keyed.select(*dict.fromkeys([*self.columns, *order])))
            while True:
                at = self._pointer()
                if source and at["applied"].get(source[0], -1) >= source[1]:
                    return at["version"]
                manifest, gone, rest = self._manifest(at), [], []
                if replace is False:
                    # keys that are there stand before the batch's in its only shuffle, and drop out after it
                    held = self._rows(self._may_hold(keyed, manifest)).select(*self.keys, F.lit(False).alias("__new"))
                    both = keyed.withColumn("__new", F.lit(True)).unionByName(held, allowMissingColumns=True)
                    new = self._write(work, self._first(both, ["__new", *order]).filter("__new"))
                else:
                    # the batch is put in its place once, whatever happens to the version below it
                    new = new or self._write(work, self._first(keyed, order))
                    if replace:
                        rows = self._rows_in(new[0])
                        gone, partly = self._losing(self._may_hold(rows, manifest), rows)
                        left = self._rows(partly).join(rows.select(*self.keys), self.keys, "left_anti")
                        rest = [self._write(work, self._gathered(left))] if partly else []
                if self._commit(at, manifest, gone, [new, *rest], source):
                    return at["version"] + 1

    def compact(self, most_files: int = 4) -> int:
        """Rewrite apps' buckets that have more than ``most_files`` files. Returns the version."""
        while True:
            at = self._pointer()
            manifest = self._manifest(at)
            many = manifest.groupBy("app_id", "bucket").agg(F.countDistinct("file").alias("n")).filter(F.col("n") > most_files)
            files = [r.file for r in manifest.join(many, ["app_id", "bucket"], "left_semi").select("file").distinct().collect()]
            with Workspace(self.spark) as work:
                if not files or self._commit(at, manifest, files, [self._write(work, self._gathered(self._rows(files)))], None):
                    return at["version"] + bool(files)

    def _first(self, rows: DataFrame, order: list) -> DataFrame:
        """The first row of each key. The shuffle that brings equal keys together goes by bucket and part of it, so the rows are written as they lie."""
        dealt = rows.withColumns({"__bucket": self._bucket(), "__part": F.pmod(self._hash(4), F.lit(PARTS))}).repartition("__bucket", "__part")
        return first_of_key(dealt, ["__bucket", "__part", *self.keys], order)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """With the folder of a row, one for each app and bucket."""
        return rows.select(*self.columns, F.concat(F.hex(F.xxhash64("app_id")), F.lit("-"), self._bucket().cast("string")).alias("__p"))

    def _gathered(self, rows: DataFrame) -> DataFrame:
        """The rows by folder; adaptive execution splits large folders and joins small ones."""
        return self.spark.sql("select /*+ REBALANCE(__p) */ * from {rows}", rows=self._placed(rows))

    def _rows_in(self, token: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{token}")

    def _losing(self, files: list[str], rows: DataFrame) -> tuple[list[str], list[str]]:
        """Those of ``files`` that hold a key of ``rows``, and those of them that hold others too. Only keys are read and shuffled."""
        if not files:
            return [], []
        held = self._rows(files).select(*self.keys, F.col("_metadata.file_path").alias("file"))
        both = held.join(rows.select(*self.keys, F.lit(1).alias("__hit")), self.keys, "left")
        found = both.groupBy("file").agg(F.count("*").alias("n"), F.count("__hit").alias("hits")).filter("hits > 0").collect()
        return [r.file for r in found], [r.file for r in found if r.hits < r.n]

    def _write(self, work: Workspace, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write rows and their index under a new token, which no version names yet; the token and the manifest's lines of their files."""
        token = uuid.uuid4().hex
        (rows if "__p" in rows.columns else self._placed(rows)).write.partitionBy("__p").parquet(f"{self.path}/data/{token}")
        written = self._rows_in(token).select(*self.keys, "app_id", self._bucket().alias("bucket"), F.col("_metadata.file_path").alias("file"))
        sizes = written.groupBy("file", "app_id", "bucket").agg(F.count("*").alias("rows"))
        own = work.settle(sizes.select("file", "app_id", "bucket", "rows", F.ceil(F.col("rows") / BLOCK_KEYS).alias("blocks"), F.lit(token).alias("token")))
        bits = written.join(own.select("file", "app_id", "blocks"), ["file", "app_id"]).select("file", "app_id", "bucket", self._block().alias("block"), F.explode(self._probes()).alias("bit"))
        bits.groupBy("app_id", "bucket", "file", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{self.path}/index/{token}")
        return token, own

    def _commit(self, at: dict, manifest: DataFrame, gone: list[str], added: list[tuple[str, DataFrame]], source: tuple[str, int] | None) -> bool:
        """Make the next version of the manifest's files but ``gone`` and of the files ``added``; False if another writer was first."""
        token = uuid.uuid4().hex
        lines = manifest.join(self.spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti") if gone else manifest
        for _, own in added:
            lines = lines.select(*own.columns).unionByName(own)
        lines.coalesce(8).write.parquet(f"{self.path}/manifests/{token}")
        applied = at["applied"] | ({source[0]: source[1]} if source else {})
        pointer = {"version": at["version"] + 1, "manifest": token, "applied": applied}
        return publish(self.spark, f"{self.path}/versions/{pointer['version']:012d}", json.dumps(pointer))

    # the index

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *self.keys)

    def _bucket(self) -> Column:
        return F.pmod(self._hash(1), F.lit(self.buckets)).cast("int")

    def _block(self) -> Column:
        return F.pmod(self._hash(2), F.col("blocks"))

    def _probes(self) -> Column:
        h = self._hash(3)
        step = F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).bitwiseOR(F.lit(1))
        return F.array(*[F.pmod(h.bitwiseAND(F.lit(BLOCK_BITS - 1)) + i * step, F.lit(BLOCK_BITS)) for i in range(PROBES)])

    def _may_hold(self, rows: DataFrame, manifest: DataFrame) -> list[str]:
        """The files that may hold a key of ``rows``: all that do, and few others."""
        rows = rows.select(*dict.fromkeys([*self.keys, "app_id"]), self._bucket().alias("bucket"))
        near = manifest.join(rows.select("app_id", "bucket").distinct(), ["app_id", "bucket"], "left_semi")
        tokens = [r.token for r in near.select("token").distinct().collect()]
        if not tokens:
            self.opened = self.passed = 0
            return []
        index = self.spark.read.schema("app_id string, bucket int, file string, block bigint, bits binary").parquet(*[f"{self.path}/index/{t}" for t in tokens])
        asked = rows.join(near.select("app_id", "bucket", "file", "blocks"), ["app_id", "bucket"])
        asked = asked.select("app_id", "bucket", "file", self._block().alias("block"), self._probes().alias("probes")).distinct()
        byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = lambda p: F.floor(byte(p) / F.pow(F.lit(2), p % 8)) % 2 == 1
        found = asked.join(index, ["app_id", "bucket", "file", "block"]).filter(F.forall("probes", is_set)).select("file").distinct()
        files = [r.file for r in found.collect()]
        self.opened, self.passed = len(files), near.select("file").distinct().count() - len(files)
        return files

    # upkeep

    def expire(self, keep: int = 1) -> None:
        """Give up all but the last ``keep`` versions (1 at least): their pointers, then the files and indexes that no kept version names.
        Not for use while an old version is being read. What a killed writer left is not named by any version and stays."""
        have = self.versions()
        old, kept = have[: -max(1, keep)], have[-max(1, keep) :]
        named = lambda vs: {(r.token, r.file) for v in vs for r in self._manifest(self._pointer(v)).select("token", "file").distinct().collect()}
        lost, still = named(old), named(kept)
        manifests = {self._pointer(v)["manifest"] for v in old}
        for v in old:
            remove(self.spark, f"{self.path}/versions/{v:012d}")
        for _, file in lost - still:
            remove(self.spark, file)
        for token in {t for t, _ in lost} - {t for t, _ in still}:
            remove(self.spark, f"{self.path}/index/{token}"), remove(self.spark, f"{self.path}/data/{token}")
        for token in manifests:
            remove(self.spark, f"{self.path}/manifests/{token}")
