"""Token counts kept by signed deltas.

A batch of changes is turned into signed rows: an insert adds its count, a delete subtracts it, a revision
subtracts the old count and adds the new one. Each batch is pre-aggregated, written to a folder of its own
and committed by renaming that folder to its batch id, once: of several writers of an id one wins, and readers
see whole batches only. Totals are sums over the committed batches, so they never need the old texts; ``compact``
folds batches into one, so that totals stay cheap. Committing a batch id again changes nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedmill.llm.common import remove

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def word_count(text: Column) -> Column:
    """Tokenizer ``ws-1``: runs without ASCII white space. Null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("bigint")


def piece_count(text: Column) -> Column:
    """Tokenizer ``alnum-2``: ASCII letter runs, digit runs, and single other non-space bytes' characters. Null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]")).cast("bigint")


def signed_changes(changes: DataFrame) -> DataFrame:
    """Signed totals of one batch.

    ``changes`` has op (insert, delete, revise), source, lang, tokenizer, tokens, and for a revision
    old_source, old_lang, old_tokenizer, old_tokens. Null keys are a group of their own; a null count is 0;
    rows with another op or none are an error of the caller and count nothing. Repeated rows count each.
    """
    n, old = F.coalesce("tokens", F.lit(0)).cast("bigint"), F.coalesce("old_tokens", F.lit(0)).cast("bigint")
    one = lambda sign, count, pre="": F.struct(*[F.col(f"{pre}{k}").cast("string").alias(k) for k in KEYS], F.lit(sign).cast("bigint").alias("docs"), (count * sign).alias("tokens"))
    rows = F.when(F.col("op") == "insert", F.array(one(1, n))).when(F.col("op") == "delete", F.array(one(-1, n))).when(F.col("op") == "revise", F.array(one(-1, old, "old_"), one(1, n)))
    return changes.select(F.explode(rows).alias("r")).select("r.*").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenCounts:
    """A table below ``path`` (shared storage whose rename is atomic, as HDFS's is).

    ``batches/ID`` is a committed batch, ``folded/N`` the sum of the batches whose ids it lists below ``ids``; the
    folded table with the largest number counts, and the batches that it does not list. ``tmp`` holds unfinished
    work; what a lost writer leaves there counts nowhere.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _publish(self, written: str, folder: str, name: str) -> bool:
        """Rename a finished folder into place; False, and the folder removed, if the name is taken."""
        self._fs.mkdirs(self._path(f"{self.path}/{folder}"))
        target = self._path(f"{self.path}/{folder}/{name}")
        if not self._fs.exists(target):
            self._fs.rename(self._path(written), target)
            nested = self._path(f"{self.path}/{folder}/{name}/{written.rsplit('/', 1)[1]}")
            if not self._fs.exists(nested):  # some file systems move into a folder that another writer has made meanwhile
                return not self._fs.exists(self._path(written))
            self._fs.delete(nested, True)
        remove(self.spark, written)
        return False

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if that id is committed already, by this or by another writer."""
        if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9._-]*", batch_id):
            raise ValueError("a batch id consists of letters, digits, dot, dash and underscore and does not begin with dot or underscore")
        if batch_id in self._names("batches") or batch_id in self._folded()[1]:
            return False
        written = f"{self.path}/tmp/{uuid.uuid4().hex}"
        signed_changes(changes).write.parquet(written)
        return self._publish(written, "batches", batch_id)

    def _folded(self) -> tuple[str | None, set[str]]:
        """Folder of the folded table that counts, and the ids of its batches."""
        numbers = [int(n) for n in self._names("folded")]
        if not numbers:
            return None, set()
        folder = f"{self.path}/folded/{max(numbers)}"
        return folder, {r.id for r in self.spark.read.schema("id string").parquet(f"{folder}/ids").collect()}

    def _rows(self, folder: str | None, ids: list[str]) -> DataFrame:
        paths = ([f"{folder}/sums"] if folder else []) + [f"{self.path}/batches/{i}" for i in ids]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer; groups without documents or tokens are left out.
        Of committed batches only; without any, or without the folder, an empty table."""
        folder, folded = self._folded()
        new = [i for i in self._names("batches") if i not in folded]
        return _summed(self._rows(folder, new)).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> int:
        """Fold the committed batches into one table; returns how many were folded. Ids stay known, so they cannot be committed
        again; the batches' folders stay until ``drop_folded``, for readers that have begun. One of two at a time wins."""
        folder, folded = self._folded()
        new = [i for i in self._names("batches") if i not in folded]
        if not new:
            return 0
        written = f"{self.path}/tmp/{uuid.uuid4().hex}"
        _summed(self._rows(folder, new)).filter("docs <> 0 or tokens <> 0").write.parquet(f"{written}/sums")
        self.spark.createDataFrame([(i,) for i in sorted({*folded, *new})], "id string").coalesce(1).write.parquet(f"{written}/ids")
        number = max([int(n) for n in self._names("folded")], default=0) + 1
        return len(new) if self._publish(written, "folded", str(number)) else 0

    def drop_folded(self) -> None:
        """Remove the folders of folded batches and older folded tables; no reader of an earlier ``totals`` may still run."""
        folder, folded = self._folded()
        for i in self._names("batches"):
            if i in folded:
                remove(self.spark, f"{self.path}/batches/{i}")
        for n in self._names("folded"):
            if folder != f"{self.path}/folded/{n}":
                remove(self.spark, f"{self.path}/folded/{n}")
