"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; in local mode without that setting below a temporary one. It is removed
    when the driver's program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="feedmill-"))
        base = _OWN_DIR[0]
    path = f"{base.rstrip('/')}/feedmill/{uuid.uuid4().hex}"
    atexit.register(_remove_at_end, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads; nothing if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file of this text appear whole under ``path``, if the name is free: False, and nothing changed, if it is taken."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    where = hadoop.Path(path)
    fs = where.getFileSystem(conf)
    where = fs.makeQualified(where)
    aside = hadoop.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    try:
        never_over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(where.toUri(), conf).rename(aside, where, never_over)
        return True
    except Exception:
        if not fs.exists(where):
            raise
        fs.delete(aside, False)
        return False


def _remove_at_end(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM has gone before: the folder stays
        pass


def settle(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage. ``options`` are the writer's."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """The intermediate tables of one job, in a folder that is removed when the ``with`` block ends.

    What the block returns must not read them any more: pass it through the module's ``settle`` first.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_dir(spark), 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def settle(self, df: DataFrame) -> DataFrame:
        """As the module's ``settle``, in this folder."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
