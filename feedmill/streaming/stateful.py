"""Ingestion of landed review pages with the ids seen so far in a keyed state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from feedmill.operators.reviews import extract_review_fields, long_enough
from feedmill.schemas import REVIEW, REVIEW_PAGE
from feedmill.sources.tables import review_rows
from feedmill.sources.versioned import VersionedTable

#: Hash groups of review ids: one call of the state for a group of a batch instead of one for each id.
GROUPS = 64
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Passes on each id's first row, by (page, pos) within a batch, and never again. The state is a map of the ids of a group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "review_id string", "page int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["page", "pos"], kind="stable").drop_duplicates("review_id")
        new = batch[[not self.ids.containsKey((i,)) for i in batch["review_id"]]]
        for i, page in zip(new["review_id"], new["page"]):
            self.ids.updateValue((i,), (int(page),))
        yield new.drop(columns=["group"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for i in initialState["review_id"]:
            self.ids.updateValue((i,), (-1,))

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("group", F.pmod(F.xxhash64("review_id"), F.lit(GROUPS)).cast("int"))


def stream_reviews_stateful(spark: SparkSession, pages_dir: str, table: VersionedTable, checkpoint: str, files_per_batch: int | None = None, name: str = "reviews"):
    """Start a query that appends new reviews of the pages below ``pages_dir`` to ``table`` and ends when all are read.

    Ids seen are kept in a RocksDB state store, so a batch costs its own rows, whatever the size of the table. A new checkpoint
    starts from the ids in the table, its recovery source. Batches are applied to the table once each, under ``name`` and
    their number. Late and replayed pages change nothing; the state keeps every id for good, as the table does, so no watermark applies. Reviews without
    id are left out. A checkpoint that is lost needs a new ``name``: its batches are numbered from 0 again.
    """
    reader = spark.readStream.schema(REVIEW_PAGE)
    pages = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(pages_dir)
    rows = pages.filter((F.col("success") != 0) & (F.size("reviews") > 0)).select("app_id", "page", F.posexplode("reviews").alias("pos", "review"))
    clean = _grouped(review_rows(long_enough(extract_review_fields(rows))).dropna(subset=["review_id", "app_id"]))
    stored = StructType.fromDDL(REVIEW)
    clean = clean.select(*[F.col(f.name).cast(f.dataType) for f in stored], "page", "pos", "group")
    out = StructType.fromDDL(f"{REVIEW}, page int, pos int")
    first = clean.groupBy("group").transformWithStateInPandas(FirstSeen(), out, "Append", "None", initialState=_grouped(table.read().select("review_id")).groupBy("group"))

    def put(batch: DataFrame, number: int) -> None:
        table.append(batch, ["page", "pos"], (name, number))

    before = spark.conf.get(_PROVIDER_KEY, None)
    spark.conf.set(_PROVIDER_KEY, _PROVIDER)  # a query keeps the settings that it is started with
    try:
        return first.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER_KEY, before) if before else spark.conf.unset(_PROVIDER_KEY)
