"""Near-duplicate flags batch by batch, against stored representatives, and without pairs of copies.

The flags are those of ``operators.neardup``: in order of ``pos``, a row that is not flagged flags every later row of similarity t
or more. Candidates share one of BANDS bands of minima and are confirmed on the sets. Flagged rows flag nothing, so
only kept rows are stored, and a row is held against kept rows only: a group of n copies costs n comparisons for each row of
it that is kept, not n squared.

Within a batch rounds decide which rows are kept. In each band the first FRONT undecided rows are compared with each other. A
row that is among the first in all its bands has met every undecided earlier row that it may resemble: without a
similar one it is kept. Kept rows are then held against all undecided later rows of their bands, and what they
resemble is flagged. Every round is written to the shared folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedmill import params
from feedmill.operators.neardup import confirmed, copies_of, word_sets
from feedmill.storage import Workspace, names_in, publish, read_text, settle

#: A pair of similarity 0.85 shares no band with probability 8 in 10 million. Undecided rows of a band that are compared in a round.
BANDS, ROWS, FRONT = 24, 5, 32
_KEPT = "app_id string, pos bigint, s array<bigint>, n int, same string, keys array<bigint>"


def _bands(keyed: DataFrame) -> DataFrame:
    """(app_id, key, pos, n) of every band; the band's number is part of the key."""
    return keyed.select("app_id", "pos", "n", F.posexplode("keys").alias("band", "k")).select("app_id", F.xxhash64("band", "k").alias("key"), "pos", "n")


def _confirmed(pairs: DataFrame, sets: DataFrame, t: float, work: Workspace) -> DataFrame:
    """Those of the pairs (app_id, a, b) whose ``sets`` have similarity ``t``."""
    return confirmed(pairs, sets, t, work.settle).select("app_id", "a", "b")


def _met(first: DataFrame, second: DataFrame, t: float) -> DataFrame:
    """(app_id, a, b) of rows of two band tables that share a band and are of fitting size."""
    a, b = (d.select("app_id", "key", F.col("pos").alias(x), F.col("n").alias(f"n{x}")) for d, x in ((first, "a"), (second, "b")))
    fits = F.least("na", "nb") >= F.round(F.greatest("na", "nb") * t, 9)
    return a.join(b, ["app_id", "key"]).filter(fits)


def _decide(reps: DataFrame, t: float, work: Workspace) -> DataFrame:
    """The flagged ones (app_id, pos) of representatives (with keys) that nothing stored has flagged."""
    bands = _bands(reps)
    # a row that has all its bands for itself is kept; the others' sets are written once, for all rounds
    rows = work.settle(bands.join(bands.groupBy("app_id", "key").count().filter("count > 1"), ["app_id", "key"], "left_semi"))
    own = work.settle(rows.groupBy("app_id", "pos").agg(F.countDistinct("key").alias("own")))
    near, flagged = work.settle(reps.select("app_id", "pos", "s").join(own, ["app_id", "pos"], "left_semi")), None
    while not rows.isEmpty():
        rank = F.row_number().over(Window.partitionBy("app_id", "key").orderBy("pos"))
        front = work.settle(rows.withColumn("r", rank).filter(F.col("r") <= FRONT).drop("r"))
        among = front.groupBy("app_id", "pos").agg(F.countDistinct("key").alias("c"))
        complete = among.join(own, ["app_id", "pos"]).filter("c = own").select("app_id", "pos")
        later = _met(front, front.join(complete, ["app_id", "pos"], "left_semi"), t).filter("a < b").select("app_id", "a", "b")
        waiting = _confirmed(later, near, t, work).select("app_id", F.col("b").alias("pos"))
        now = work.settle(complete.join(waiting, ["app_id", "pos"], "left_anti"))
        mine = rows.join(now, ["app_id", "pos"], "left_semi")
        rest = work.settle(rows.join(now, ["app_id", "pos"], "left_anti"))
        hit = work.settle(_confirmed(_met(mine, rest, t).filter("a < b").select("app_id", "a", "b"), near, t, work).select("app_id", F.col("b").alias("pos")).distinct())
        flagged = hit if flagged is None else flagged.unionByName(hit)
        rows = work.settle(rest.join(hit, ["app_id", "pos"], "left_anti"))
    return flagged if flagged is not None else reps.select("app_id", "pos").limit(0)


def kept_rows(reviews: DataFrame, stored: DataFrame | None, t: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(kept, flagged): the rows of ``reviews`` that neither a stored nor an earlier kept row resembles, with sets and keys, and (app_id, pos) of
    the others that have shingles. Stored rows count as earlier than all of ``reviews``. Flagged rows are few or narrow, sets are long: so
    sets are never joined but with lists of ids."""
    sets = work.settle(word_sets(reviews, 1, BANDS, ROWS))
    flagged = work.settle(copies_of(sets))
    reps = sets.join(flagged, ["app_id", "pos"], "left_anti")
    if stored is not None:
        # first by equal sets, which copies of stored rows have, then by bands
        alike = work.settle(reps.join(stored.select("app_id", "same"), ["app_id", "same"], "left_semi").select("app_id", "pos"))
        fresh = reps.join(alike, ["app_id", "pos"], "left_anti")
        both = stored.select("app_id", "pos", "s").unionByName(fresh.select("app_id", "pos", "s"))
        hit = _confirmed(_met(_bands(stored), _bands(fresh), t).select("app_id", "a", "b"), both, t, work)
        known = work.settle(alike.unionByName(hit.select("app_id", F.col("b").alias("pos"))).distinct())
        flagged, reps = flagged.unionByName(known), reps.join(known, ["app_id", "pos"], "left_anti")
    hit = work.settle(_decide(reps, t, work))
    return reps.join(hit, ["app_id", "pos"], "left_anti"), flagged.unionByName(hit)


def _flagged(reviews: DataFrame, marks: DataFrame) -> DataFrame:
    """``reviews`` with ``is_near_duplicate``, true for the rows in ``marks`` (app_id, pos)."""
    found = reviews.drop("is_near_duplicate").join(marks.withColumn("__flag", F.lit(True)), ["app_id", "pos"], "left")
    return found.withColumn("is_near_duplicate", F.coalesce("__flag", F.lit(False))).drop("__flag")


def flags_without_pairs(reviews: DataFrame, t: float = params.NEAR_DUPLICATE) -> DataFrame:
    """``reviews`` (app_id, pos, review_text, ...) with ``is_near_duplicate``, in one run."""
    with Workspace(reviews.sparkSession) as work:
        marks = settle(kept_rows(reviews, None, t, work)[1])
    return _flagged(reviews, marks)


class NearDuplicateIndex:
    """The kept rows of all batches so far, at ``path``, with their sets and band keys.

    Batches come in order: all rows of a batch are later than all of the batches before, whatever their ``pos``, which must
    be unique in an app. Flags after any number of batches are those of one run over all rows. A batch appears whole,
    by one rename of its pointer, or not at all; one that has been applied gives the same flags again.
    """

    def __init__(self, spark: SparkSession, path: str, t: float = params.NEAR_DUPLICATE):
        self.spark, self.path, self.t = spark, path.rstrip("/"), t

    def _tokens(self) -> dict[str, str]:
        return {n: json.loads(read_text(self.spark, f"{self.path}/batches/{n}"))["token"] for n in names_in(self.spark, f"{self.path}/batches") if not n.startswith(".")}

    def kept(self) -> DataFrame | None:
        tokens = self._tokens().values()
        return self.spark.read.schema(_KEPT).parquet(*[f"{self.path}/data/{t}/kept" for t in tokens]) if tokens else None

    def flags(self, reviews: DataFrame, batch: str) -> DataFrame:
        """``reviews``, the batch of this name, with ``is_near_duplicate``; its kept rows are stored."""
        token = self._tokens().get(batch)
        if token is None:
            token = uuid.uuid4().hex
            with Workspace(self.spark) as work:
                kept, flagged = kept_rows(reviews, self.kept(), self.t, work)
                own = f"{self.path}/data/{token}"
                kept.select(*self.spark.createDataFrame([], _KEPT).columns).write.parquet(f"{own}/kept")
                flagged.write.parquet(f"{own}/flagged")
            if not publish(self.spark, f"{self.path}/batches/{batch}", json.dumps({"token": token})):
                token = self._tokens()[batch]
        return _flagged(reviews, self.spark.read.schema("app_id string, pos bigint").parquet(f"{self.path}/data/{token}/flagged"))
