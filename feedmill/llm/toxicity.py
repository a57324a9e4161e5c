"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and their first four letters, hashed into BUCKETS places.
Score: logistic of bias + sum of term weights + sum over term pairs of the products of their K-dimensional
factors, so that two terms together (an insult and the mention of a group, say) can weigh more than their
weights add up to. The machine is fitted on a bounded sample of labelled rows, taken by a hash of the id.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedmill.llm.common import carried, field, others

#: Hash places, factors per term, and the most labelled rows (to a few parts in a hundred) that are fitted.
BUCKETS, K, MOST_ROWS = 1 << 18, 8, 12_000
EPOCHS, RATE, DECAY, SEED = 20, 0.1, 1e-4, 11
#: A term gets a weight and factors if it is in so many labelled rows and its rows' labels are less even than chance makes
#: them, or those of its rows that hold some other term: pairs among the PAIR_TERMS most frequent terms are screened.
LEAST_ROWS, LEAST_CHI2, PAIR_TERMS = 4, 6.6, 2048
#: Log odds against chance that a pair needs: one false pair among all of PAIR_TERMS terms in a hundred fits.
LEAST_PAIR = 20.0
TERMS_KEPT = 300_000

_WORD = re.compile(r"[^\W\d_]+")


class _Places(dict):
    """Place of a word; its stem's place in the upper half of the number."""

    def __missing__(self, word):
        if len(self) >= TERMS_KEPT:
            self.clear()
        a = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        b = zlib.crc32(b"^" + word[:4].encode("utf-8", "surrogatepass")) % BUCKETS
        v = self[word] = a | (b << 32)
        return v


def term_places(text: str | None, places: dict) -> np.ndarray:
    """Distinct places of a whole text's terms; none for null and for text without letters."""
    found = set(_WORD.findall(text.lower())) if text else ()
    if not found:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
    return np.unique(np.concatenate([both & 0xFFFFFFFF, both >> 32]))


class Machine:
    """bias, weights (BUCKETS) and factors (BUCKETS x K); places without weight are not stored."""

    def __init__(self, bias: float, active: np.ndarray, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.active, self.weight, self.factor = bias, active, weight, factor
        self.at = np.full(BUCKETS, -1, np.int32)
        self.at[active] = np.arange(len(active), dtype=np.int32)

    def score(self, places: np.ndarray) -> float:
        rows = self.at[places]
        rows = rows[rows >= 0]
        z = self.bias
        if len(rows):
            f = self.factor[rows]
            total = f.sum(0)
            z += self.weight[rows].sum() + 0.5 * float((total * total - (f * f).sum(0)).sum())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _divergence(p, q):
    """Of a share p from a share q (Kullback-Leibler)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log(p / q), 0.0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0.0)


def paired_terms(rows: list[np.ndarray], y: np.ndarray, n: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Terms that matter with another one: the share of label 1 among the rows that hold both is off that of either, and of all rows.

    ``n`` and ``hot`` are the rows and the rows of label 1 that hold each term. Counts of pairs are exact.
    """
    often = np.argsort(-n, kind="stable")[:PAIR_TERMS]
    often = np.sort(often[n[often] >= LEAST_ROWS])
    both = np.zeros((len(often), len(often)), np.float32)
    both_hot = np.zeros_like(both)
    for lo in range(0, len(rows), 1024):
        held = np.zeros((min(1024, len(rows) - lo), len(often)), np.float32)
        for k, r in enumerate(rows[lo : lo + 1024]):
            held[k, np.searchsorted(often, r[np.isin(r, often, assume_unique=True)])] = 1
        both += held.T @ held
        hot_rows = held[y[lo : lo + 1024] > 0]
        both_hot += hot_rows.T @ hot_rows
    share, found = (hot / np.maximum(n, 1))[often], np.zeros(len(often), bool)
    for i in range(len(often)):
        usable = both[i] >= LEAST_ROWS
        p = both_hot[i] / np.maximum(both[i], 1)
        off = np.minimum(np.minimum(_divergence(p, share[i]), _divergence(p, share)), _divergence(p, y.mean()))
        strong = usable & (both[i] * off >= LEAST_PAIR)
        strong[i] = False
        found |= strong
        found[i] |= strong.any()
    return often[found]


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fit on term places of labelled texts by adaptive gradient steps; without rows of both labels the score is their share."""
    y = labels.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    none = Machine(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, K)))
    if not len(y) or y.min() == y.max():
        return none
    flat = np.concatenate(rows)
    n = np.bincount(flat, minlength=BUCKETS).astype(np.float64)
    hot = np.bincount(flat, weights=np.repeat(y, [len(r) for r in rows]), minlength=BUCKETS)
    expect = n * y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (hot - expect) ** 2 / (expect * (1 - y.mean()) * (1 - n / (len(y) + 1)))
    active = np.union1d(np.flatnonzero((n >= LEAST_ROWS) & (chi2 >= LEAST_CHI2)), paired_terms(rows, y, n, hot))
    if not len(active):
        return none
    rng = np.random.default_rng(SEED)
    m = Machine(none.bias, active, np.zeros(len(active)), rng.normal(0, 0.02, (len(active), K)))
    known = [(x := m.at[r])[x >= 0] for r in rows]
    gw, gv, gb = np.full(len(active), 1e-6), np.full((len(active), K), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(y)):
            r = known[i]
            f = m.factor[r]
            total = f.sum(0)
            z = m.bias + m.weight[r].sum() + 0.5 * float((total * total - (f * f).sum(0)).sum())
            g = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - y[i]
            gb += g * g
            m.bias -= RATE * g / gb**0.5
            if not len(r):
                continue
            dw = g + DECAY * m.weight[r]
            gw[r] += dw * dw
            m.weight[r] -= RATE * dw / np.sqrt(gw[r])
            if epoch >= 2:  # the weights settle first; the factors then take what pairs add
                dv = g * (total - f) + DECAY * f
                gv[r] += dv * dv
                m.factor[r] -= 0.2 * RATE * dv / np.sqrt(gv[r])
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most_rows: int = MOST_ROWS) -> Machine:
    """Fit on about ``most_rows`` of ``labels`` (id, label over 0 or not), taken by a hash of the id, and their texts in ``docs``.

    The sample is what bounds the broadcast of ids to the texts, so texts are not shuffled; only term places of
    the sampled texts reach the driver. Labels without text count as without terms only if ``docs`` has the id.
    """
    known = labels.filter(field(label_col).isNotNull() & field(id_col).isNotNull()).groupBy(field(id_col).alias("id")).agg((F.max(field(label_col)) > 0).cast("int").alias("y"))
    count = known.count()
    if count > most_rows:
        known = known.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) < int(1_000_003 * most_rows / count))
    texts = docs.select(field(id_col).alias("id"), field(text_col).alias("t")).join(F.broadcast(known), "id")

    def run(batches):
        places = _Places()
        for batch in batches:
            found = [term_places(t.as_py(), places).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], ["h", "p", "y"])

    hashed = texts.select(F.xxhash64(F.col("id").cast("string"), "t").alias("h"), "t", "y").mapInArrow(run, "h bigint, p array<int>, y int")
    got = hashed.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    rows = [np.array(p, np.int64) for p in got.column("p").to_pylist()]
    return fit(rows, np.array(got.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", passed: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``passed``) with ``score``, 0 to 1, of every whole text.

    Null texts and texts without letters get the score of no terms. Rows are independent: repeated rows
    repeat, an empty table stays empty. A column named score, in any case, is replaced; other names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.active, machine.weight, machine.factor))
    keep = others(passed if passed is not None else docs.columns, ("score",))
    data = docs.select(carried(keep).alias("row"), field(text_col).alias("t"))

    def run(batches):
        m, places = Machine(*shared.value), _Places()
        for batch in batches:
            got = [m.score(term_places(t.as_py(), places)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["row", "score"])

    scored = data.mapInArrow(run, data.select("row").schema.add("score", "double"))
    return scored.select(*(["row.*"] if keep else []), "score")
