"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter trigram is the elementwise product (binding)
of its letters' vectors, the first rotated twice and the second once; a text is the sum (bundle) of its
trigrams' vectors, and a language's prototype the sum over its training texts. A text gets the language of
the prototype with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedmill.llm.common import carried, field, others

#: Length of the vectors; letters of text in memory at once, and distinct trigrams whose vectors are.
DIMENSIONS, LETTERS_AT_ONCE, GRAMS_AT_ONCE = 1024, 1_000_000, 4096
#: Letters' vectors that a worker keeps.
VECTORS_KEPT = 30_000
#: A table with more languages than this is not a language column.
MOST_LANGUAGES = 10_000
N = 3


class Letters:
    """Which code points are letters, and the letters' vectors, kept as they are met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def of_worker(held: dict) -> Letters:
        """The one that is kept in a broadcast dict, and so with a worker from task to task; made by the first task. (Only plain
        values are broadcast: workers need no copy of this package.)"""
        if "letters" not in held:
            held["letters"] = Letters(held["dimensions"])
        return held["letters"]

    def vector(self, code: int) -> np.ndarray:
        v = self.known.get(code)
        if v is None:
            if len(self.known) >= VECTORS_KEPT:
                self.known.clear()
            v = self.known[code] = np.random.default_rng([17, code]).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return v

    def codes(self, text: str | None) -> np.ndarray:
        """Lower-cased letters' code points, each run of other characters one space; the text is set in spaces. Empty without letters."""
        if not text:
            return np.zeros(0, np.int64)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = self.is_letter[codes]
        if not letter.any():
            return np.zeros(0, np.int64)
        codes = np.where(letter, codes, 32)
        codes = np.concatenate([[32], codes, [32]])
        return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def _groups(texts, letters: Letters):
    """Trigram codes of consecutive texts, so many at once that they stay small: yields (number of texts, codes, index of the text)."""
    codes, owner, n, size = [], [], 0, 0
    for text in texts:
        c = letters.codes(text)
        for lo in range(0, max(len(c) - N + 1, 0), LETTERS_AT_ONCE):
            part = c[lo : lo + LETTERS_AT_ONCE + N - 1]
            codes.append((part[:-2] << 42) | (part[1:-1] << 21) | part[2:])
            owner.append(np.full(len(codes[-1]), n, np.int64))
            size += len(codes[-1])
        n += 1
        if size >= LETTERS_AT_ONCE or n >= 2048:
            yield n, codes, owner
            codes, owner, n, size = [], [], 0, 0
    if n:
        yield n, codes, owner


def _trigram_vectors(grams: np.ndarray, own: Letters) -> np.ndarray:
    parts = [(grams >> 42) & 0x1FFFFF, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
    letters, where = np.unique(np.concatenate(parts), return_inverse=True)
    base = np.stack([own.vector(int(c)) for c in letters])
    a, b, c = np.split(where, 3)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def text_vectors(texts, letters: Letters):
    """Yields arrays of the texts' bundles, in order; a text without letters has zeros."""
    for n, codes, owner in _groups(texts, letters):
        out = np.zeros((n, letters.dimensions), np.float32)
        if codes:
            grams, where = np.unique(np.concatenate(codes), return_inverse=True)
            order, rows = np.argsort(where, kind="stable"), np.concatenate(owner)
            # a few distinct trigrams at a time: their vectors and counts stay small however many a text has
            for lo in range(0, len(grams), GRAMS_AT_ONCE):
                vectors = _trigram_vectors(grams[lo : lo + GRAMS_AT_ONCE], letters)
                mine = order[np.searchsorted(where, lo, sorter=order) : np.searchsorted(where, lo + GRAMS_AT_ONCE, sorter=order)]
                counts = np.bincount(rows[mine] * len(vectors) + where[mine] - lo, minlength=n * len(vectors))
                out += counts.reshape(n, len(vectors)).astype(np.float32) @ vectors
        yield out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of all rows with a language; texts without letters add nothing.

    Every task sends one sum for each language; those are added up by dimension, so no task gathers texts.
    """
    known = docs.filter(field(lang_col).isNotNull()).select(field(lang_col).cast("string").alias("l"), field(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast({"dimensions": dimensions})

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        letters = Letters.of_worker(shared.value)
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for vectors in text_vectors((t.as_py() for t in batch.column(1)), letters):
                own = np.array(langs[at : at + len(vectors)])
                at += len(vectors)
                for lang in np.unique(own):
                    total[str(lang)] = total.get(str(lang), 0) + vectors[own == lang].sum(0, dtype=np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([np.rint(v).astype(np.int64)], pa.list_(pa.int64()))], ["l", "v"])

    parts = known.mapInArrow(sums, "l string, v array<bigint>").select("l", F.posexplode("v").alias("i", "x"))
    rows = parts.groupBy("l", "i").agg(F.sum("x").alias("x")).groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    got = rows.limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r.l: np.array(r.v, np.float64) for r in got if any(r.v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", passed: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``passed``) with ``lang_pred`` and ``score``, the cosine cut to 0..1.

    ``und`` with score 0 if the text is null or has no letters, or no language is known. Cosines that are
    equal to six places go to the language that comes first in order. Texts are taken whole, long ones in pieces; repeated rows repeat;
    an empty table stays empty. Columns named like the two results, in any case, are replaced; other names cannot clash.
    """
    names = sorted(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    matrix = np.stack([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names]).astype(np.float32) if names else np.zeros((1, dims), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast({"names": names or ["und"], "matrix": matrix, "dimensions": dims})
    keep = others(passed if passed is not None else docs.columns, ("lang_pred", "score"))
    data = docs.select(carried(keep).alias("row"), field(text_col).alias("t"))

    def run(batches):
        known, proto, letters = shared.value["names"], shared.value["matrix"], Letters.of_worker(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            best, score = [], []
            for v in text_vectors((t.as_py() for t in batch.column(1)), letters):
                size = np.linalg.norm(v, axis=1)
                cosine = (v @ proto.T) / np.maximum(size, 1e-30)[:, None]
                top = np.round(cosine, 6).argmax(1)
                best += [known[i] if s else "und" for i, s in zip(top, size)]
                score += [float(min(max(cosine[r, i], 0.0), 1.0)) if s else 0.0 for r, (i, s) in enumerate(zip(top, size))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    found = data.mapInArrow(run, data.select("row").schema.add("lang_pred", "string").add("score", "double"))
    return found.select(*(["row.*"] if keep else []), "lang_pred", "score")
