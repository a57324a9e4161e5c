"""Packing of tokenised documents into sequences, by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (a piece costs the square of its length, as
attention within documents does). Pieces are taken by falling length; among the open sequences that can take a piece
under every constraint the best is the one with the least weighted norm of what is left after it, or the least weighted dot
product of what is left with what the piece needs. Each resource weighs as much as the pieces ask of it on average.

Pieces are dealt to groups of bounded size, each packed in one task; sequences that have room left over are opened again
and their pieces dealt to fewer groups, until one group is left. Pieces that fill a sequence by themselves take no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from feedmill.llm.common import Workspace, field, row_of, settle

#: Tokens of a sequence; pieces of a group, about; a sequence with more than this part of its tokens free is opened again.
TOKENS, GROUP, REOPEN = 4096, 16_384, 1 / 256
#: Characters of a text, and of short texts, that are cut into words at once; words that a worker remembers, and their characters.
BLOCK, TOGETHER, KNOWN_WORDS, KNOWN_CHARS = 1 << 20, 1 << 16, 1 << 20, 1 << 25
_GAP = re.compile("[ \n\t\r]")
#: Signs that may end a word.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Numbers(dict):
    """Words and their numbers; one that is asked for first gets the next number and is listed in ``new``."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordCoder:
    """Ids of whole texts by a ``tokenizers`` file that drops white space and merges nothing across it, so that what
    stands between white space is encoded by itself, and once while it is remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        file = json.loads(vocabulary)
        suffix, ids = file["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.letters = None  # for lower-case words of Latin-1 letters, which the file's rules leave as they are
        rules = [[p["type"] for p in (file.get(part) or {}).get(kind, [])] for part, kind in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if rules == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and "|[\\p{L}]+|" in file["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", ""):
            cut = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, file["pre_tokenizer"]["pretokenizers"][1]]}
            self.letters = Tokenizer.from_str(json.dumps(file | {"normalizer": None, "pre_tokenizer": cut, "post_processor": None, "added_tokens": []}))
        self.last = np.zeros(max(ids.values()) + 1, bool)  # of ids that end a word
        self.last[[i for token, i in ids.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        # word -> its number; the ids of number w are flat[start[w] : start[w] + size[w]]
        self.known, self.flat, self.start, self.size = Numbers([""]), np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.chars = 0

    def _put(self, words: list[str], values: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of known words, one after the other."""
        while len(self.known) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        numbers = self._numbers(words)
        self.start[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(values)] = values
        self.used += len(values)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered words, one after the other."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        # id j of a word is j places behind the word's first
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[numbers] - ends + sizes, sizes)]

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        """A word without the signs that end it behind a letter, and the signs: no token holds both. Words of Latin-1 characters of one spelling
        are one. Parts are their own parts."""
        if "<|" in word:
            return word, ""
        core = word.rstrip(SIGNS)
        if len(core) < len(word) and not (core and core[-1] < "\u0250" and core[-1].isalpha()):
            core = word
        return (core.lower() if core.isascii() or max(core) < "\u0100" else core), word[len(core) :]

    def _ask(self, words: list[str]) -> None:
        """Makes the tokenizer's ids of words known. Words of letters go as one text: each has one id or more that ends a word, so if there are as
        many of these as words, they tell where each word ends."""
        simple, rest, other = [], [], []
        for w in words:
            (other if not w.isalpha() else simple if self.letters and (w.isascii() or max(w) < "\u0100") and w == w.lower() else rest).append(w)
        for tokenizer, plain in ((self.letters, simple), (self.tokenizer, rest)):
            if not plain:
                continue
            texts = [" ".join(plain[k : k + 64]) for k in range(0, len(plain), 64)]
            ids = np.array(list(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))), np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                self._put(plain, ids, np.diff(ends, prepend=0))
            else:
                other += plain
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._put(other, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The words' numbers; makes all known."""
        if len(self.known) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        numbers = self._numbers(words)
        new, self.known.new = self.known.new, []
        if new:
            self.chars += sum(map(len, new))
            parts = list(map(self._parts, new))
            joined = [(w, c, s) for w, (c, s) in zip(new, parts) if s or w != c]
            of = self._numbers([p for _, c, s in joined for p in (c, s)])
            lacking, self.known.new = self.known.new, []
            self._ask([w for w, (c, s) in zip(new, parts) if not s and w == c] + lacking)
            if joined:
                self._put([w for w, _, _ in joined], self._ids(of), self.size[of].reshape(-1, 2).sum(axis=1))
        return numbers

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text in blocks, cut in white space."""
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = gap.start() if gap else len(text)
            yield self._ids(self._learn(self._words(text[at:end])))
            at = end

    def encode_each(self, texts: Iterable[str]) -> Iterator[Iterator[np.ndarray]]:
        """``encode`` of each text. Words of short texts that follow each other are looked up and learned at once."""
        held, chars = [], 0
        for text in texts:
            if chars + len(text) > TOGETHER:
                yield from self._together(held)
                held, chars = [], 0
            if len(text) > TOGETHER:
                yield self.encode(text)
            else:
                held.append(text)
                chars += len(text)
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        if texts:
            words = list(map(self._words, texts))
            numbers = self._learn(list(chain.from_iterable(words)))
            ids, upto = self._ids(numbers), np.cumsum(self.size[numbers])
            at = 0
            for end in upto[np.cumsum(list(map(len, words))) - 1].tolist():
                yield iter([ids[at:end]])
                at = end

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def pieces_of(blocks: Iterator[np.ndarray], most: int, end: int) -> Iterator[np.ndarray]:
    """The ids of all blocks and then ``end``, ``most`` at a time."""
    rest = np.zeros(0, np.uint32)
    for block in chain(blocks, [np.array([end], np.uint32)]):
        rest = np.concatenate([rest, block])
        whole = len(rest) // most * most
        for lo in range(0, whole, most):
            yield rest[lo : lo + most]
        rest = rest[whole:]
    if len(rest):
        yield rest


def token_pieces(docs: DataFrame, vocabulary: str, most: int = TOKENS, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids, by the ``tokenizers`` file ``vocabulary`` without special tokens and
    with ``end`` behind them, cut into pieces of ``most``; ``ids`` too if asked for.

    A null text is an empty one and has the one id ``end``. ids_crc32 is of the ids as little-endian unsigned 32-bit integers. Rows are
    independent: repeated ones repeat, an empty table stays empty, texts of any length are read whole.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"file": f.read()})  # of the vocabulary's size

    def run(batches):
        held = shared.value  # stays with a worker from task to task, and the coder with it
        if "coder" not in held:
            held["coder"] = WordCoder(held["file"])
        for batch in batches:
            of, piece, start, ids = [], [], [], []
            for row, blocks in enumerate(held["coder"].encode_each(text.as_py() or "" for text in batch.column(1))):
                at = 0
                for k, part in enumerate(pieces_of(blocks, most, end)):
                    of.append(row), piece.append(k), start.append(at), ids.append(part)
                    at += len(part)
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in ids]
            out = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) for p in ids], pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array([p.astype(np.int32) for p in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    data = docs.select(field(id_col).alias("id"), field(text_col).alias("text"))
    schema = docs.select(field(id_col)).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return data.mapInArrow(run, schema.add("ids", ArrayType(IntegerType())) if with_ids else schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. ``capacity`` is in tokens, pieces and cost; a piece needs (length, 1, length squared). Pieces go by
    falling length, equal ones in their order; of equally good bins the first opened is taken."""
    size = lengths.astype(np.float64)
    need = np.column_stack([size, np.ones(len(size)), size * size])
    cap = np.array(capacity, np.float64)
    if len(need) and (need > cap).any():
        raise ValueError("a piece is larger than a sequence")
    weight = (need / cap).mean(axis=0) / cap**2 if len(need) else np.ones(3)
    order = np.argsort(-lengths, kind="stable")
    # of the pieces still to come none needs less than this
    least = need[order[-1]] if len(need) else cap
    left = np.empty((3, 1024))  # what is free in the open bins
    name, n_open, n_bins = np.empty(1024, np.int64), 0, 0
    bins, offsets = np.empty(len(need), np.int64), np.empty(len(need), np.int64)
    for i in order.tolist():
        d, free = need[i], left[:, :n_open]
        fits = (free[0] >= d[0]) & (free[1] >= d[1]) & (free[2] >= d[2])
        can = np.flatnonzero(fits)
        if len(can):
            rest = free[:, can]
            fit = weight @ (rest - d[:, None]) ** 2 if rule == "norm" else (weight * d) @ rest
            at = int(can[np.argmin(fit)])
        else:
            if n_open == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([name, np.empty_like(name)])
            at = n_open
            left[:, at], name[at] = cap, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = name[at], int(cap[0] - left[0, at])
        left[:, at] -= d
        if (left[:, at] < least).any():  # full: the bins behind it move up, so that the first opened stay first
            left[:, at : n_open - 1], name[at : n_open - 1] = left[:, at + 1 : n_open].copy(), name[at + 1 : n_open].copy()
            n_open -= 1
    return bins, offsets


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """``pieces`` (length and any other columns) with ``sequence_id`` and ``offset``, the place in it, gapless from 0.

    A sequence holds at most ``tokens`` tokens, ``documents`` pieces and attention cost ``cost`` (a piece costs its length squared); without the
    last two, as many pieces as tokens and the cost of one piece that fills it, which no packing exceeds. Every length must be from 1 to
    ``tokens`` and its cost no more than ``cost``. ``rule`` is norm or dot. Identifiers are any numbers, the same for the pieces of a
    sequence. An empty table stays empty; repeated rows are pieces each. The given columns named like the results are replaced.
    """
    capacity = (float(tokens), float(documents or tokens), float(cost or tokens * tokens))
    kept = pieces.drop("sequence_id", "offset")
    with Workspace(pieces.sparkSession) as work:
        # a row's place names it for good once it is written
        placed = work.settle(kept.select(F.monotonically_increasing_id().alias("place"), F.col("length").cast("bigint").alias("size"), row_of(kept).alias("row")))
        alone = (F.col("size") >= tokens) | (F.col("size") * F.col("size") >= F.lit(capacity[2]))
        whole = placed.filter(alone).select("row", F.col("place").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
        rows, done, turn = placed.filter(~alone), [whole], 0
        n = rows.count()
        schema = rows.schema.add("sequence_id", "long").add("offset", "long").add("free", "long")

        def run(group: pa.Table) -> pa.Table:
            group = group.drop_columns(["group"]).sort_by([("size", "descending"), ("place", "ascending")])
            sizes, place = group.column("size").to_numpy(), group.column("place").to_numpy()
            bins, offsets = best_fit(sizes, capacity, rule)
            k = int(bins.max(initial=-1)) + 1
            first, used = np.full(k, np.iinfo(np.int64).max), np.zeros(k, np.int64)
            np.minimum.at(first, bins, place), np.add.at(used, bins, sizes)
            for title, values in (("sequence_id", first[bins]), ("offset", offsets), ("free", tokens - used[bins])):
                group = group.append_column(title, pa.array(values, pa.int64()))
            return group

        while n:
            groups = -(-n // group)
            dealt = rows.withColumn("group", F.pmod(F.xxhash64("place", F.lit(turn)), F.lit(groups)))
            packed = work.settle(dealt.groupBy("group").applyInArrow(run, schema))
            again = F.col("free") > F.lit(int(tokens * REOPEN))
            left = packed.filter(again).count() if groups > 1 else 0
            if groups == 1 or left > 0.9 * n:  # nothing to gain from another deal
                done.append(packed.select("row", "sequence_id", "offset"))
                break
            done.append(packed.filter(~again).select("row", "sequence_id", "offset"))
            rows, n, turn = packed.filter(again).select("place", "size", "row"), left, turn + 1
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return settle(out.select("row.*", "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, tokens: int = TOKENS, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **limits) -> DataFrame:
    """The pieces of ``token_pieces`` with the sequence and the offset that ``pack`` gives them; ``limits`` are its capacities and rule."""
    return pack(token_pieces(docs, vocabulary, tokens, end, id_col, text_col, with_ids), tokens, **limits)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, of pieces packed with their ids; a sequence's length is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
