"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds every token in a
piece of text. Encoding takes the longest token at each position and steps back to shorter ones where two
adjacent tokens cannot follow each other in a BPE result; whether they can is worked out from the merge
tree and memoised. Positions that led nowhere are marked, so each is tried once per token length and the
work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from feedmill.llm.common import field

#: Pieces of up to so many bytes are remembered, so many of them.
CACHE_BYTES, CACHE_PIECES = 48, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 token and rank per line; read on the driver, a vocabulary is small and fixed."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_tree(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of two bytes or more the two tokens of its last merge. Tokens no merge yields have no entry."""
    tree: dict[int, tuple[int, int]] = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            least = min(joined)
            if least >= rank:
                break
            i = joined.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            tree[rank] = (ranks[parts[0]], ranks[parts[1]])
    return tree


class Coder:
    """Encodes and decodes by one vocabulary; built once per worker."""

    def __init__(self, ranks: dict[bytes, int], tree: dict[int, tuple[int, int]], pattern: str):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.ranks, self.tree = ranks, tree
        self.merged = {pair: r for r, pair in tree.items()}
        self.split = regex.compile(pattern).findall
        usable = {t: r for t, r in ranks.items() if len(t) == 1 or r in tree}
        self.finder = ahocorasick.Automaton()
        for t, r in usable.items():
            self.finder.add_word(t.decode("latin-1"), (r, len(t)))
        self.finder.make_automaton()
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for t, r in usable.items():
            cut = next((n for n in range(len(t) - 1, 0, -1) if t[:n] in usable), 0)
            self.shorter[r] = (usable[t[:cut]], cut) if cut else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _can_follow(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens yields just these two.

        It does unless some merge across the border comes before the merges that build the two sides, so
        walk down the right edge of the left token and the left edge of the right one, newest merge first.
        """
        a, b, before = left, right, 1 << 62
        while True:
            crossing = self.merged.get((a, b))
            if crossing is not None and crossing < before:
                return False
            if a > b:
                before, down = a, self.tree.get(a)
                if down:
                    a = down[1]
                    continue
                before, down = b + 1, self.tree.get(b)
                if not down:
                    return True
                b = down[0]
            else:
                before, down = b + 1, self.tree.get(b)
                if down:
                    b = down[0]
                    continue
                before, down = a, self.tree.get(a)
                if not down:
                    return True
                a = down[1]

    def _fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        ok = self.fits.get(pair)
        if ok is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            ok = self.fits[pair] = self._can_follow(left, right)
        return ok

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of one piece."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        text, n, fits, longest_from = raw.decode("latin-1"), len(raw), self.fits, self.finder.iter_long
        out, tokens, shut, at = [], [], set(), 0
        longest, moved = longest_from(text), False
        trial = next(longest)[1]
        while True:
            token, size = trial
            if not shut or at + size not in shut:
                ok = not tokens or fits.get((tokens[-1], token))
                if ok or ok is None and self._fits(tokens[-1], token):
                    tokens.append(token)
                    out.append(size)
                    at += size
                    if at == n:
                        return tokens
                    if moved:
                        longest, moved = longest_from(text, at), False
                    trial = next(longest)[1]
                    continue
            moved, less = True, self.shorter[token]
            while less is None:
                shut.add(at)
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte of the text")
                at -= out.pop()
                less = self.shorter[tokens.pop()]
            trial = less

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, add = self.known, ids.extend
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                raw = piece.encode("utf-8")
                got = tuple(self.piece(raw))
                if len(raw) <= CACHE_BYTES:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = got
            add(got)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text whole by the rank file ``vocabulary`` and decode the ids again.

    Returns id, ``n_tokens``, ``ids`` (array of int), ``decoded`` (binary). Null text counts as empty:
    no tokens, empty bytes. Rows are independent: repeated rows repeat, an empty table stays empty, no
    other column is read. Special tokens are not recognised; their strings are ordinary text.
    """
    return _coded(docs, vocabulary, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests (lowercase hex) in place of ids and bytes:
    ``ids_sha256`` of the ids as little-endian unsigned 32-bit integers and ``decoded_sha256``."""
    return _coded(docs, vocabulary, pattern, id_col, text_col, True)


def _coded(docs, vocabulary, pattern, id_col, text_col, digests):
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (ranks, merge_tree(ranks), pattern)})
    data = docs.select(field(id_col).alias("id"), field(text_col).alias("text"))
    schema = docs.select(field(id_col)).schema.add("n_tokens", "long")
    results = [("ids_sha256", StringType()), ("decoded_sha256", StringType())] if digests else [("ids", ArrayType(IntegerType())), ("decoded", BinaryType())]
    for name, kind in results:
        schema = schema.add(name, kind)

    def run(batches):
        held = shared.value  # stays with a worker from task to task, and the coder with it
        if "coder" not in held:
            held["coder"] = Coder(*held["parts"])
        coder = held["coder"]
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                raw = coder.decode(ids)
                counts.append(len(ids))
                packed = np.array(ids, dtype="<u4")
                first.append(hashlib.sha256(packed.tobytes()).hexdigest() if digests else packed.astype(np.int32))
                second.append(hashlib.sha256(raw).hexdigest() if digests else raw)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return data.mapInArrow(run, schema)
