"""Packing of documents: pieces against the tokenizer itself, constraints and gaps, the number of sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedmill.llm import packing
from feedmill.llm.packing import WordCoder, best_fit, pack, pack_documents, sequences

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "Plain words, and more.\nA line", "á ́b <|endoftext|>x y<|startoftext|> z", "ΑΣ ΑΣ. 's don't   x y\x0b\x0cz", "\n\n\t a\r\n", "İstanbul ǅ ﬁ 　 ж", "1234 a1b2 !!! ??", "Don't. can't, we'll; (it's) \"so\" e.g. U.S. x.y. ... end.", "a.b?! c?. d,. e." + "z" * 200, "\U0001f600 ok. é. ß, Ω.",
]


def ids_of(text):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def test_coder_equals_the_tokenizer(monkeypatch):
    with open(VOCABULARY, encoding="utf-8") as f:
        coder = WordCoder(f.read())
    rnd = random.Random(2)
    signs = "aA bB\n.,'!?;:sStT1 \tZzé<|>Σσ́ -"
    texts = ODD + ["".join(rnd.choices(signs, k=rnd.randint(1, 60))) for _ in range(2_000)]
    whole = lambda t: [int(i) for part in coder.encode(t or "") for i in part]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for t in texts:
        assert whole(t) == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    monkeypatch.setattr(packing, "BLOCK", 50)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 10)
    for t in texts[:300] + [" ".join(filter(None, texts[:300]))]:
        assert whole(t) == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_new_words_are_encoded_as_one_text(monkeypatch):
    """Few calls of the tokenizer and few texts for many new words; words that it splits, or that are no letters, keep their ids."""
    with open(VOCABULARY, encoding="utf-8") as f:
        coder = WordCoder(f.read())
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdeghiorstuEF", k=rnd.randint(1, 12))) + rnd.choice(["", "", ".", "'s", "1", "é"]) for _ in range(3_000)]
    asked, real = [], coder.tokenizer
    coder.tokenizer = type("Counted", (), {"encode_batch_fast": lambda _, texts, **kw: (asked.extend(texts), real.encode_batch_fast(texts, **kw))[1]})()
    assert [int(i) for part in coder.encode(" ".join(words)) for i in part] == ids_of(" ".join(words))
    assert len(asked) < len(set(words)) * 0.6


def valid(rows, lengths, tokens, documents=None, cost=None):
    """Every piece once, sequences without gaps and under every constraint; returns the number of sequences."""
    assert sorted(r.length for r in rows) == sorted(lengths)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens and len(parts) <= (documents or tokens) and sum(n * n for _, n in parts) <= (cost or tokens**2)
    return len(by)


def test_documents(spark):
    long = "word " * 9_000
    docs = [(i, t) for i, t in enumerate(ODD)] + [(50, long), (50, long), (None, "no id")] + [(100 + i, "few words " * i) for i in range(60)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id bigint, text string, `Length.x` string").repartition(3)
    rows = pack_documents(df, VOCABULARY, with_ids=True).collect()
    want = []
    for d, t in docs:
        ids = [*ids_of(t), 1]
        want += [(str(d), k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()), ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows) == sorted(want)
    n = valid(rows, [w[3] for w in want], 4096)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1
    assert pack_documents(df.limit(0), VOCABULARY).count() == 0
    packed = spark.createDataFrame(rows)
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_capacities(rule):
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(1, 1000, 3_000)
    for documents, cost in ((1000, 10**6), (3, 10**6), (1000, 400_000 + 999**2)):
        bins, offsets = best_fit(lengths, (1000.0, float(documents), float(cost)), rule)
        n = bins.max() + 1
        assert np.bincount(bins, lengths).max() <= 1000 and np.bincount(bins).max() <= documents and np.bincount(bins, lengths.astype(float) ** 2).max() <= cost
        for b in range(0, n, 50):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.concatenate([[0], np.cumsum(lengths[own])[:-1]])).all()
        assert n <= 1.03 * max(lengths.sum() / 1000, len(lengths) / documents) + 2 or cost < 10**6 * 2


def test_groups_are_packed_together_in_the_end(spark):
    """Many small groups: what they leave open is packed again, so that little more than the least number of sequences is used."""
    lengths = [random.Random(9).randint(1, 900) for _ in range(1)] + [random.Random(i).randint(1, 900) for i in range(2_000)]
    df = spark.createDataFrame([(n, "x") for n in lengths], "length bigint, place string")
    rows = pack(df, 1000, group=100).collect()
    assert {r.place for r in rows} == {"x"}
    assert valid(rows, lengths, 1000) <= 1.02 * sum(lengths) / 1000 + 3
    few = pack(df, 1000, documents=2, group=500)
    assert few.groupBy("sequence_id").count().agg(F.max("count")).first()[0] <= 2


def test_ending_signs_and_joint_texts():
    """Words share their letters whatever signs end them; ids of texts learned together are the tokenizer's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from feedmill.llm.packing import WordCoder

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        coder = WordCoder(f.read())
    texts = ["bug*** Bug, bug!!' ÉTÉ.### été it's' x's. a<|endoftext|> ab|> <|.", "", " ", "İx. ß, é. ª! º? µ; đ.%% 9. 9!! -- don't…", "word***\nWÖRD&&&\t" * 30_000]
    got = [[i for block in blocks for i in block.tolist()] for blocks in coder.encode_each(texts)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert coder._parts("Bug***") == ("bug", "***") and coder._parts("a<|endoftext|>") == ("a<|endoftext|>", "")
