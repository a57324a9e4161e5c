"""Prefix trie of conversations, against a brute-force trie of whole sequences."""

import hashlib
import random
import zlib

import pytest

from feedmill.llm import prefix_trie
from feedmill.llm.prefix_trie import conversation_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(r or "", x or ""), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += p not in children
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], ends(p, m)) for p, m in nodes.items()), key=str)


def same(spark, rows):
    got = sorted((tuple(r) for r in conversation_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    assert got == brute(rows)
    return got


def test_small_cases(spark):
    rows = [(c, t, "user", f"turn {t} of {c % 3}") for c in range(0, 12) for t in range(7)]
    rows += [(103, 1, None, None), (103, None, "user", "null turn first"), (104, 2, "a", "tie"), (104, 2, "b", "tie"), (104, 2, "a", "tie"), (None, 1, "user", "no conversation"), (205, 0, "user", "lost: its family has no first"), (300, 1, "x", "é\U0001f600")]
    same(spark, rows)


def test_empty_and_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_trie(none).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "hi", "q")], TURNS + ", `name.x` string")
    assert conversation_trie(more).count() == conversation_trie(more.drop("name.x")).count() > 0


def test_long_and_hot_conversations(spark):
    """Sequences that are cut several times, with branches at all depths and both sides of the cuts; a third of all rows in one
    conversation; many copies of one, whose ids fill several pieces; lengths of just one and two ranges."""
    rnd = random.Random(3)
    base = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(150)]
    rows = []
    for c in range(1000, 1060):
        cut, n = rnd.choice([0, 5, 15, 16, 17, 31, 32, 33, 48, 64, 65, 100]), rnd.choice([16, 32, 33, 64, 90, 130])
        turns = base[:cut] + [("user", f"own {t} of {c % 7}") for t in range(cut, n)]
        rows += [(c, t, *turns[t]) for t in range(len(turns))]
    rows += [(7, t, "user", f"only {t // 3}") for t in range(300)]
    rows += [(c, t, "user", f"copy {t}") for c in range(5_000, 7_500, 2) for t in range(2)]
    same(spark, rows)


@pytest.mark.parametrize("leaf", [2])
def test_cut_at_other_sizes(spark, monkeypatch, leaf):
    monkeypatch.setattr(prefix_trie, "LEAF", leaf)
    rnd = random.Random(leaf)
    rows = [(c, t, "user", f"{t} {rnd.random() < 0.2}") for c in range(30) for t in range(rnd.randint(1, 11))]
    same(spark, rows)
