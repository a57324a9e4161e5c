"""Near-duplicate flags by stored representatives: equal to those of one run by pairs, and linear in copies."""

import random

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from feedmill.operators import neardup, neardup_index
from feedmill.operators.neardup import near_duplicate_flags
from feedmill.operators.neardup_index import NearDuplicateIndex, flags_without_pairs

ROW = "app_id string, pos bigint, review_text string"


def texts(n, seed=1):
    """Random texts, copies, edited copies, and chains each of which resembles its neighbours only; short and null ones."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 300)}"
    base = [[word() for _ in range(40)] for _ in range(5)]
    out = []
    while len(out) < n:
        k = rnd.random()
        if k < 0.3:
            t = list(rnd.choice(base))
            t[rnd.randrange(40)] = word()
            out.append(" ".join(t))
        elif k < 0.5:
            i = rnd.choice(range(5))
            base[i] = [*base[i][1:], word()]  # drifts: a chain
            out.append(" ".join(base[i]))
        elif k < 0.6 and out:
            out.append(rnd.choice(out))
        elif k < 0.65:
            out.append(rnd.choice([None, "", "two words"]))
        else:
            out.append(" ".join(word() for _ in range(rnd.randint(3, 60))))
    return [(f"app{i % 2}", i, t) for i, t in enumerate(out)]


def flags(df):
    return {r.pos: r.is_near_duplicate for r in df.select("pos", "is_near_duplicate").collect()}


def test_one_run_and_batches_equal_pairs(spark, tmp_path, monkeypatch):
    rows = texts(300)
    df = spark.createDataFrame(rows, ROW)
    want = flags(near_duplicate_flags(df))
    assert 50 < sum(want.values()) < 250
    assert flags(flags_without_pairs(df)) == want
    index, got = NearDuplicateIndex(spark, str(tmp_path / "i")), {}
    for k in range(3):
        part = df.filter((F.col("pos") >= 100 * k) & (F.col("pos") < 100 * k + 100))
        got |= flags(index.flags(part, f"{k}"))
    assert got == want
    again = df.filter("pos < 100")
    assert flags(index.flags(again, "0")) == {p: want[p] for p in range(100)}  # a replay
    assert index.kept().count() == sum(1 for r in rows if r[2] and len(r[2].split()) > 2 and not want[r[1]])


def test_narrow_front(spark, monkeypatch):
    """Bands with more undecided rows than are compared at once."""
    monkeypatch.setattr(neardup_index, "FRONT", 2)
    df = spark.createDataFrame(texts(60, 2), ROW)
    assert flags(flags_without_pairs(df)) == flags(near_duplicate_flags(df))


def test_group_of_edited_copies_is_linear(spark, monkeypatch):
    """Thousands of copies with one word changed each: confirmed pairs stay near the number of rows."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(4_000):
        t = list(base)
        t[rnd.randrange(120)] = f"x{i}"
        rows.append(("a", i, " ".join(t)))
    pairs, confirm = [], neardup_index._confirmed
    monkeypatch.setattr(neardup_index, "_confirmed", lambda p, *rest: (pairs.append(p.distinct().count()), confirm(p, *rest))[1])
    got = flags(flags_without_pairs(spark.createDataFrame(rows, ROW)))
    assert sum(not f for f in got.values()) >= 1 and sum(pairs) < 40 * len(rows)
    kept = [rows[p][2] for p, f in got.items() if not f]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in kept]
    assert all(len(a & b) / len(a | b) < 0.85 for i, a in enumerate(sets) for b in sets[:i])


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], ROW)
    assert flags_without_pairs(none).count() == 0 and NearDuplicateIndex(spark, str(tmp_path / "i")).flags(none, "0").count() == 0


def test_sets_go_to_cells_not_to_pairs(spark, monkeypatch):
    """A group of n near copies has n squared pairs; what is compared in a task is n sets, and every pair is found as by brute force."""
    base = [f"b{i}" for i in range(120)]
    rows = [("a", i, " ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]])) for i in range(100)] + [("a", 200 + i, f"c{i} d e f g") for i in range(3)]
    monkeypatch.setattr(neardup, "CELL", 40, raising=False)
    sent, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, *a: (sent.append(d := join(self, *a)), d)[1])
    got = {(r.first, r.second) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, ROW)).collect()}
    monkeypatch.undo()
    sets = {p: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, p, t in rows}
    assert got == {(p, q) for p in sets for q in sets if p < q and len(sets[p] & sets[q]) / len(sets[p] | sets[q]) >= 0.85} and len(got) > 4_000
    # the old code joined a set to each of its pairs
    assert 0 < max(d.count() for d in sent if {"s", "sa", "sb"} & set(d.columns)) <= 6 * len(rows)


def test_rows_that_share_no_band_need_no_sets(spark, monkeypatch):
    """Sets of rows that resemble nothing are neither compared nor handed on; copies are found by their digests."""
    rnd = random.Random(5)
    rows = [("a", i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(50))) for i in range(300)]
    rows += [("a", 300 + i, rows[i][2]) for i in range(20)] + [("a", 400, rows[0][2] + " more")]
    handed, confirm = [], neardup_index._confirmed
    monkeypatch.setattr(neardup_index, "_confirmed", lambda p, s, *rest: (handed.append(s.count()), confirm(p, s, *rest))[1])
    assert {p for p, f in flags(flags_without_pairs(spark.createDataFrame(rows, ROW))).items() if f} == {*range(300, 320), 400}
    assert max(handed) == 2


def test_screen_counts_sets_that_stay_anyway_as_partners(spark):
    """Pairs of short sets, of which one may have too few shingles in the screened quarter: none is lost."""
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        t = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(9, 30))]
        rows += [("a", 2 * i, " ".join(t)), ("a", 2 * i + 1, " ".join([*t, "end"]))]
    sets = {p: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, p, t in rows}
    want = {(p, p + 1) for p in sets if p % 2 == 0 and len(sets[p] & sets[p + 1]) / len(sets[p] | sets[p + 1]) >= 0.85}
    assert {(r.first, r.second) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, ROW)).collect()} == want
