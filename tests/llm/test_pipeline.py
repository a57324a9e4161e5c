"""The pipeline's stages: what goes and what stays."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from feedmill.llm.common import settle


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en'").limit(60).collect()
    texts = [r.text[:600] for r in real]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs += [(1000 + i, t[:300] + " you idiot you moron", "en", "s", 9) for i, t in enumerate(texts)]
    passage = "zalpha zbeta zgamma zdelta zepsilon zeta zeta2 ztheta ziota zkappa zlambda"
    docs += [(5000, "12 34 !!", None, "s", 5), (5001, None, None, None, None), (5002, "before it " + passage + " and after it", "en", "s", 1), (5003, "of the thing and the " * 5 + "unlike any", "en", "s", 1), (5004, "of the thing and the " * 5 + "unlike any", "en", "s", 1)]
    path = write(spark, tmp_path / "sf", docs, [(i, 1, int(i >= 1000)) for i in [*range(60), *range(1000, 1060)]], [(1, passage)])
    d, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, path)
        assert out.columns == d.columns, name
        d = settle(out)
        kept[name] = {r.doc_id for r in d.select("doc_id").collect()}
    assert not [i for i in kept["toxicity"] if 1000 <= i < 1060] and {*range(60), 5000, 5001, 5002} <= kept["toxicity"]
    assert kept["toxicity"] - kept["language"] == {5000, 5001}
    assert 5003 in kept["near_duplicates"] and 5004 not in kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["decontamination"] == {5002}
    got = P.run(spark, path)
    assert {r.doc_id for r in got.collect()} == kept["decontamination"] and got.columns[0] == "doc_id"


def test_texts_in_an_unlearned_script_go(spark):
    rnd, docs = random.Random(2), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    word = lambda a, b: "".join(chr(rnd.randint(a, b)) for _ in range(rnd.randint(2, 8)))
    scripts = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x905, 0x939)]
    rows = [(1_000_000 + i, " ".join(word(*scripts[i % 4]) for _ in range(rnd.choice([3, 10, 40, 200]))), None) for i in range(800)]
    kept = {r.doc_id for r in P.drop_without_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "").select("doc_id").collect()}
    assert len([i for i in kept if i >= 1_000_000]) <= 8
    assert {r.doc_id for r in docs.filter(F.length("text") >= 40).collect()} <= kept


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, tmp_path, k):
    path = write(spark, tmp_path / "sf", [], [], [])
    out = P.STAGES[k][1](spark, spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit(1)), path)
    assert out.count() == 0
