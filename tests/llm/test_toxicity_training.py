"""Toxicity is learnt from every labelled text of the training fold, in blocks whose changes are averaged."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents
from pyspark.sql import functions as F
from test_classifiers import labelled  # noqa: F401

from pairloom.llm import toxicity
from pairloom.llm import words as W
from pairloom.llm.tables import held_out


def bucket(word):
    return int(next(iter(W.iter_words(pa.array([word]), W.ALNUM))).hashes[0] >> np.uint64(64 - toxicity.BITS))


def test_every_labelled_text_teaches(spark):
    """of 30,000 texts with label 0 only about 4,000 were learnt from, so words of few texts were unknown."""
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1875))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).where(~held_out()).limit(30_000)
    docs = docs.withColumn("toxic", (F.col("doc_id") % 500 == 0).cast("int")).withColumn("number", number).cache()
    word = F.when(F.col("toxic") == 1, F.lit("vile")).otherwise(F.concat(F.lit("w"), "number"))
    model = toxicity.fit_toxicity(docs.withColumn("text", F.concat(word, F.lit(" x"), "doc_id")), docs.select("doc_id", "toxic"))
    often = docs.where("toxic = 0").groupBy("number").count().where("count >= 14").collect()
    known = set(model.buckets.tolist())
    assert len(often) > 1000 and bucket("vile") in known
    missing = [r.number for r in often if bucket(f"w{r.number}") not in known]
    assert not missing, len(missing)


def test_many_blocks_learn_as_one(spark, labelled):  # noqa: F811
    docs, labels, _ = labelled
    model = toxicity.fit_toxicity(docs, labels, block_texts=60)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum((got[i] >= toxicity.CUT) == bool(i % 2) for i in range(600)) > 590
    small = toxicity.fit_toxicity(docs, labels, most_buckets=5)
    assert len(small.buckets) <= 5


def test_copies_teach_once(spark):
    rows = [(i, f"plain words number{i}" if i % 3 else f"vile words number{i}", "en") for i in range(300)]
    rows += [(1000 + i, "seldom words", "en") for i in range(200)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000 and r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(documents(spark, rows), labels)
    known = set(model.buckets.tolist())
    assert bucket("vile") in known and bucket("plain") in known and bucket("seldom") not in known


@pytest.mark.parametrize("seed", range(4))
def test_threshold_from_bins_is_the_best(seed):
    rng = random.Random(seed)
    y = np.array([rng.random() < 0.3 for _ in range(400)]).astype(int)
    raw = np.array([rng.choice([0.0, 0.5, 1.0, min(1, max(0, rng.gauss(0.3 + 0.4 * t, 0.2)))]) for t in y])
    at = toxicity._bin(raw)
    bins = sorted(set(at.tolist()), reverse=True)
    n, hits = [np.array([f(at == b) for b in bins]) for f in (np.sum, lambda own: y[own].sum())]
    threshold = toxicity._best_threshold(n, hits, np.array([raw[at == b].min() for b in bins]), np.array([raw[at == b].max() for b in bins]))

    def f1(t):
        return 2 * y[raw >= t].sum() / ((raw >= t).sum() + y.sum())

    best = max(f1(t) for t in raw)
    assert f1(threshold) >= best - 0.005


def test_slices_keep_every_row(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 4)
    lists = [[1, 2], [], [3] * 9, [4], [5], [], [6, 7, 8], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.int32()))], names=["y", "words"])
    parts = list(toxicity._sliced([batch, batch.slice(0, 0), batch.slice(3, 4)]))
    assert [x for p in parts for x in p.column(1).to_pylist()] == lists + lists[3:7]
    codes, bounds = toxicity._lists(parts[1].column(1))
    assert [codes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == parts[1].column(1).to_pylist()
