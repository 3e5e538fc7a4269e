import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import toxicity as tx

BAD = ["vile", "rotten", "wretch"]


def rows(n=900):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        text, y = r.choices(words, k=r.randrange(5, 80)), int(r.random() < 0.15)
        for _ in range(3 * y):
            text.insert(r.randrange(len(text)), r.choice(BAD))
        out.append((i, " ".join(text), y))
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tox")
    more = [(5000, None), (5001, ""), (5002, "Vile rotten wretch! " * 9000), (3, rows()[3][1])]
    spark.createDataFrame([(i, t, "x") for i, t, _ in rows()] + [(*m, None) for m in more], "doc_id long, text string, label string").write.parquet(f"{d}/documents.parquet")
    labels = [(i, y, 1) for i, _, y in rows()] + [(2, None, None), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_held_out(spark, sf):
    got = tx.op1_toxicity(spark, sf).collect()
    assert len(got) == 904
    truth = {i: y for i, _, y in rows()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.7 and by[5002].predicted == 1


def test_labels_of_held_out_rows_have_no_say(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    used = {r.doc_id for r in tx.learning_rows(docs, labels).select("doc_id").collect()}
    assert used and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in used)


def test_weights_are_sparse_and_stage_keeps_clean(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tx.train(spark, tx.learning_rows(docs, labels))
    assert 3 <= len(model) < 400
    kept = tx.keep_clean(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 5002 not in ids and {5000, 5001} <= ids
    assert len(ids & {i for i, _, y in rows() if not y}) >= 0.99 * sum(not y for *_, y in rows())


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.train(spark, tx.learning_rows(docs, none))
    assert tx.score(spark, docs, model, ["doc_id"]).first().score == 0.5
    assert tx.score(spark, docs.limit(0), model, ["doc_id"]).count() == 0


def test_features():
    assert len(tx.features(None)) == len(tx.features(" !!")) == 0
    assert len(tx.features("a b c")) == 3 + 2 + 1
    assert (tx.features("A, B; C") == tx.features("a b c")).all()
