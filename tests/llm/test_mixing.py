import duckdb
import pytest

from ledgerloom.llm import mixing as mx

SF = "/root/testdata/sf0.01"


def test_oracle_and_marginals(spark):
    got = {r.doc_id: r for r in mx.op5_mixing(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute("select doc_id, source, lang, topic, n_tokens, probability, kept from (" + mx.ORACLES["op5_mixing"] + ")").fetchall()
    assert len(want) == len(got)
    for i, source, lang, topic, n, p, kept in want:
        r = got[i]
        assert (r.source, r.lang, r.topic, r.n_tokens, r.kept) == (source, lang, topic, n, kept) and r.probability == pytest.approx(p, abs=2e-6)
    total = sum(r.n_tokens for r in got.values())
    assert sum(r.n_tokens * r.probability for r in got.values()) == pytest.approx(0.6 * total, rel=1e-3)


def test_raking_meets_given_targets(spark):
    cells = spark.createDataFrame([(s, l, "x", t) for s, l, t in [("a", "en", 50), ("a", "de", 5), ("b", "en", 20), ("b", "de", 25)]], "source string, lang string, topic string, tokens long")
    targets = {
        "source": spark.createDataFrame([("a", 0.3), ("b", 0.7)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, target double"),
    }
    got = mx.rake(spark, cells, targets, sweeps=30).collect()
    for m, c, t in (("source", "a", 0.3), ("lang", "en", 0.5)):
        assert sum(r.weight for r in got if r[m] == c) == pytest.approx(t, rel=1e-6)


def test_edges(spark, monkeypatch):
    rows = [(1, None, None, None, 5), (2, "", "en", "s", 5), (2, "", "en", "s", 5), (3, "a b " * 50_000, "en", "s", 5), (4, "one two", "de", None, 5), (None, "x", "de", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    got = mx.mix(spark, docs).collect()
    assert len(got) == 6 and all(0 <= r.probability <= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc.doc_id == 3} == {100_000} and all(r.kept for r in got if r.doc.doc_id in (1, 2))
    stage = mx.sample_to_targets(spark, docs, "")
    assert stage.columns == docs.columns and {r.topic for r in stage.collect()} == {5}
    assert mx.mix(spark, docs.limit(0)).count() == 0
    monkeypatch.setattr(mx, "BROADCAST_CELLS", 0)
    assert sorted((str(r.doc.doc_id), r.probability, r.kept) for r in mx.mix(spark, docs).collect()) == sorted((str(r.doc.doc_id), r.probability, r.kept) for r in got)
