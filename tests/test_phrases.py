from ledgerloom.operators import retrieval


def test_terms_of_several_tokens_meet_records_whole(spark, monkeypatch):
    """Occurrences side by side in one field, repeated tokens, three tokens, and two terms of the same tokens; what is shuffled are occurrences, not their parts."""
    docs = [(1, "s a", "a b", "a b a a a c"), (2, "b", "a", "b a-b! c; a b c"), (3, None, "", "b b")]
    df = spark.createDataFrame(docs, "id long, subject string, object string, body string")
    terms = ["a_b", "a__b", "a_a", "a_b_c", "_c", "b_b", "x_y", "c"]
    kept = {}
    real = retrieval.saved
    monkeypatch.setattr(retrieval, "saved", lambda spark, df, name: kept.setdefault(name, df) is None or real(spark, df, name))
    got = {(r.id, r.term): r.f for r in retrieval.index(spark, df, spark.createDataFrame([(t,) for t in terms], "term string")).collect() if r.term}
    fields = [[x.replace("-", " ").replace("!", "").replace(";", "").split() for x in (s or "", o, b)] for _, s, o, b in docs]
    want = {}
    for (i, *_), sides in zip(docs, fields):
        for t in terms:
            parts = [x for x in t.split("_") if x]
            f = sum(w * sum(side[k : k + len(parts)] == parts for k in range(len(side))) for w, side in zip((3.0, 2.0, 1.0), sides))
            want |= {(i, t): f} if f else {}
    assert got == want and len(got) > 8
    assert "posexplode(parts" not in kept["postings"]._jdf.queryExecution().optimizedPlan().toString()
