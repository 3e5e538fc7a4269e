import json

from ledgerloom.streaming import telemetry as st


def lines(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_delivery_fold(spark, tmp_path):
    lines(tmp_path / "log/a.json", [{"at": 1, "session": "s", "reason": "recall", "ids": [5, 6, 7], "tokens": 100}, {"at": 2, "session": "s", "reason": "gated", "ids": None, "tokens": 0}])
    lines(tmp_path / "log/b.json", [{"at": 3, "session": "t", "reason": "recall", "ids": [5], "tokens": 9}])
    st.to_end(st.by_reason(st.deliveries(st.log(spark, str(tmp_path / "log"), files=1))), "by_reason", str(tmp_path / "c1"), "complete")
    assert {(r.reason, r.n, r.tokens) for r in spark.table("by_reason").collect()} == {("recall", 4, 108), ("gated", 1, 0)}


def test_beats_and_epochs(spark, tmp_path):
    lines(tmp_path / "beat/a.json", [{"hook": "h", "session": "s", "at": 10}, {"hook": "h", "session": "s", "at": 15, "ok": 1, "ms": 5.0}, {"hook": "h", "session": "s", "at": 20}, {"hook": "g", "session": "s", "at": 7, "ok": 0, "ms": 1.0}])
    lines(tmp_path / "beat/b.json", [{"hook": "h", "session": "s", "at": 29, "ok": 0, "ms": 9.0}])
    st.to_end(st.beats(st.log(spark, str(tmp_path / "beat"), st.BEAT)), "beats", str(tmp_path / "c2"))
    assert {(r.hook, r.started_at, r.ok) for r in spark.table("beats").collect()} == {("h", 10, 1), ("h", 20, 0), ("g", 7, 0)}
    lines(tmp_path / "ep/a.json", [{"session": "s", "at": t} for t in (0, 20_000, 29_999, 31_000, 60_999, 61_000)])
    st.to_end(st.epochs(st.log(spark, str(tmp_path / "ep"))), "epochs", str(tmp_path / "c3"))
    assert [(r.epoch, r.began) for r in spark.table("epochs").orderBy("epoch").collect()] == [(1, 0), (2, 31_000), (3, 61_000)]


def test_ledger_over_a_stream(spark, tmp_path):
    schema = "store long, id long, op string, kind string, key string, body string, created long, target long"
    row = lambda i, body: {"store": 1, "id": i, "op": "say", "kind": "invariant", "key": "k", "body": body, "created": i, "target": None}
    for name, r in (("a", row(1, "x")), ("b", row(2, "y"))):
        lines(tmp_path / f"st/{name}.json", [r])
        st.to_end(st.ledger(st.log(spark, str(tmp_path / "st"), schema)), str(tmp_path / "events"), str(tmp_path / "c4"))
    assert {(r.id, r.what, r.other) for r in spark.read.parquet(str(tmp_path / "events")).collect()} == {(1, "stored", None), (2, "stored", None), (1, "retired", 2)}
