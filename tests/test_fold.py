import itertools

import pandas as pd

from ledgerloom.plans import fold


def say(id, body, kind="decision", key="", created=None, op="say", target=None):
    return {"store": 1, "id": id, "op": op, "kind": kind, "key": key, "body": body, "created": created or id * 1000, "target": target}


def standing(rows):
    s = fold.Store()
    for r in sorted(rows, key=lambda r: r["id"]):
        list(s.step(*(r[c] for c in ("id", "op", "kind", "key", "body", "created", "target"))))
    return {e.body for e in s.standing()}, s


def test_by_words_key_and_quantity():
    assert standing([say(1, "cache layer uses memcached"), say(2, "switched to redis for the cache layer")])[0] == {"switched to redis for the cache layer"}
    assert standing([say(1, "x", "invariant", "k"), say(2, "y", "invariant", "k")])[0] == {"y"}
    assert standing([say(1, "timeout of 30 seconds for uploads"), say(2, "60 seconds")])[0] == {"60 seconds"}
    assert len(standing([say(1, "cache layer uses memcached"), say(2, "billing page gets a header")])[0]) == 2


def test_late_arrival_is_a_conflict_not_a_retirement(spark):
    rows = [say(1, "y", "invariant", "k", created=9000), say(2, "x", "invariant", "k", created=1000)]
    assert len(standing(rows)[0]) == 2
    got = fold.fold(spark.createDataFrame(rows, "store long, id long, op string, kind string, key string, body string, created long, target long")).collect()
    assert [(r.id, r.what, r.other, r.cause) for r in sorted(got, key=lambda r: r.seq)] == [(1, "stored", None, ""), (2, "stored", None, ""), (2, "conflict", 1, "key")]


def test_restatement_revives_and_undo_returns():
    a, b = say(1, "x", "invariant", "k"), say(2, "y", "invariant", "k")
    assert standing([a, b, say(3, "x", "invariant", "k")])[0] == {"x"}
    assert standing([a, b, say(3, "", op="undo", target=2)])[0] == {"x"}


def test_unrelated_stores_in_any_order_and_twice():
    groups = [[say(1, "cache layer uses memcached"), say(2, "switched to redis for the cache layer")], [say(3, "x", "invariant", "k"), say(4, "y", "invariant", "k")], [say(5, "colour is green today")]]
    want = standing(sum(groups, []))[0]
    for order in itertools.permutations(groups):
        rows = [r | {"id": i} for i, r in enumerate(sum(order, []), 1)]
        assert standing(rows)[0] == want
    twice = sum(groups, [])
    assert standing(twice + [r | {"id": r["id"] + 100} for r in groups[2]])[0] == want


def test_empty():
    assert fold.run(1, pd.DataFrame([], columns=["id", "op", "kind", "key", "body", "created", "target"])).empty


def test_the_cap_counts_what_stands_and_state_is_bounded(monkeypatch):
    from ledgerloom.plans import fold as f

    monkeypatch.setattr(f, "CAP", 3)
    store = f.Store()
    out = []
    for i in range(6):
        out += store.step(i, "say", "rule", "k", f"value {i}", i)
    out += store.step(9, "say", "episode", "", "something happened", 9)
    assert not any(e[3] == "cap" for e in out) and len(store.live) == 2
    for i in range(20, 40):
        out += store.step(i, "say", "episode", "", f"event {i}", i)
    assert len(store.live) == 3 and len(store.entries) <= 6 and len(store.said) <= 6


def test_an_undo_leaves_later_changes(monkeypatch):
    from ledgerloom.plans import fold as f

    store = f.Store()
    for i, body in enumerate(["a", "b"]):
        list(store.step(i, "say", "rule", "k", body, i))
    list(store.step(2, "say", "rule", "k", "c", 2))
    assert [e[1] for e in store.step(3, "undo", "", "", "", 3, 2)] == ["revoked", "revived"]
    list(store.step(4, "say", "rule", "k", "d", 4))
    assert store.entries[1].by == 4 and [e.id for e in store.standing()] == [4]
