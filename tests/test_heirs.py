import random

from ledgerloom.operators import ledger


def test_heirs_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(3), r.choice("ab"), r.choice(["x", "y", "z", None]), r.choice([None, *range(1, 60)])) for i in range(400)]
    rows += [(1000, None, "a", "x", 1), (1001, None, "a", "y", 2)]
    docs = spark.createDataFrame(rows, "id long, store int, relation string, object string, created long").repartition(3)
    want = {}
    for a in rows:
        later = [b[0] for b in rows if a[1] is not None and a[1:3] == b[1:3] and b[0] > a[0] and None not in (a[3], b[3], a[4], b[4]) and b[3] != a[3] and b[4] >= a[4]]
        if later:
            want[a[0]] = min(later)
    assert {x.id: x.heir for x in ledger.heirs(docs).collect()} == want


def test_chain_ends(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "id long, heir long")
    assert {r.id: (r.last, r.steps) for r in ledger.chain_ends(spark, links).collect()} == {i: (20, 20 - i) for i in range(20)}
