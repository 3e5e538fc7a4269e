import random

from ledgerloom.operators.telemetry import shared_words


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 2), i, sorted(rnd.sample("abcdefghijkl", rnd.randint(0, 6)) if i % 4 else rnd.sample("abc", rnd.randint(0, 3)))) for i in range(120)]
    want = {
        (s, min(i, j), max(i, j), len(set(a) & set(b))) for k, (s, i, a) in enumerate(rows) for t, j, b in rows[k + 1 :]
        if s == t and len(set(a) & set(b)) >= max(2, 0.5 * min(len(a), len(b)))
    }
    got = [tuple(r) for r in shared_words(spark.createDataFrame(rows, "store int, id int, words array<string>")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
