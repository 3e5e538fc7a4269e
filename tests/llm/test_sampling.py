import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.common import picked


@pytest.mark.parametrize("total", [1, 1000, 10**9, 10**12, 10**15])
@pytest.mark.parametrize("most", [300, 4096, 10_000, 20_000])
def test_shares_hold_at_any_size(spark, total, most):
    """The share of all 63-bit hashes is most / total, neither 0 nor more."""
    bound = (1 << 63) * most // total
    at = spark.createDataFrame([(h,) for h in (-1, 0, min(bound, (1 << 63) - 1) - 1, -(1 << 63), min(bound, (1 << 63) - 1))], "h long")
    got = [r[0] for r in at.select(picked(F.col("h"), most, total)).collect()]
    assert got == ([True] * 5 if total <= most else [False, True, True, True, False])
    assert total <= most or 0.99 < bound / (1 << 63) * total / most <= 1


def test_each_class_has_its_share():
    assert [toxicity.most_of(y, {0: 10**12, 1: 10**8}, 10_000) for y in (0, 1)] == [5000, 5000]
    assert [toxicity.most_of(y, {0: 10**12, 1: 7}, 10_000) for y in (0, 1)] == [9993, 5000]
    assert [toxicity.most_of(y, {0: 3}, 10_000) for y in (0, 1)] == [10_000, 9997]


def test_a_rare_class_is_learnt(spark):
    rows = [(i, "calm words of a quiet day", 0) for i in range(4000)] + [(i, "vile slur here", 1) for i in range(4000, 4040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    model = toxicity.train(spark, df, max_train=100)
    got = toxicity.score(spark, spark.createDataFrame([(1, "vile slur here"), (2, "a quiet day")], "doc_id long, text string"), model, ["doc_id"])
    assert {r.doc_id: r.predicted for r in got.collect()} == {1: 1, 2: 0}
