import numpy as np
import pytest

from ledgerloom.llm import topk


def brute(rows, k=5, by=50):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, [int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q in ok:
        if q % by == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, tmp_path, seed):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1, 30])).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, [1.0] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (2200, [0.0] * 8), (2250, [1.0, 2.0, 3.0]), (None, [1.0] * 8), rows[50]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", topk.F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    for block, queries in ((4096, 1024), (50, 4)):
        got = topk.search(spark, spark.read.parquet(f"{tmp_path}/embeddings.parquet"), topk.F.col("vec_id") % 50 == 0, 5, block=block, queries=queries)
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_query_empty_and_large(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert topk.op9_exact_topk(spark, str(tmp_path)).count() == 0
    rows = [(0, [1e7, 1.0]), (1, [1e7, -3.0]), (2, [2.0, 2e6]), (3, [9e6, 9e6])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(spark, docs, topk.F.col("vec_id") % 50 == 0, 5).collect())) == brute(rows)
    # beyond a long: the end of it
    far = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(spark, far, topk.F.col("vec_id") == 0, 5).collect())) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]


def test_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(topk.ORACLE).fetchall())
    assert sorted(map(tuple, topk.op9_exact_topk(spark, d).collect())) == want


def test_queries_travel_once_for_each_group(spark, monkeypatch):
    """What the last task function reads is each block of candidates once and each block of queries once for each group, not both for each pair."""
    r = np.random.default_rng(5)
    rows = [(i, (r.choice([-1.0, 1.0], size=8)).tolist()) for i in range(1200)]  # all of one length: no pair is left out by it
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    read = []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: read.append(df) or real(df, f, schema))
    got = topk.search(spark, docs, topk.F.col("vec_id") % 10 == 0, 5, block=10, queries=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, by=10)
    blocks, asked = 1200 // 10 + 4, 120 // 10 + 4
    assert read[-1].count() <= blocks + asked * 2 * spark.sparkContext.defaultParallelism < blocks * asked / 4


@pytest.mark.parametrize("size", [1.0, 2.0**18, 2.0**22])
def test_crowded_blocks_keep_the_first_of_ties(spark, size):
    """More reach a threshold in a block than are kept, equal ones among them: as doubles hold the scores, and as they don't."""
    r = np.random.default_rng(6)
    rows = [(i, (size * r.integers(-2, 3, size=4)).tolist()) for i in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = {i: [256 * int(x) for x in e] for i, e in rows}
    score = lambda q, i: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[i]))))
    want = [(q, n + 1, i, -x) for q in range(0, 400, 50) for n, (x, i) in enumerate(sorted((-score(q, i), i) for i in v if i != q)[:5])]
    for block, group in ((4096, 1 << 20), (30, 1 << 10)):
        got = topk.search(spark, docs, topk.F.col("vec_id") % 50 == 0, 5, block=block, queries=4, group=group)
        assert sorted(map(tuple, got.collect())) == want
