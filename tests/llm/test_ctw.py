import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ctw


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    w = lower(t)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    return [x for x in w.split(" ") if x]


def steps(t, depth):
    """(context, byte) of each byte of a text, its words one space apart and an end behind them."""
    data = b"\n" * depth + " ".join(words(t)).encode() + b"\n"
    return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]


def plain_model(texts, depth):
    """The trees by recursion over every node; scores by walking them."""
    counts = {}

    def path(before):
        return [before[len(before) - d :] for d in range(len(before) + 1)]

    for t in texts:
        for context, byte in steps(t, depth):
            for k in range(8):
                for node in path(context):
                    e = counts.setdefault((node, (1 << k) | byte >> (8 - k)), [0, 0])
                    e[byte >> (7 - k) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weight, children = {}, {}
    for node, bits in counts:
        if node:
            children.setdefault((node[1:], bits), []).append((node, bits))
    for node, bits in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[node, bits])
        weight[node, bits] = own if len(node) == depth else np.logaddexp(own, sum(weight[c] for c in children.get((node, bits), []))) - math.log(2)

    def bit(context, bits):
        p, seen = 0.5, [n for n in path(context) if (n, bits) in counts]
        for node in reversed(seen):
            a, b = counts[node, bits]
            share = 1.0 if len(node) == depth else math.exp(kt(a, b) - math.log(2) - weight[node, bits])
            p = share * (b + 0.5) / (a + b + 1) + (1 - share) * p
        return p

    return lambda t: sum(math.log10(p if byte >> (7 - k) & 1 else 1 - p) for context, byte in steps(t, depth) for k in range(8) for p in [bit(context, (1 << k) | byte >> (8 - k))])


TEXTS = ["The then a hat", "the cat  sat\ton the\nmat", "été \x00x", None, "", " \n", "the cat sat", "a a a a"]
ASKED = ["that zz heathen", "the mat sat on a cat", None, "x\x00 thethe"]


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_against_plain_trees(spark, monkeypatch, depth):
    """Contexts cross words, and grams that training lacks are scored as well, whatever is held in memory."""
    monkeypatch.setattr(ctw, "GROW_GRAMS", 3)
    monkeypatch.setattr(ctw, "WINDOW", 7)
    monkeypatch.setattr(ctw, "FLUSH_GRAMS", 20)
    monkeypatch.setattr(ctw, "HOT_GRAMS", 40 if depth == 3 else 0)
    rows = [(i, t, True) for i, t in enumerate(TEXTS)] + [(100 + i, t, False) for i, t in enumerate(ASKED)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, use boolean").repartition(3)
    got = {r.doc_id: r for r in ctw.score(spark, docs, F.col("use"), depth).collect()}
    want = plain_model(TEXTS, depth)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].score == pytest.approx(want(t), abs=1e-6) and got[i].n_bytes == len(steps(t, depth))
        assert got[i].bits_per_byte == pytest.approx(-want(t) * math.log2(10) / len(steps(t, depth)))


def test_next_byte_probabilities_sum_to_one():
    keys = np.concatenate([k for k, _ in ctw.grams_of([ctw.words_of(t) for t in TEXTS], 3)])
    found, n = np.unique(keys, return_counts=True)
    asked = (found[0] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    every = np.union1d(found, asked)
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, found)] = n
    two = ctw.subtree(every, counts, 3, 2)
    node = (two["nodes"] & np.uint64(0xFFFF)).astype(np.int64)
    at = np.unique(node)
    sums = [np.bincount(np.searchsorted(at, node), two[x], len(at)) for x in ("zeros", "ones", "weight")]
    logs = ctw.Upper(at, *sums).logs(two["keys"], two["bits"])
    assert (10 ** logs[np.isin(two["keys"], asked)]).sum() == pytest.approx(1, abs=1e-9)
    assert ctw._log_kt(np.array([0.0, 3]), np.array([0.0, 2])) == pytest.approx([0, math.lgamma(3.5) + math.lgamma(2.5) - math.log(math.pi) - math.lgamma(6)], abs=1e-8)


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ctw, "HOT_WORDS", 4)
    rows = [(i, f"The cat w{i % 7} sat on the\tM{i}", "x") for i in range(60)] + [(70, None, "x"), (71, " \n", None), (72, "big " * 2_000, "x"), (3, "The cat w3 sat on the\tM3", "x"), (3, "another text", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(ctw.op8_lm_scoring(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.n_tokens, r.base_score))
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10]
    tokens = lambda t: [*words(t), None]
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    log = plain_model(train, ctw.DEPTH)
    want = sorted((i, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), log(t)) for i, t, _ in rows)
    assert len(got) == len(want)
    for r, (i, k, known, base, log) in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, zlib.crc32(str(i).encode()) % 10 == 0, k, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(log, rel=1e-6)


def test_empty_and_untrained(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ctw.op8_lm_scoring(spark, str(tmp_path)).count() == 0
    got = ctw.score(spark, spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (2, 0, 0) and got.score == pytest.approx(3 * 8 * math.log10(0.5)) and got.bits_per_byte == pytest.approx(8)


def test_depth_stays_with_more_than_a_million_grams(spark):
    grams = spark.range(1_100_000).select(F.xxhash64("id").bitwiseAND((1 << 48) - 1).alias("gram"), F.lit(1).cast("long").alias("n")).dropDuplicates(["gram"])
    assert ctw.train(spark, grams).where("log < 0").count() > 1_000_000


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_frequent_grams_are_found(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 1 << 48, n, dtype=np.uint64))
    hot = ctw.Hot(keys, np.arange(len(keys)) * 0.5)
    asked = np.concatenate([keys, rnd.integers(0, 1 << 48, 1000, dtype=np.uint64), keys[:3]])
    at = hot.find(asked)
    where = {int(k): i * 0.5 for i, k in enumerate(keys)}
    assert [None if a < 0 else hot.logs[a] for a in at] == [where.get(int(k)) for k in asked]
