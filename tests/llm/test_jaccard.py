import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard as jc


def plain_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return set() if not w else {tuple(w)} if len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute(rows):
    s = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s[i]), d if not s[i] else low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(40)]
    base, rows = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(max(1, int(len(w) * r.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
                k = r.randrange(len(w))
                w[k : k + 1] = [r.choice(vocab)] * r.choice([0, 1, 1, 2])
            w = w or ["x"]
        else:
            w = r.choices(vocab, k=r.choice([1, 2, 3, 4, 6, 9, 12, 20, 40, 80, 200, 400]))
            if r.random() < 0.3:
                w = passage + w
        base.append(w)
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (5, rows[5][1]), (5, rows[9][1]), (n + 3, rows[7][1].upper()), (n + 4, "Q " * 40_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fp string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jc.join(spark, docs).collect())
    assert got == brute(rows)


def held(a):
    out = jc.Sets([])
    out.flat, out.n, out.ends = a, np.array([len(a)]), np.array([len(a)])
    return out


def distance(a, b):
    x, y = (held(s).sketches()[0].view(np.uint64) for s in (a, b))
    k = min(len(x), len(y))
    x, y = (s if len(s) == k else s[:k] ^ s[k:] for s in (x, y))
    return sum(int(z).bit_count() for z in x ^ y)


def test_linked_sets_share_a_bucket():
    r = np.random.default_rng(0)
    linked = 0
    for _ in range(3000):
        n = int(r.integers(6, 700))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop, add = r.integers(0, max(1, n // 8), 2)
        b = np.unique(np.concatenate([r.permutation(a)[: n - drop], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        common = np.intersect1d(a, b).size
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common) and held(a).fingerprints()[0] != held(b).fingerprints()[0]:
            assert distance(a, b) <= len(a) + len(b) - 2 * common
            linked += 1
            assert np.intersect1d(held(a).bucket_keys()[0], held(b).bucket_keys()[0]).size
    assert linked > 500


@pytest.mark.parametrize("need", [80, 85])
def test_parts_of_large_sets(need):
    """Linked sets of many parts share a bucket in a part whose sketches differ in no more bits than the bound of a part."""
    r = np.random.default_rng(need)
    linked = several = 0
    for _ in range(400):
        n = int(r.integers(400, 9000))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop, add = r.integers(0, n * (100 - need) // 130, 2)
        b = np.unique(np.concatenate([r.permutation(a)[: n - drop], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        common = np.intersect1d(a, b).size
        if 100 * common < need * (len(a) + len(b) - common):
            continue
        linked += 1
        x, y = held(a), held(b)
        x.need = y.need = need
        local = [dict(zip(s.local()[0][0].tolist(), s.local()[1][0].reshape(-1, jc.LOCAL).view(np.uint64))) for s in (x, y)]
        codes = set((np.intersect1d(x.bucket_keys()[0], y.bucket_keys()[0]) >> 1 & jc.PART_BITS).tolist())
        several += max(codes) > 1
        apart = {c: sum(int(v).bit_count() for v in local[0][c] ^ local[1][c]) for c in codes}
        assert any(d << (c.bit_length() - 1) <= jc.differing(len(a), len(b), need) for c, d in apart.items())
    assert linked > 150 and several > 100


def test_large_texts_against_brute_force(spark):
    """Texts of several parts that share passages: all links are found, by both ways of asking."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        w = [f"v{r.randrange(50_000)}" for _ in range(r.choice([500, 900, 1500, 2600]))] + passage
        rows.append(w)
        for share in r.sample([0.01, 0.02, 0.03, 0.036, 0.05], 2):
            v = list(w)
            for k in r.sample(range(len(v)), int(len(v) * share)):
                v[k] = f"x{r.randrange(50_000)}"
            rows.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in jc.join(spark, docs).collect()) == brute(rows)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    """Buckets that the sample shows to be large go by parts, with the same result."""
    for name, value in (("SAMPLED", 1), ("LARGE", 3), ("LISTED", 10), ("STAR", 2)):
        monkeypatch.setattr(jc, name, value)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(jc.large_buckets(spark, docs, jc.WIDTH, jc.NEED))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jc.join(spark, docs).collect()) == brute(rows)


def test_batches_do_not_matter():
    texts = [t for _, t in corpus(5)]
    whole = jc.Sets(texts)
    keys, who, _ = whole.bucket_keys()
    for i, t in enumerate(texts):
        one = jc.Sets([t])
        assert one.n[0] == whole.n[i] and (one[0] == whole[i]).all() and one.fingerprints()[0] == whole.fingerprints()[i]
        assert sorted(one.bucket_keys()[0]) == sorted(keys[who == i]) and (one.sketches()[0] == whole.sketches()[i]).all()


def test_bands_and_long_chain(spark):
    for a in [*range(1, 300), 5000, 77_777]:
        b = 100 * a // 85
        i, j = (int(np.searchsorted(jc.EDGES, x, "right")) for x in (a, b))
        assert j - i <= 1
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.fp: r.group for r in jc.components(spark, links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_empty_table(spark):
    assert jc.join(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_whatever_the_splits(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2 if i < 40 else i}x{k}" for k in range(30))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    real, name = jc.linked_rows, "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)

    def other_splits(*args):
        out = real(*args)
        spark.conf.set(name, str(1 << 30))  # from now on a task reads one file
        return out

    monkeypatch.setattr(jc, "linked_rows", other_splits)
    spark.conf.set(name, "1")  # a task reads several files
    try:
        kept = sorted(r.doc_id for r in jc.keep_one(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect())
    finally:
        spark.conf.set(name, before)
    assert kept == [*range(0, 40, 2), *range(40, 80)]


def test_stage_uses_five_words_and_four_fifths(spark):
    w = [f"w{i}" for i in range(100)]
    far, near = [*w], [*w]
    for k in (20, 50, 80):
        far[k] = f"z{k}"
    for k in (30, 70):
        near[k] = f"y{k}"
    # 1,000 words with 22 edits: 0.801 on five words
    long = [f"v{i}" for i in range(1000)]
    edited = [f"u{i}" if i % 45 == 20 else x for i, x in enumerate(long)]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(long)), (5, " ".join(edited))]
    five = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    alike = lambda a, b: len(five(a) & five(b)) / len(five(a) | five(b))
    assert 0.8 < alike(w, near) < 0.815 and alike(w, far) < 0.8 and 0.8 <= alike(long, edited) < 0.815
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jc.keep_one(spark, docs, "").collect()) == [1, 3, 4]


def test_linked_sets_share_a_bucket_at_other_needs():
    r = np.random.default_rng(1)
    for _ in range(400):
        n = int(r.integers(6, 700))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([r.permutation(a)[: n - int(r.integers(0, n // 9 + 1))], r.integers(0, 1 << 63, int(r.integers(0, n // 9 + 1))).astype(np.uint64)]))
        common = np.intersect1d(a, b).size
        x, y = held(a), held(b)
        x.need = y.need = 80
        if 100 * common >= 80 * (len(a) + len(b) - common) and x.fingerprints()[0] != y.fingerprints()[0]:
            assert np.intersect1d(x.bucket_keys()[0], y.bucket_keys()[0]).size


def calls(f):
    n = [0]
    sys.setprofile(lambda frame, event, arg: n.__setitem__(0, n[0] + (event in ("call", "c_call"))))
    try:
        f()
    finally:
        sys.setprofile(None)
    return n[0]


def test_words_and_chunks_cost_no_call_each():
    """Words, seen before or not, are hashed many at a time, and sparse parts bring their chunks along together."""
    fresh = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(50)]
    jc.Sets(fresh).bucket_keys()
    assert calls(lambda: jc.Sets([t.replace("x", "y") for t in fresh])) < 2000  # of 20,000 words
    sparse = jc.Sets([" ".join(f"v{i}x{k}" for k in range(30)) for i in range(2000)])
    assert len(sparse.bucket_keys()[0]) and calls(sparse.bucket_keys) < 2000


def test_words_of():
    r = random.Random(4)
    vocab = {"".join(r.choice("abYZé中\x00.") for _ in range(n)) for n in [*range(1, 140), 300, 5000] for _ in range(4)}
    vocab = [*vocab, *("a" + "\x00" * k for k in range(20))]
    texts = [None, "", " \t\n", "x", "", *("".join(r.choice([" ", "\t", "\n ", "\x0b", "\x0c\r"]) + w for w in r.choices(vocab, k=r.randrange(12)))[r.randrange(2) :] + r.choice(["", " "]) for _ in range(800)), "y"]
    words = [(t or "").encode().lower().split() for t in texts]
    h, n = jc.words_of(texts)
    assert n.tolist() == [len(w) for w in words]
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip((w for t in words for w in t), h.tolist()))
    assert len(set(known.values())) == len(known) > 400
    # a slice of an array, of either kind of strings, has the same hashes
    whole, ends = h.copy(), np.cumsum(n)
    for kind in (pa.string(), pa.large_string()):
        h, m = jc.words_of(pa.array(texts, kind).slice(100, 300))
        assert (m == n[100:400]).all() and (h == whole[ends[99] : ends[399]]).all()
