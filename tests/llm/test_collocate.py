import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocate


def brute(rows, least, top, longest):
    n, f = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang or "und", tuple(ws[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, ws), a in found.items():
        if any(g == lang and len(long) > len(ws) and b >= a and any(long[i : i + len(ws)] == ws for i in range(len(long))) for (g, long), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], n[lang]))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return got


def made(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["ÀB", "Zz", "a\x00b", "of", "of", "the", "the", "the"]
    out = []
    for _ in range(n):
        ws = [rnd.choice(words[: rnd.randint(5, len(words))]) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.3:
            ws += ["Fixed", "passage", "of", "seven", "words", "that", "repeats"] * rnd.randint(1, 3)
        out.append(("".join(w + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for w in ws), rnd.choice(["en", "en", "en", "de", None, "und"])))
    return [*out, (None, "en"), ("", None), (" .,; ", "fr"), ("one", "fr")]


@pytest.mark.parametrize("seed,least,top,longest,words,share", [(1, 3, 20, 5, 2, 0.05), (2, 2, 7, 4, 1, 0.01), (3, 5, 2000, 5, 4000, 0.3), (4, 4, 1, 3, 1, 0.001)])
def test_brute_force(spark, monkeypatch, seed, least, top, longest, words, share):
    """Few first words, so that the search goes on in further waves."""
    rows = made(seed)
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, phrase int, word string").repartition(3)
    got = collocate.mine(spark, docs, least, top, longest, words, share)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, least, top, longest))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocate.mine(spark, docs).collect() == []


def test_hashes_match_sql(spark):
    df = spark.createDataFrame([("en", "wörd"), ("und", ""), ("", "x" * 100)], "lang string, word string")
    for r in df.select("lang", "word", F.xxhash64("lang", "word").alias("h"), F.xxhash64("lang").alias("g")).collect():
        seed = collocate.hash_of(r.lang, 42)
        assert seed == r.g & (1 << 64) - 1
        assert collocate.hash_of(r.word, seed) == r.h & (1 << 64) - 1


def test_products_beyond_64_bits(spark):
    big = 9 * 10**15
    counts = spark.createDataFrame([("en", "a", 4 * 10**15), ("en", "b", 3 * 10**15), ("en", "a b", 2 * 10**15 + 1)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", 2, 2 * 10**15 + 1, False)], "lang string, phrase string, m int, f long, held boolean")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    (r,) = collocate.scores(counts, phrases, totals, 5).collect()
    assert r.score == 1000 * (2 * 10**15 + 1) * big // (12 * 10**30)
