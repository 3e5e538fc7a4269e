"""Phrase collocation mining: best-first branch-and-bound growth from prefix counts.

A phrase is 2 to ``LONGEST`` words in a row within a piece of a text; its score is
the smallest ``floor(1000 * a * n / (l * r))`` over its cuts in two. As the count of a
phrase is at most that of each part, no phrase scores over ``1000 * n / f(first word)``,
nor over ``1000 * n / f(last word)``: rare words have the highest bounds. The search
keeps the words of each language as a frontier in that order and expands it in waves:

* the first wave takes the best-bounded words, at least ``FIRST_WORDS`` and
  ``FIRST_SHARE`` of a language's words; one reading counts the pairs that begin or
  end with such a word, a second one the longer phrases, which grow only where each
  pair within them is frequent, or not yet counted;
* what survives is scored; where a word that isn't expanded has a bound as high as
  the ``TOP``-th score, ties included, or where there are fewer scores, the next wave
  takes all words up to the count that this score allows. The ``TOP``-th score only
  rises, so the second wave settles every language.

A candidate is dropped where a longer candidate that holds it is as frequent. That is
so exactly where one word stands before, or after, every occurrence in its piece,
which is told while it is counted: no pairs of candidates are compared.

Tasks split texts in numpy and count phrases of a slice by exact word numbers before
anything is shuffled; sums are Spark's. What tasks know of words and pairs are three
bit tables of ``BITS`` bits, whatever the vocabulary: a false hit makes more to count
and changes no result, as counts are kept by the phrases themselves. The candidates of
a language are cut to the first ``TOP`` in each task before they meet.

Defined cases: null and empty texts have no words; a null language is ``und`` and
shares it with rows that say so; repeated rows count each time; very long texts are
one slice of their own; an empty table gives an empty result; ties go by count and
then by the bytes of the phrase; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, by_bytes, level, saved, table

LEAST, TOP, LONGEST = 100, 2000, 5
FIRST_WORDS, FIRST_SHARE = 4000, 0.3
BITS, SLICE_BYTES = 1 << 26, 4 << 20
MASK = np.uint64(BITS - 1)
NO_LIMIT = 1 << 62

KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Tokens:
    """The words of some texts: ``ids`` numbers (language, word), ``piece`` tells whose neighbours stand in one piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        begins = offsets[:-1] - offsets[0]
        begins, doc_of = begins[begins < len(data)], np.flatnonzero(begins < len(data))
        kind = KIND[data]
        inside = kind == 0
        after = np.zeros(len(data), bool)
        after[1:] = inside[:-1]
        after[begins] = False
        start = np.flatnonzero(inside & ~after)
        breaks = (kind == 2).astype(np.int32)
        np.add.at(breaks, begins, 1)
        self.piece = np.cumsum(breaks, dtype=np.int32)[start]
        kept = np.cumsum(inside, dtype=np.int32)
        letters = LOWER[data[inside]]
        ends = np.append(kept[start] - 1, len(letters)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
        langs = pc.fill_null(langs, "und").dictionary_encode()
        # of texts that begin at one place all but the last are empty
        doc = doc_of[np.searchsorted(begins, start, "right") - 1]
        size = max(1, len(found.dictionary))
        key = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] * size + found.indices.to_numpy(zero_copy_only=False)
        if len(langs.dictionary) * size <= 1 << 24:
            there = np.zeros(len(langs.dictionary) * size, bool)
            there[key] = True
            own, self.ids = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
        else:
            own, self.ids = np.unique(key, return_inverse=True)
        self.lang_names, words = langs.dictionary.to_pylist(), found.dictionary.to_pylist()
        self.lang_of, self.words = own // size, [words[i] for i in own % size]
        seeds = [hash_of(x, 42) for x in self.lang_names]
        self.hashes = np.fromiter((hash_of(w, seeds[g]) for w, g in zip(self.words, self.lang_of.tolist(), strict=True)), np.uint64, len(self.words))

    def langs(self, ids: np.ndarray) -> pa.Array:
        return pa.array([self.lang_names[g] for g in self.lang_of[ids].tolist()], pa.string())


def hash_of(text: str, seed: int) -> int:
    """As xxhash64 of Spark SQL, whose seed for a second column is the hash of the first."""
    return xxhash.xxh64_intdigest(text, seed & 0xFFFFFFFFFFFFFFFF)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & MASK
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits that the column h sets: 8 bytes for each 64 bits that have one, BITS / 8 bytes at most."""
    at = hashes.select(F.col("h").bitwiseAND(BITS - 1).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def slices(batches: Iterator[pa.RecordBatch], langs: np.ndarray | None = None) -> Iterator[Tokens]:
    """langs: bits of the languages whose texts are read."""
    for b in by_bytes(batches, most=SLICE_BYTES):
        if langs is not None:
            names = pc.fill_null(b.column("lang"), "und").dictionary_encode()
            asked = has(langs, np.array([hash_of(x, 42) for x in names.dictionary.to_pylist()], np.uint64))
            b = b.filter(pa.array(asked[names.indices.to_numpy(zero_copy_only=False)]))
        if b.num_rows and len((t := Tokens(b.column("text"), b.column("lang"))).ids):
            yield t


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f); a null word has the count of all."""
    for t in slices(batches):
        f = np.bincount(t.ids, minlength=len(t.words))
        total = np.bincount(t.lang_of, weights=f, minlength=len(t.lang_names)).astype(np.int64)
        langs = pa.array([*t.langs(np.arange(len(t.words))).to_pylist(), *t.lang_names], pa.string())
        yield pa.RecordBatch.from_arrays([langs, pa.array([*t.words, *[None] * len(total)], pa.string()), pa.array(np.append(f, total))], ["lang", "word", "f"])


def pair_counter(known, langs, frequent, fresh):
    """Counts of pairs by hash, of a frequent word and a fresh one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, langs.value):
            often, new = has(frequent.value, t.hashes)[t.ids], has(fresh.value, t.hashes)[t.ids]
            at = np.flatnonzero(often[:-1] & often[1:] & (new[:-1] | new[1:]) & (t.piece[:-1] == t.piece[1:]))
            h, c = np.unique(paired(t.hashes[t.ids[at]], t.hashes[t.ids[at + 1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return run


def phrase_counter(known, langs, frequent, fresh):
    """Counts of phrases whose first or last word is fresh and whose pairs are frequent or not counted yet (known: bits of the words expanded so far; of frequent pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expanded, pairs = known.value
        for t in slices(batches, langs.value):
            ids, size = t.ids, len(t.words)
            often, new, old = (has(bits, t.hashes)[ids] for bits in (frequent.value, fresh.value, expanded))
            same = t.piece[:-1] == t.piece[1:]
            grows = often[:-1] & often[1:] & same
            told = np.flatnonzero(grows & (old[:-1] | old[1:]))
            grows[told] = has(pairs, paired(t.hashes[ids[told]], t.hashes[ids[told + 1]]))
            whole = np.ones(len(ids), bool)
            for m in range(2, LONGEST + 1):
                if len(ids) < m:
                    break
                whole = whole[: len(ids) - m + 1] & grows[m - 2 :]
                at = np.flatnonzero(whole & (new[: len(whole)] | new[m - 1 :]))
                if len(at):
                    yield phrases_at(t, same, at, m, size)

    return run


def phrases_at(t: Tokens, same: np.ndarray, at: np.ndarray, m: int, size: int) -> pa.RecordBatch:
    """(lang, phrase, m, f, before, after): the phrases of m words at these places; before and after: the hash of the word next to every one of them, if there is one."""
    group = t.ids[at]
    for j in range(1, m):
        _, first, group = np.unique(group * size + t.ids[at + j], return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    heads = np.searchsorted(group[order], np.arange(len(first)))
    f = np.diff(np.append(heads, len(at)))

    def held(place: np.ndarray, joined: np.ndarray) -> pa.Array:
        word = np.where(joined, t.ids[np.clip(place, 0, len(t.ids) - 1)], -1)[order]
        low = np.minimum.reduceat(word, heads)
        one = (low == np.maximum.reduceat(word, heads)) & (low >= 0)
        return pa.array(t.hashes[np.maximum(low, 0)].view(np.int64), mask=~one)

    before = held(at - 1, (at > 0) & same[np.maximum(at - 1, 0)])
    last = at + m - 1
    after = held(last + 1, (last < len(same)) & same[np.minimum(last, len(same) - 1)])
    rows = np.stack([t.ids[at[first] + j] for j in range(m)], 1).tolist()
    text = pa.array([" ".join([t.words[i] for i in row]) for row in rows], pa.string())
    return pa.RecordBatch.from_arrays([t.langs(t.ids[at[first]]), text, pa.array(np.full(len(first), m, np.int32)), pa.array(f), before, after], ["lang", "phrase", "m", "f", "before", "after"])


def scores(counts: DataFrame, phrases: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer candidate holds, where the count of each part is known. counts: lang, phrase, f."""
    words = F.split("phrase", " ")
    kept = phrases.where((F.col("m") == longest) | ~F.col("held"))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "m", words.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "m", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("cast(cast(1000 * cast(a as decimal(20, 0)) as decimal(22, 0)) * cast(n as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0)))")
    best = parts.select("lang", "phrase", "m", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "phrase", "m", "a", "n").agg(F.min("cut").alias("cut"), F.count("*").alias("cuts")).where(F.col("cuts") == F.col("m") - 1)
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def first_reach(words: DataFrame, totals: DataFrame, least_words: int, share: float) -> DataFrame:
    """lang, reach: the count up to which words are expanded first, from levels of counts."""
    levels = words.groupBy("lang", level("f").alias("level")).agg(F.count("*").alias("w"), F.sum("f").alias("mass"), F.max("f").alias("most"))
    upto = Window.partitionBy("lang").orderBy("level")
    levels = levels.select("lang", "most", F.sum("w").over(upto).alias("w"), F.sum("mass").over(upto).alias("mass")).join(totals, "lang")
    enough = (F.col("w") >= least_words) & (F.col("mass") >= share * F.col("n"))
    return levels.groupBy("lang").agg(F.coalesce(F.min(F.when(enough, F.col("most"))), F.max("most")).alias("reach"))


def mine(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, least_words: int = FIRST_WORDS, share: float = FIRST_SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    bounded_batches(spark)
    sc, texts = spark.sparkContext, docs.select("text", "lang")
    counted = texts.mapInArrow(count_words, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = saved(spark, counted.where((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    words = counted.where("word is not null").withColumn("h", F.xxhash64("lang", "word"))
    reach = saved(spark, first_reach(words, totals, least_words, share), "reach").withColumn("before", F.lit(0))
    pairs = phrases = None
    while True:
        fresh = words.join(reach, "lang").where("f <= reach")
        langs, frequent, new = (sc.broadcast(bit_table(x)) for x in (reach.where("reach > before").select(F.xxhash64("lang").alias("h")), words, fresh.where("f > before")))
        found = texts.mapInArrow(pair_counter(None, langs, frequent, new), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        found = saved(spark, found, "pairs")
        pairs = found if pairs is None else pairs.union(found)
        known = sc.broadcast((bit_table(fresh), bit_table(pairs)))
        kinds = "lang string, phrase string, m int, f bigint, before bigint, after bigint"
        grown = texts.mapInArrow(phrase_counter(known, langs, frequent, new), kinds).where(F.col("m") <= longest)
        one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
        grown = grown.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f"), F.coalesce(one("before") | one("after"), F.lit(False)).alias("held")).where(F.col("f") >= least)
        grown = saved(spark, grown, "phrases")
        phrases = grown if phrases is None else phrases.union(grown).dropDuplicates(["lang", "phrase"])
        counts = words.select("lang", F.col("word").alias("phrase"), "f").union(phrases.select("lang", "phrase", "f"))
        best = saved(spark, ranked(scores(counts, phrases, totals, longest), top), "best")
        last = best.where(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        need = totals.join(last, "lang", "left").select("lang", F.expr(f"case when last is null then {NO_LIMIT} when last = 0 then {NO_LIMIT} else 1000 * n div last end").alias("need"))
        open_words = words.join(reach, "lang").join(need, "lang").where("f > reach and f <= need")
        more = saved(spark, open_words.groupBy("lang").agg(F.max("f").alias("more")), "open")
        for b in (langs, frequent, new, known):
            b.unpersist()
        if more.isEmpty():
            break
        reach = saved(spark, reach.join(more, "lang", "left").select("lang", F.coalesce("more", "reach").alias("reach"), F.col("reach").alias("before")), "reach")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark, table(spark, sf_dir, "documents", "text", "lang"))


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, {LONGEST + 1}) AS x(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.lang = c.lang AND b.m > c.m AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
k AS (SELECT lang, phrase, a, ws, m, unnest(range(1, m)) AS k FROM s),
q AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * k.a * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k.k + 1:k.m], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {TOP}
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": ORACLE}
