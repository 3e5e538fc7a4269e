"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is the sequence of its words (A-Z in lower case, cut at ASCII white space)
with one 0x20 between them, and an end, the byte 0x0A. A byte's context is the
``depth`` bytes before it, across words, newest first; before a text's first byte
stand bytes 0x0A. Each byte is eight binary decisions, and each decision has its
own context tree over the bits read so far: every node weighs the
Krichevsky-Trofimov estimate of its own counts against the product of its
children, so that the estimates of all depths mix by how well they explain the
training bytes. The model is then fixed, and a text's score is the sum of log10 of
the mixed probabilities of its bits; ``bits_per_byte`` is its code length.

A gram is a context and the byte after it. All grams of all texts are counted, by
each task and then by Spark, those of texts that are not learnt from with 0: a node
without counts mixes to even odds and leaves its parents as they are, so every gram
that is asked for gets its probability where the trees are grown, and no unseen one
is left to look up. What the model holds grows with the corpus and the depth is
fixed: the trees below each two newest bytes are grown apart, by tasks, and stay a
table of grams; only the counts of the 65,280 nodes of depth 1 that there can be are
gathered. Nothing else is broadcast whole: the most frequent grams and words are
(``HOT_GRAMS`` and ``HOT_WORDS`` at most), and the rarer ones of each document are
joined to the tables by number.

Defined cases: null counts as the empty text, which has only an end; a byte that
no context has seen is even odds on each bit; without training rows the base has
N = V = 0 and counts of 0, and all bits are even; repeated rows stay repeated
(rows with the same doc_id and text share one result), and rows that share an id
but not a text have their own; very long texts are read whole, in windows of
``WINDOW`` bytes; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, by_bytes, forget, frequent, id_remainder, level, saved, table

DEPTH, HOT_WORDS, HOT_GRAMS = 5, 1 << 16, 1 << 20
#: Grams that a task grows trees from at a time; more where two newest bytes have more.
GROW_GRAMS = 50_000
#: Distinct words, and grams, that a task counts before it passes them on.
FLUSH_WORDS, FLUSH_GRAMS = 300_000, 1 << 20
#: Bytes whose grams a task holds at a time.
WINDOW = 1 << 19
END = 0x0A
#: What a row of a document's is about: itself, a rare word or a rare gram.
OWN, WORD, GRAM = 0, 1, 2
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams_of(texts: list[list[bytes]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, the text of each) of all bytes of some texts, given as words, by the window. A key is the context, oldest byte first, shifted by one byte, and the byte."""
    before = b"\n" * depth
    sizes = np.fromiter((depth + 1 + sum(map(len, w)) + max(0, len(w) - 1) for w in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(part for w in texts for part in (before, b" ".join(w), b"\n")), np.uint8)
    begins = np.cumsum(sizes) - sizes
    for at in range(0, len(data), WINDOW):
        low = max(0, at - depth)
        part = data[low : at + WINDOW].astype(U)
        key = part.copy()
        for d in range(1, depth + 1):
            key[d:] |= part[:-d] << U(8 * d)
        key = key[at - low :]
        place = np.searchsorted(begins, np.arange(at, at + len(key)), "right") - 1
        inside = np.arange(at, at + len(key)) - begins[place] >= depth
        yield key[inside], place[inside]


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def log_rise(n: np.ndarray) -> np.ndarray:  # log gamma(n + 1/2), Stirling from 8 on
        x = n + 0.5
        out = np.zeros(len(x))
        for _ in range(8):
            low = x < 8
            if not low.any():
                break
            out[low] -= np.log(x[low])
            x = np.where(low, x + 1, x)
        return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)

    n = a + b
    whole = log_rise(n + 0.5)  # log gamma(n + 1)
    return log_rise(a) + log_rise(b) - np.log(np.pi) - whole


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 1) -> dict:
    """The trees from depth ``top`` on, for all grams that share some contexts of that depth.

    Returned: the sorted ``keys`` and their ``counts``; ``bits``, for each key and bit the probability of the bit that it holds, as
    from depth top on; and for the ``nodes`` of depth top (context << 8 | the bits so far, with a leading one) their counts and log
    weight (``zeros``, ``ones``, ``weight``).
    """
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.float64)
    byte = keys & U(255)
    bit = np.concatenate([(byte >> U(7 - k)) & U(1) for k in range(8)])
    so_far = np.concatenate([U(1 << k) | byte >> U(8 - k) for k in range(8)])
    nodes, ones, totals, wheres = [], [], [], []
    for d in range(top, depth + 1):
        context = (keys >> U(8)) & U((1 << 8 * d) - 1)
        found, where = np.unique(np.tile(context << U(8), 8) | so_far, return_inverse=True)
        nodes.append(found), wheres.append(where)
        totals.append(np.bincount(where, np.tile(counts, 8), len(found)))
        ones.append(np.bincount(where, np.tile(counts, 8) * bit, len(found)))
    levels = depth + 1 - top
    parents = [None] + [np.searchsorted(nodes[i - 1], ((nodes[i] >> U(8)) & U((1 << 8 * (top + i - 1)) - 1)) << U(8) | nodes[i] & U(255)) for i in range(1, levels)]
    share, below = [None] * levels, None  # share: how much of a node's weight is its own estimate
    for i in range(levels - 1, -1, -1):
        own = _log_kt(totals[i] - ones[i], ones[i])
        if i == levels - 1:
            share[i], below = np.ones(len(own)), own
        else:
            both = np.logaddexp(own, np.bincount(parents[i + 1], below, len(own))) - np.log(2)
            share[i], below = np.exp(np.minimum(0.0, own - np.log(2) - both)), both
    spent, left = np.zeros(len(nodes[0])), np.ones(len(nodes[0]))
    for i in range(levels):
        if i:
            spent, left = spent[parents[i]], left[parents[i]]
        spent = spent + left * share[i] * (ones[i] + 0.5) / (totals[i] + 1)
        left = left * (1 - share[i])
    one = spent[wheres[-1]]
    bits = np.where(bit == 1, one, 1 - one).reshape(8, -1).T
    return {"keys": keys, "counts": counts, "bits": bits, "nodes": nodes[0], "zeros": totals[0] - ones[0], "ones": ones[0], "weight": below}


class Upper:
    """The root and the nodes of depth 1 (newest byte << 8 | the bits so far), from the counts of these and the weights below them."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, inside: np.ndarray):
        own = _log_kt(zeros, ones)
        both = np.logaddexp(own, inside) - np.log(2)
        share = np.exp(np.minimum(0.0, own - np.log(2) - both))
        bits = nodes & 255
        a, b, weights = (np.bincount(bits, x, 256) for x in (zeros, ones, both))
        root_own = _log_kt(a, b)
        root_share = np.exp(np.minimum(0.0, root_own - np.logaddexp(root_own, weights)))
        root_one, one, keep = ((b + 0.5) / (a + b + 1))[bits], (ones + 0.5) / (zeros + ones + 1), 1 - root_share[bits]
        # the probability of a bit is what both depths hold of it, and a part of what comes from below
        self.holds, self.passes = np.zeros((2, 1 << 16)), np.zeros(1 << 16)
        self.holds[1, nodes] = root_share[bits] * root_one + keep * share * one
        self.holds[0, nodes] = root_share[bits] * (1 - root_one) + keep * share * (1 - one)
        self.passes[nodes] = keep * (1 - share)

    def logs(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 probability of each gram, given those of its bits from below."""
        out, byte, newest = np.zeros(len(keys)), (keys & U(255)).astype(np.int64), ((keys >> U(8)) & U(255)).astype(np.int64)
        for k in range(8):
            node = newest << 8 | 1 << k | byte >> (8 - k)
            out += np.log10(self.holds[(byte >> (7 - k)) & 1, node] + self.passes[node] * below[:, k])
        return out


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in the column text; b"\\n" is the end, once for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

        held: Counter = Counter()
        for b in by_bytes(batches):
            for text in b.column("text").to_pylist():
                held.update(words_of(text))
                held[b"\n"] += 1
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return training.select("text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n): how often each gram of docs (text, learned) occurs in rows that are learnt from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in by_bytes(batches):
            learned = b.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            for keys, place in grams_of([words_of(t) for t in b.column("text").to_pylist()], depth):
                for some, zero in ((keys[learned[place]], 1), (keys[~learned[place]], 0)):
                    if len(some):
                        found, n = np.unique(some, return_counts=True)
                        held.append((found, n * zero))
                        size += len(found)
                if size > FLUSH_GRAMS:
                    held = [_summed(held)]
                    if (size := len(held[0][0])) > FLUSH_GRAMS // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*_summed(held))

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return docs.select("text", "learned").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


SUBTREE = {"keys": U, "counts": np.float64, "bits": np.float64, "nodes": np.int64, "zeros": np.float64, "ones": np.float64, "weight": np.float64}


def train(spark: SparkSession, grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, log): the log10 probability of each gram of grams (gram, n) under the trees that the counts n make."""
    if depth < 2:
        raise ValueError("depth must be 2 at least")
    bounded_batches(spark)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            t = subtree(keys, n, depth, 2)
            t["nodes"] = t["nodes"] & U(0xFFFF)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(t[x]).tobytes()], pa.binary()) for x in SUBTREE], list(SUBTREE))

        keys, n = np.zeros(0, U), np.zeros(0, np.int64)
        for b in batches:
            keys, n = np.append(keys, b.column("gram").to_numpy().view(U)), np.append(n, b.column("n").to_numpy())
            two = (keys >> U(8)) & U(0xFFFF)
            if len(keys) >= GROW_GRAMS and (cut := int(np.searchsorted(two, two[-1]))):
                yield tree(keys[:cut], n[:cut])
                keys, n = keys[cut:], n[cut:]
        if len(keys):
            yield tree(keys, n)

    dealt = grams.withColumn("two", F.shiftright("gram", 8).bitwiseAND(0xFFFF)).repartition("two").sortWithinPartitions("two")
    trees = saved(spark, dealt.select("gram", "n").mapInArrow(grow, ", ".join(f"{x} binary" for x in SUBTREE)), "subtrees")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found, where = np.unique(np.frombuffer(r["nodes"], np.int64), return_inverse=True)
                sums = (np.bincount(where, np.frombuffer(r[x], np.float64), len(found)) for x in ("zeros", "ones", "weight"))
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], ["node", "zeros", "ones", "weight"])

    tops_of = trees.select("nodes", "zeros", "ones", "weight").mapInArrow(tops, "node bigint, zeros double, ones double, weight double")
    rows = tops_of.groupBy("node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "weight"))).collect()  # 65,280 at most
    upper = Upper(np.array([r.node for r in rows], np.int64), *(np.array([r[x] for r in rows], np.float64) for x in ("zeros", "ones", "weight")))
    shared = spark.sparkContext.broadcast(upper)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, n = np.frombuffer(r["keys"], U), np.frombuffer(r["counts"], np.float64)
                logs = shared.value.logs(keys, np.frombuffer(r["bits"], np.float64).reshape(-1, 8))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(logs)], ["gram", "n", "log"])

    out = saved(spark, trees.select("keys", "counts", "bits").mapInArrow(finish, "gram bigint, n bigint, log double"), "logs")
    forget(spark, trees)
    return out


class Hot:
    """Frequent grams by hash: those of a bucket stand side by side, so that a look-up touches about two places rather than one for each halving of a sorted list."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.bits = max(1, 2 * len(keys)).bit_length()
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.logs = keys[order], logs[order]
        self.starts = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        bucket = self._bucket(keys)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.keys[at] == keys[left]
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def score(spark: SparkSession, docs: DataFrame, learned: Column, depth: int = DEPTH) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each row's text; learned: which rows to learn from."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    vocab = saved(spark, vocabulary(docs.where("learned")), "vocabulary")
    counted = saved(spark, gram_counts(docs, depth), "grams")
    logs = train(spark, counted, depth)
    forget(spark, counted)
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n, total.v
    below = n + 0.1 * (v + 1)

    word_level, gram_level = frequent(vocab, "c", HOT_WORDS), frequent(logs, "n", HOT_GRAMS)
    hot_words = {bytes(r.word): r.c for r in vocab.where(level("c") >= word_level).collect()}  # HOT_WORDS at most
    hot = logs.where(level("n") >= gram_level).select("gram", "log").toArrow()  # HOT_GRAMS at most
    found = Hot(hot.column("gram").to_numpy().view(U), hot.column("log").to_numpy())
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(hot_words)}, np.log10((np.array(list(hot_words.values()), np.float64) + 0.1) / below), found))
    fields = [("doc_id", pa.int64()), ("h", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    schema = "doc_id bigint, h bigint, kind int, id bigint, tf bigint, n_tokens bigint, n_known bigint, n_bytes bigint, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bases, found = shared.value
        for b in by_bytes(batches):
            k = b.num_rows
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            score, n_bytes, rare = np.zeros(k), np.zeros(k, np.int64), []
            for key, place in grams_of(texts, depth):
                n_bytes += np.bincount(place, minlength=k)
                at = found.find(key)
                met = at >= 0
                score += np.bincount(place[met], found.logs[at[met]], k)
                place, key = place[~met], key[~met]
                order = np.lexsort((key, place))
                place, key = place[order], key[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))) if len(key) else np.zeros(0, np.int64)
                rare.append((place[first], np.full(len(first), GRAM, np.int32), key[first].view(np.int64), np.diff(np.append(first, len(key)))))
            for w in texts:
                w.append(b"\n")
            sizes = np.fromiter(map(len, texts), np.int64, k)
            words = list(itertools.chain.from_iterable(texts))
            at = np.fromiter(map(index.get, words, itertools.repeat(-1)), np.int64, len(words))
            place, met = np.repeat(np.arange(k), sizes), at >= 0
            known, base = np.bincount(place[met], minlength=k), np.bincount(place[met], bases[at[met]] if len(bases) else None, k)
            others = Counter(zip(place[~met].tolist(), [words[i] for i in np.flatnonzero(~met)]))
            hashes = [_signed(xxhash.xxh3_64_intdigest(w)) for _, w in others]
            rare.append((np.fromiter((d for d, _ in others), np.int64, len(others)), np.full(len(others), WORD, np.int32), np.array(hashes, np.int64), np.fromiter(others.values(), np.int64, len(others))))
            rows, kind, ids, tf = (np.concatenate(x) for x in zip(*rare))
            doc, h, none = b.column("doc_id"), b.column("h"), np.zeros(len(rows), np.int64)
            cols = [
                *(pa.concat_arrays([c, c.take(pa.array(rows))]) for c in (doc, h)),
                np.append(np.full(k, OWN, np.int32), kind), np.append(h.to_numpy(), ids), np.append(np.zeros(k, np.int64), tf),
                *(np.append(x, none) for x in (sizes, known, n_bytes, base, score)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_signed(xxhash.xxh3_64_intdigest(w)) for w in b.column("word").to_pylist()], pa.int64()), b.column("c")], ["id", "c"])

    # a document's own row has its own number and meets nothing
    rare_words = vocab.where(level("c") < word_level).mapInArrow(hashed, "id bigint, c bigint").select(F.lit(WORD).alias("kind"), "id", F.col("c").cast("double").alias("value"))
    rare_grams = logs.where((F.col("n") == 0) | (level("n") < gram_level)).select(F.lit(GRAM).alias("kind"), F.col("gram").alias("id"), F.col("log").alias("value"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)
    met = rows.join(rare_words.unionByName(rare_grams), ["kind", "id"], "left")
    tf, c, is_word, is_gram = F.col("tf"), F.coalesce("value", F.lit(0.0)), F.col("kind") == WORD, F.col("kind") == GRAM
    met = met.select(
        "doc_id", "h", "n_tokens", "n_bytes", (F.col("n_known") + F.when(is_word & (c > 0), tf).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(is_word, tf * F.log10((c + 0.1) / F.lit(below))).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(is_gram, tf * c).otherwise(0.0)).alias("score"), (F.col("kind") == OWN).cast("bigint").alias("own"),
    )
    sums = met.groupBy("doc_id", "h").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_bytes", "n_known", "base", "score", "own")))
    each = lambda x: F.col(x) / F.col("own")
    whole = lambda x: each(x).cast("bigint").alias(x)
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "own"))).select(
        "doc_id", whole("n_tokens"), whole("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"),
        whole("n_bytes"), (-each("score") * F.lit(float(np.log2(10))) / each("n_bytes")).alias("bits_per_byte"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(spark, docs, id_remainder("doc_id", 10) != 0)
    return out.select("doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
