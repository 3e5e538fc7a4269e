"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in ``2**BITS`` places, of its words
(runs of letters and digits, lower case), its pairs of neighbours and its pairs
with one word between. Training is FTRL-proximal with a rate for each coordinate
and L1: coordinates whose evidence stays under the L1 weight are exactly zero, so
the weights are a short sparse vector, which is broadcast (at most 2**BITS of
them). A row of the smaller class counts for as many as the larger class has of
them, up to ``MAX_CLASS_WEIGHT``; L1 is in the same units, so that what a row or
two hold stays out of the model. The score is the logistic function of the sum of weights over the distinct
features of the whole text; the text's length enters nowhere else.

Learning reads a bounded, documented sample of labelled rows: about
``MAX_TRAIN`` of them, chosen by a hash of doc_id, each class in its own share: half
of them, and more where the other class has fewer.
Features are hashed by all executors; the sequential passes run in one task over
the sample's hashes. Documents that share an id each take that id's labels; an id
with several labels is toxic if any of them says so.

Defined cases: null and empty texts have no features and score the bias alone;
with no labelled row every score is 0.5; null labels are not learnt from; repeated
rows stay repeated, and rows that share an id keep their own scores; very long texts
are read whole, a few at a time; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import STAGE_BYTES, bounded_batches, by_bytes, forgetful, give_back, id_remainder, picked, table

BITS = 20
#: Rows that training reads, about.
MAX_TRAIN = 10_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 1.0, 1.0, 30.0, 0.1
#: Most that a row of the smaller class counts for.
MAX_CLASS_WEIGHT = 10.0
THRESHOLD = 0.7
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words whose hashes a task keeps; the cache starts anew when it is full.
CACHE = 1 << 19
_hashes: dict[bytes, int] = {}


def forget_hashes() -> None:
    _hashes.clear()


def features(text: str | None) -> np.ndarray:
    """The sorted distinct feature numbers of a text."""
    words = WORD.findall(text.lower().encode()) if text else []
    if not words:
        return np.zeros(0, np.uint32)
    if len(_hashes) > CACHE:
        _hashes.clear()
    get, w = _hashes.get, np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        if (h := get(word)) is None:
            h = _hashes[word] = xxhash.xxh3_64_intdigest(word)
        w[i] = h
    with np.errstate(over="ignore"):
        odd = w * np.uint64(0x9E3779B97F4A7C15)
        pairs = odd[:-1] ^ (w[1:] + np.uint64(1))
        skips = odd[:-2] ^ (w[2:] * np.uint64(3) + np.uint64(2))
        every = np.concatenate([w, pairs, skips])
        every = (every ^ (every >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.uint32))


class Ftrl:
    """FTRL-proximal: z and n for each coordinate; the bias is a coordinate of its own without L1."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        rest = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -rest / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA)

    def learn(self, i: np.ndarray, label: int, counts_for: float = 1.0) -> None:
        w, b = self.weights(i), self.bias()
        g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label) * counts_for
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - step * w
        self.n[i] += g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n += g * g


MODEL = "feature int, weight double"


def most_of(label: int, counts: dict[int, int], max_train: int) -> int:
    """How many rows of a class are learnt from: half of max_train, and what the other class leaves of its own."""
    return max_train - min(counts.get(1 - label, 0), max_train // 2)


def train(spark: SparkSession, labelled: DataFrame, epochs: int = EPOCHS, max_train: int = MAX_TRAIN, texts: DataFrame | None = None) -> dict[int, float]:
    """Weights by feature number, and the bias at -1, from the columns doc_id, text and label (0 or 1).

    Where texts (doc_id, text) are given, text is read from them: only the sample, about
    max_train rows of ids, is sent to them, so that no text is shuffled.
    """
    bounded_batches(spark)
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return {-1: 0.0}
    h = F.xxhash64("doc_id", F.lit("ftrl"))
    sample = labelled.where(F.when(F.col("label") == 1, picked(h, most_of(1, counts, max_train), counts.get(1, 0))).otherwise(picked(h, most_of(0, counts, max_train), counts.get(0, 0))))
    if texts is not None:
        sample = texts.join(F.broadcast(sample.select("doc_id", "label").distinct()), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            found = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(found, pa.binary())], ["h", "label", "found"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Ftrl()
        rows = [(h, int(y), bytes(f)) for b in batches for h, y, f in zip(b["h"], b["label"], b["found"])]
        rows.sort()
        toxic = sum(y for _, y, _ in rows)
        share = [min(MAX_CLASS_WEIGHT, max(1.0, (len(rows) - n) / max(n, 1))) for n in (len(rows) - toxic, toxic)]
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(np.frombuffer(rows[k][2], np.uint32), rows[k][1], share[rows[k][1]])
        i = np.flatnonzero(np.abs(model.z) > L1)
        yield pd.DataFrame({"feature": np.append(i, -1).astype(np.int32), "weight": np.append(model.weights(i), model.bias())})
        del rows, model
        give_back()

    shorts = sample.select(h.alias("h"), "label", "text").mapInArrow(forgetful(hashed, forget_hashes), "h bigint, label int, found binary")
    return {r.feature: r.weight for r in shorts.repartition(1).mapInPandas(fit, MODEL).collect()}


def score(spark: SparkSession, docs: DataFrame, model: dict[int, float], keep: list[str]) -> DataFrame:
    """keep (columns of docs), with score (0 to 1) and predicted (1 from THRESHOLD on) of the column text."""
    bounded_batches(spark)
    # arrays: as a dict, a worker would hold some ten times the bytes until its next task
    places = np.array([i for i in model if i >= 0], np.int32)
    shared = spark.sparkContext.broadcast((places, np.array([model[i] for i in places.tolist()], np.float64), model[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        at, values, bias = shared.value
        weights[at] = values
        for b in by_bytes(batches):
            sums = np.array([bias + weights[features(t)].sum() for t in b.column("text").to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType().add("score", "double").add("predicted", "integer")])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(forgetful(run, forget_hashes), schema)


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learnt from."""
    may = id_remainder("doc_id", 3) != 1
    y = labels.where(may & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return docs.select("doc_id", "text").where(may).join(y, "doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(spark, learning_rows(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")), texts=docs.select("doc_id", "text"))
    return score(spark, docs, model, ["doc_id"]).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go."""
    bounded_batches(spark, STAGE_BYTES)
    model = train(spark, learning_rows(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")), texts=docs.select("doc_id", "text"))
    return score(spark, docs.select(F.struct("*").alias("doc"), "text"), model, ["doc"]).where("predicted = 0").select("doc.*")


QUERIES = {"op1_toxicity": op1_toxicity}
