"""Language identification by compression: the language whose dictionary packs the text smallest.

For each language seen in the labelled rows, a raw-content zstandard dictionary
is made of passages of its labelled texts. A text is reduced to its words of
letters in lower case (a word repeated at once counts once) and cut into blocks
of ``BLOCK`` bytes; every block of the whole text is compressed with every
dictionary, and the language with the smallest total wins (ties: the one with
more labelled rows, then the first by name). ``margin`` is how much larger the
second smallest is, as a share; ``score`` is the winner's softmax share of the
totals per kilobyte of text, and ``rejected`` marks texts without letters and
those whose margin is narrower than ``min_margin``. Texts of fewer than
``MIN_BYTES`` bytes of letters are too short for a margin to mean anything: they
are not rejected for one.

Learning reads a bounded, documented sample: at most ``PASSAGES`` passages of
``PASSAGE_CHARS`` characters for each language, one for each value of a hash of
the doc_id, taken from a place in the text that the hash names. It is one
aggregation with map-side combining, whatever the share of a language. The
dictionaries are broadcast: PASSAGES * PASSAGE_CHARS characters for a language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; rows with a null language are not learnt from; with no labelled row at
all every text is ``und``; repeated rows stay repeated; a language whose sampled
passages are empty is not learnt.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import STAGE_BYTES, bounded_batches, by_bytes, forgetful, id_remainder, table

PASSAGES, PASSAGE_CHARS = 64, 2048
BLOCK, LEVEL = 1024, 6
#: A text whose second best language is less than this share larger is rejected.
MIN_MARGIN = 0.002
MIN_BYTES = 64
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str) -> str:
    """The words of letters of a text, in lower case, without immediate repetitions."""
    return " ".join(w for w, _ in itertools.groupby(NO_LETTERS.sub(" ", text.lower()).split()))


def dictionaries(labelled: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> list[tuple[str, bytes]]:
    """(language, raw content of its dictionary) from doc_id, text and lang; languages with more labelled rows first."""
    h = F.xxhash64("doc_id", F.lit("langid"))
    begin = F.pmod(h, F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    rows = labelled.where("lang is not null and text is not null and text != ''").select(
        "lang", F.pmod(F.shiftrightunsigned(h, 7), F.lit(passages)).alias("slot"), F.struct(h.alias("h"), F.substring("text", begin, F.lit(chars)).alias("passage")).alias("p")
    )
    best = rows.groupBy("lang", "slot").agg(F.min("p").alias("p"), F.count("*").alias("n"))
    found: dict[str, list] = {}
    for r in best.select("lang", "slot", "p.passage", "n").collect():
        found.setdefault(r.lang, []).append((r.slot, words_of(r.passage), r.n))
    order = sorted(found, key=lambda lang: (-sum(n for *_, n in found[lang]), lang))
    return [(lang, raw) for lang in order if (raw := " ".join(p for _, p, _ in sorted(found[lang])).strip().encode())]


class Judge:
    """Compresses with every language's dictionary."""

    def __init__(self, dicts: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in dicts]
        self.packers = []
        for _, content in dicts:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> np.ndarray:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return np.array([sum(len(p.compress(b)) for b in blocks) for p in self.packers], np.float64)

    def judge(self, text: str | None, min_margin: float) -> tuple[str, float, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        raw = words_of(text).encode()
        sizes = self.sizes(raw)
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        margin = float(others.min() / sizes[best] - 1) if len(others) else 1.0
        score = float(1 / np.exp((sizes[best] - sizes) * 100 / len(raw)).sum())
        return self.langs[best], score, margin, margin < min_margin and len(raw) >= MIN_BYTES


COLUMNS = T.StructType().add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")


def predict(spark: SparkSession, docs: DataFrame, dicts: list[tuple[str, bytes]], keep: list[str], min_margin: float = MIN_MARGIN) -> DataFrame:
    """keep (columns of docs), with lang_pred, score, margin and rejected of the column text."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in by_bytes(batches):
            found = [judge.judge(t, min_margin) for t in b.column("text").to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, "lang_pred", "score", "margin", "rejected"])

    schema = T.StructType([*(docs.schema[c] for c in keep), *COLUMNS])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(forgetful(run), schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.select("doc_id", "text", "lang").where(id_remainder("doc_id", 5) != 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = predict(spark, docs, dictionaries(learning_rows(docs)), ["doc_id"])
    return out.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go."""
    bounded_batches(spark, STAGE_BYTES)
    rows = docs.select(F.struct("*").alias("doc"), "text")
    return predict(spark, rows, dictionaries(learning_rows(docs)), ["doc"]).where("not rejected").select("doc.*")


QUERIES = {"op4_language_id": op4_language_id}
