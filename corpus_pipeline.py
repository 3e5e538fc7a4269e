"""A corpus pipeline over documents: clean, identify, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; the last returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, jaccard, langid, mixing, toxicity
from ledgerloom.llm.common import saved, table

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("language_id", langid.keep_identified),
    ("near_duplicates", jaccard.keep_one),
    ("mixing", mixing.sample_to_targets),
    ("byte_bpe", bpe.encode_texts),
]
#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), name)
    return docs
