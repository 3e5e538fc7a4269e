"""Records in and out: JSON lines with defaults and rejection, and the portable index of what stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["decision", "invariant", "correction", "dead_end", "episode", "observation"]
TRUST = {"user_said": 3, "review_accepted": 3, "commit_linked": 2, "tool_observed": 1}
SCHEMA = "id bigint, kind string, subject string, relation string, object string, body string, origin string, created_at bigint, invalid int, invalidated_by bigint"


def trust_of(origin):
    out = F.lit(0)
    for name, level in TRUST.items():
        out = F.when(origin == name, level).otherwise(out)
    return out


def dedup_of(*parts: str):
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p), F.lit("")) for p in parts)).cast("binary"), 256)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Valid records of JSON lines: defaults filled in, unknown kinds and dates rejected, the first of each hash kept."""
    raw = spark.read.schema(SCHEMA).json(path)
    filled = raw.withColumn("kind", F.coalesce("kind", F.lit("episode"))).withColumn("origin", F.coalesce("origin", F.lit("imported"))).withColumn("invalid", F.coalesce("invalid", F.lit(0)))
    good = filled.where(F.col("kind").isin(KINDS) & F.col("body").isNotNull() & (F.length("body") <= 2000) & F.col("created_at").between(946_684_800_000, 4_102_444_800_000))
    marked = good.withColumn("trust", trust_of(F.col("origin"))).withColumn("dedup", dedup_of("kind", "subject", "relation", "object", "body"))
    first = marked.groupBy("dedup").agg(F.min_by(F.struct(*marked.columns), "id").alias("r"))
    return first.select("r.*")


def write_jsonl(records: DataFrame, path: str, every: bool = False) -> None:
    (records if every else records.where("invalid = 0")).write.json(path)
