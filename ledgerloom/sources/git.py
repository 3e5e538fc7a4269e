"""Source history as text: commit logs and zero-context diffs, cut into rows by the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"


def commits(log: DataFrame) -> DataFrame:
    """(hash, at, subject, files, anchor) from a column ``value`` that holds records of hash, epoch seconds, subject and file lines."""
    one = log.select(F.explode(F.split("value", RECORD)).alias("r")).where(F.trim("r") != "")
    f = F.split("r", FIELD)
    files = F.filter(F.split(F.trim(F.element_at(f, 4)), "\n"), lambda x: x != "")
    out = one.select(F.trim(f[0]).alias("hash"), (f[1].cast("bigint") * 1000).alias("at"), f[2].alias("subject"), F.coalesce(files, F.array().cast("array<string>")).alias("files"))
    return out.withColumn("anchor", F.when(F.size("files") == 1, F.col("files")[0]))


def hunks(diff: DataFrame) -> DataFrame:
    """(hash, file, hunk, removed, added) from columns hash, ord and line of a diff without context."""
    order = Window.partitionBy("hash").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    seen = diff.select(
        "*", F.last(F.when(line.startswith("--- "), F.substring(line, 7, 4096)), ignorenulls=True).over(order).alias("old"),
        F.last(F.when(line.startswith("+++ "), F.when(line == "+++ /dev/null", F.lit("")).otherwise(F.substring(line, 7, 4096))), ignorenulls=True).over(order).alias("new"),
        F.sum(F.when(line.startswith("@@"), 1).otherwise(0)).over(order).alias("hunk"),
    )
    body = seen.where((line.startswith("-") & ~line.startswith("--- ")) | (line.startswith("+") & ~line.startswith("+++ ")))
    lines = lambda sign: F.transform(F.array_sort(F.collect_list(F.when(line.startswith(sign), F.struct("ord", F.substring(line, 2, 100_000).alias("t"))))), lambda x: x["t"])
    # a deleted file removes nothing that could be replaced
    removed = F.when(F.max("new") == "", F.array().cast("array<string>")).otherwise(lines("-"))
    return body.groupBy("hash", "hunk").agg(F.max(F.coalesce(F.when(F.col("new") != "", F.col("new")), F.col("old"))).alias("file"), removed.alias("removed"), lines("+").alias("added"))


def swaps(found: DataFrame) -> DataFrame:
    """Hunks that replace one line by one line."""
    return found.where("size(removed) = 1 AND size(added) = 1").select("hash", "hunk", "file", F.col("removed")[0].alias("was"), F.col("added")[0].alias("now"))


def code_tokens(text):
    """Lower-case tokens of three characters or more with a letter, and the parts of joined names."""
    whole = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}._/-]+"), lambda t: t != "")
    parts = F.flatten(F.transform(whole, lambda t: F.split(t, "[._/-]+")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(whole, parts), lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}"))))
