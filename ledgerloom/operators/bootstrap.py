"""Stratified bootstrap: an interval for a difference between two arms, by seeded weights instead of drawn rows.

In resample b a row counts as often as a Poisson variable of mean 1 says, which a hash
of seed, b and the row's id names: that is how often drawing n of n rows takes it, for
large n, and it needs no number of rows, no order and no random state, so that a lost
task gives the same weights again. Rows make RESAMPLES small products within their
task, which sums them by stratum and arm before anything is shuffled. An arm's mean is
that of its strata, each weighted by its share of all rows; the interval's ends are
the values at their nearest rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import table

RESAMPLES, SEED, LEVEL = 100, "s1", 0.95
#: P(X <= k) of a Poisson variable of mean 1, as 32-bit bounds.
BOUNDS = [math.floor((1 << 32) * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def weight(row: Column, b: Column, seed: str = SEED) -> Column:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), b.cast("string"), row.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return sum(((h >= bound).cast("int") for bound in BOUNDS), F.lit(0))


def bootstrap(rows: DataFrame, resamples: int = RESAMPLES, level: float = LEVEL, seed: str = SEED) -> DataFrame:
    """(difference, low, high, resamples) from rows id, stratum, arm (boolean), value: the mean where arm is true less the mean where it isn't; resample 0 is the rows as they are. Resamples in which an arm has no row of a stratum count the strata that both have."""
    many = rows.select("stratum", "arm", "value", F.explode(F.sequence(F.lit(0), F.lit(resamples))).alias("b"), "id")
    many = many.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(weight(F.col("id"), F.col("b"), seed)))
    sums = many.groupBy("b", "stratum", "arm").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("value")).alias("x"))
    arm = lambda c, yes: F.sum(F.when(F.col("arm") == yes, F.col(c)))
    strata = sums.groupBy("b", "stratum").agg(*(arm(c, yes).alias(f"{c}{int(yes)}") for c in "nx" for yes in (True, False))).where("n1 > 0 and n0 > 0")
    n = F.col("n1") + F.col("n0")
    each = strata.groupBy("b").agg(F.round(F.sum(n * (F.col("x1") / F.col("n1") - F.col("x0") / F.col("n0"))) / F.sum(n), 9).alias("d"))
    ranked = each.where("b > 0").withColumn("k", F.row_number().over(Window.orderBy("d", "b"))).withColumn("m", F.count("*").over(Window.partitionBy()))  # RESAMPLES rows
    tail = (1 - level) / 2
    at = lambda q: F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.ceil(F.round(F.col("m") * q, 9))), F.col("d")))
    ends = ranked.agg(at(tail).alias("low"), at(1 - tail).alias("high"), F.count("*").alias("resamples"))
    return each.where("b = 0").select(F.col("d").alias("difference")).join(ends)  # one row each


def e3_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are short documents of better quality? By language, with the labels."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"), (F.col("n_chars") < 1500).alias("arm"))
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("value"))
    return bootstrap(docs.join(labels, "id"))


QUERIES = {"e3_bootstrap": e3_bootstrap}
ORACLES = {
    "e3_bootstrap": f"""WITH r AS (SELECT doc_id AS id, lang AS stratum, n_chars < 1500 AS arm, q AS value FROM documents JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id)),
h AS (SELECT r.*, b, CAST('0x' || substr(md5('{SEED}:' || b || ':' || id), 1, 8) AS BIGINT) AS u FROM r, range({RESAMPLES + 1}) AS x(b)),
w AS (SELECT *, CASE WHEN b = 0 THEN 1 ELSE len(list_filter([{', '.join(map(str, BOUNDS))}], lambda p: u >= p)) END AS w FROM h),
s AS (SELECT b, stratum, sum(w) FILTER (arm) AS n1, sum(w) FILTER (NOT arm) AS n0, sum(w * value) FILTER (arm) AS x1, sum(w * value) FILTER (NOT arm) AS x0 FROM w GROUP BY ALL),
d AS (SELECT b, round(sum((n1 + n0) * (x1 / n1 - x0 / n0)) / sum(n1 + n0), 9) AS d FROM s WHERE n1 > 0 AND n0 > 0 GROUP BY b),
k AS (SELECT *, row_number() OVER (ORDER BY d, b) AS k, count(*) OVER () AS m FROM d WHERE b > 0)
SELECT (SELECT d FROM d WHERE b = 0) AS difference, max(CASE WHEN k = greatest(1, ceil(round(m * {(1 - LEVEL) / 2}, 9))) THEN d END) AS low, max(CASE WHEN k = greatest(1, ceil(round(m * {1 - (1 - LEVEL) / 2}, 9))) THEN d END) AS high, count(*) AS resamples FROM k""",
}
