"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are counted for each cell (source, language, topic). Raking scales the
cells by one factor for each source, language and topic in turn until their
marginals meet the targets; a marginal's target is its own token share tempered by
an exponent below 1, or a table given by the caller. A document of cell c is kept
with probability min(1, k * weight_c / tokens_c), where k is set so that
``keep_share`` of all tokens is expected to stay; the draw is a hash of doc_id, so
that it repeats. All of it is DataFrame operations: the cells are one aggregation
with map-side combining, so that no source, however large, meets in one task; the
factors are small tables, written to the shared folder after each step.

The probabilities join the documents by broadcast where the cells number at most
``BROADCAST_CELLS``, and by a join salted over the documents' ids beyond.

Defined cases: a null source or language counts as the empty string; null and
empty texts have no tokens and no weight and are kept where their cell has no
tokens, else by their cell's probability; documents that share an id share their
draw; an empty table gives an empty result; every column of the input stays, in
the struct ``doc``, so that none clashes with the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved, table

#: The exponents that temper each marginal's share.
TEMPERATURES = {"source": 0.7, "lang": 0.6, "topic": 0.8}
KEEP_SHARE, SWEEPS, LEVELS = 0.6, 6, 12
BROADCAST_CELLS, SALTS = 200_000, 64
WORD = r"[^\x20\x09-\x0D]+"
#: Topics by what a text holds, first fit first; the rest go by length.
TOPICS = [("legal", "[Ll]icen[sc]e|LICENSE|[Cc]opyright"), ("contact", "[A-Za-z0-9]@[A-Za-z0-9]"), ("listing", r"\|")]


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    out = F.when(tokens < 100, "brief").when(tokens < 1000, "article").otherwise("long")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def tempered(cells: DataFrame, margin: str, exponent: float) -> DataFrame:
    """(margin, target): the shares of tokens raised to exponent, summing to 1."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).withColumn("target", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    total = own.agg(F.sum("target").alias("all"))
    return own.join(F.broadcast(total)).select(margin, (F.col("target") / F.col("all")).alias("target"))


def rake(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (the margins and tokens > 0) with weight: tokens times one factor for each margin, as the last step leaves them."""
    factors = {m: None for m in targets}

    def scaled(without: str | None = None) -> DataFrame:
        out, w = cells, F.col("tokens").cast("double")
        for m, f in factors.items():
            if m != without and f is not None:
                out = out.join(f.withColumnRenamed("factor", f"by_{m}"), m)
                w = w * F.col(f"by_{m}")
        return out.select(*cells.columns, w.alias("weight"))

    for _ in range(sweeps):
        for m, target in targets.items():
            sums = scaled(m).groupBy(m).agg(F.sum("weight").alias("now"))
            factors[m] = saved(spark, sums.join(target, m).select(m, (F.col("target") / F.col("now")).alias("factor")), f"factor-{m}")
    return scaled()


def probabilities(spark: SparkSession, cells: DataFrame, keep_share: float = KEEP_SHARE, levels: int = LEVELS) -> DataFrame:
    """Weighted cells with probability, so that keep_share of the tokens is expected to stay."""
    ratio = F.col("weight") / F.col("tokens")
    total = cells.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    budget = keep_share * (total.t or 0)
    k = budget / (total.w or 1.0)
    for _ in range(levels):
        full = F.lit(k) * ratio >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not r.w or k == (k := (budget - r.t) / r.w):
            break
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(k) * ratio))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that the id names."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, temperatures: dict[str, float] = TEMPERATURES) -> DataFrame:
    """doc (a struct of all columns of docs), source, lang, topic, n_tokens, probability and kept: which rows are sampled.

    targets: for some of source, lang and topic, a table (that column, target) of
    shares; a category without a target is not kept.
    """
    text, keys = F.col("doc.text"), ["source", "lang", "topic"]
    marked = docs.select(F.struct("*").alias("doc")).select("doc", F.coalesce("doc.source", F.lit("")).alias("source"), F.coalesce("doc.lang", F.lit("")).alias("lang"), tokens_of(text).alias("n_tokens"))
    marked = marked.withColumn("topic", topic_of(text, F.col("n_tokens")))
    counted = marked.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    cells = saved(spark, counted.where("tokens > 0"), "cells")
    found = {m: (targets or {}).get(m, None) for m in temperatures}
    found = {m: saved(spark, tempered(cells, m, temperatures[m]), f"target-{m}") if t is None else t for m, t in found.items()}
    weighted = saved(spark, rake(spark, cells, found), "weights")
    chances = saved(spark, probabilities(spark, weighted, keep_share), "chances").select(*keys, "probability")
    if chances.count() <= BROADCAST_CELLS:
        joined = marked.join(F.broadcast(chances), keys, "left")
    else:
        salted = chances.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn("salt", F.pmod(F.xxhash64("doc.doc_id", "doc.text"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")
    # a cell without tokens has no row; with given targets, neither has a cell whose category has none
    chance = F.coalesce("probability", F.when(F.col("n_tokens") == 0, 1.0).otherwise(0.0))
    return joined.withColumn("probability", chance).withColumn("kept", draw(F.col("doc.doc_id")) < F.col("probability"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(spark, table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return got.select("doc.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix keeps."""
    return mix(spark, docs).where("kept").select("doc.*")


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    topics = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in TOPICS)
    ctes = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, CAST(coalesce(len(regexp_extract_all(text, '{word}')), 0) AS BIGINT) AS n_tokens FROM documents)",
        f"m AS (SELECT doc_id, source, lang, n_tokens, CASE {topics} WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM d)",
        "s0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM m GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for c, e in TEMPERATURES.items():
        ctes.append(f"t_{c} AS (SELECT {c}, pow(CAST(sum(tokens) AS DOUBLE), {e}) / sum(pow(CAST(sum(tokens) AS DOUBLE), {e})) OVER () AS target FROM s0 GROUP BY {c})")
    n = 0
    for _ in range(SWEEPS):
        for c in TEMPERATURES:
            ctes.append(f"s{n + 1} AS MATERIALIZED (SELECT s.source, s.lang, s.topic, s.tokens, s.w * t.target / sum(s.w) OVER (PARTITION BY s.{c}) AS w FROM s{n} s JOIN t_{c} t ON s.{c} = t.{c})")
            n += 1
    ctes.append(f"k0 AS MATERIALIZED (SELECT {KEEP_SHARE} * sum(tokens) / sum(w) AS k FROM s{n})")
    for i in range(LEVELS):
        ctes.append(
            f"k{i + 1} AS MATERIALIZED (SELECT coalesce(({KEEP_SHARE} * sum(tokens) - sum(CASE WHEN k * w / tokens >= 1 THEN tokens ELSE 0 END)) / nullif(sum(CASE WHEN k * w / tokens >= 1 THEN 0 ELSE w END), 0), max(k)) AS k FROM s{n}, k{i})"
        )
    ctes.append(f"p AS (SELECT source, lang, topic, least(1.0, k * w / tokens) AS p FROM s{n}, k{LEVELS})")
    ctes.append("j AS (SELECT m.*, coalesce(p.p, CASE WHEN n_tokens = 0 THEN 1.0 ELSE 0.0 END) AS p, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM m LEFT JOIN p USING (source, lang, topic))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, u < p AS kept FROM j"


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": _oracle()}
