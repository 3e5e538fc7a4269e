"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

A rule ``(host, path, verdict)`` fits its host and all subdomains where the URL's
path starts with the rule's; the longest fitting rule wins (host and path
together; between equal lengths, the longer host). URLs without a fitting rule get
the trees' verdict: ``block`` from ``THRESHOLD`` on.

The trees are trained from labelled URLs (label 1: unwanted). Features are lexical
and computed by the JVM: lengths, depth, digit ratio, entropy of the host's
characters, counts of parameters, hyphens, dots and host words, scheme, and the
smoothed share of label 1 among labelled URLs with the same host suffix (the last
label, and the last two, each hashed to ``SUFFIX_BUCKETS`` places, so that these
statistics are bounded). They count all labelled URLs, each leaving out itself
while training; the trees are fitted on a bounded, documented sample of about
``MAX_TRAIN`` of them, chosen by a hash of the URL, in one task.

``pages`` carries no labels, so ``op2_url_filter`` labels the hosts that hold one
of ``UNWANTED_WORDS`` as a whole word, weak labels from which the trees learn.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no
rule, and is allowed; very long URLs are read whole by the JVM; columns that are kept may
have any names; without labelled URLs, or with one class only, the trees
are a constant; repeated rows stay repeated; ties in tree splits go to the first
feature and the lower cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import picked, table

#: (host, path, verdict); a list given by hand, at most a few hundred.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words of host names that mark unwanted sites, for weak labels.
UNWANTED_WORDS = ["ads", "adult", "bet", "bets", "casino", "gambling", "lottery", "pills", "poker", "porn", "sex", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx"]

MAX_TRAIN, SUFFIX_BUCKETS, SMOOTHING = 20_000, 4096, 20.0
TREES, DEPTH, RATE, BINS, LEAST = 30, 3, 0.3, 32, 5
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def weak_label(host: Column, words: list[str] = UNWANTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(host, "[^a-z0-9]+"), F.array(*map(F.lit, words))).cast("int")


def _entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of a text's characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    bits = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (share := (n - F.size(F.array_remove(chars, c))) / n) * F.log2(share)
    )
    return F.when(n > 0, bits).otherwise(0.0)


LEXICAL = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "parameters", "query_length", "hyphens", "dots", "host_words", "secure"]


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path, the two suffixes and the lexical features (array<double> ``features``)."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    host, path = F.col("host"), F.col("path")
    made = {
        "url_length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/[^/]"),
        "digit_ratio": count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "host_digits": count(host, "[0-9]"),
        "entropy": _entropy(host),
        "parameters": count(query, "[^&=]+="),
        "query_length": F.length(query),
        "hyphens": count(host, "-"),
        "dots": count(host, r"\."),
        "host_words": count(host, "[a-z]+"),
        "secure": u.startswith("https:").cast("int"),
    }
    return df.select(
        "*",
        *(F.concat(F.lit(f"{k}:"), F.pmod(F.xxhash64(F.substring_index(host, ".", -k)), F.lit(SUFFIX_BUCKETS)).cast("string")).alias(f"suffix{k}") for k in (1, 2)),
        F.array(*(made[k].cast("double") for k in LEXICAL)).alias("features"),
    )


@dataclass
class Trees:
    """Complete binary trees of depth DEPTH: feature and cut of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees for the logistic loss: second-order gains over quantile histograms."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    trees = Trees(float(np.log(rate / (1 - rate))), *np.zeros((3, 0, 0)))
    if not len(y) or y.min() == y.max():
        return trees
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    made, margin = [], np.full(len(y), trees.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.zeros(width)
            at = node - first
            total = [np.bincount(at, w, width) for w in (g, h)]
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                slots = len(c) + 1
                sums = [np.bincount(at * slots + binned[:, k], w, width * slots).reshape(width, slots).cumsum(1)[:, :-1] for w in (g, h, np.ones(len(y)))]
                n = np.bincount(at, minlength=width)[:, None]
                left_g, left_h, left_n = sums
                right_g, right_h = total[0][:, None] - left_g, total[1][:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (total[0] ** 2 / (total[1] + 1))[:, None]
                gain[(left_n < LEAST) | (n - left_n < LEAST)] = 0
                j = gain.argmax(1)
                top = gain[np.arange(width), j]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first : first + width] = np.where(better, k, feature[first : first + width])
                cut[first : first + width] = np.where(better, c[j], cut[first : first + width])
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        margin += leaf[at]
        made.append((feature, cut, leaf))
    trees.feature, trees.cut, trees.leaf = (np.stack([t[i] for t in made]) for i in range(3))
    return trees


@dataclass
class Model:
    trees: Trees
    suffixes: dict[str, tuple[float, float]]
    rate: float

    def rows(self, features: list, suffix1: list, suffix2: list, own: np.ndarray | None = None) -> np.ndarray:
        """The features with the suffixes' shares of label 1; own: labels to leave out."""
        x = [np.array(features, np.float64).reshape(-1, len(LEXICAL))]
        for names in (suffix1, suffix2):
            n, ones = np.array([self.suffixes.get(s, (0.0, 0.0)) for s in names], np.float64).reshape(-1, 2).T
            if own is not None:
                n, ones = n - 1, ones - own
            x.append(((ones + SMOOTHING * self.rate) / (n + SMOOTHING))[:, None])
        return np.hstack(x)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """From rows with url and label (0 or 1, others and nulls are left out)."""
    rows = lexical(labelled.where("label in (0, 1) and url is not null").select("url", "label")).select("url", "label", "suffix1", "suffix2", "features")
    suffixes = rows.select("label", F.explode(F.array("suffix1", "suffix2")).alias("s"))
    stats = suffixes.groupBy("s").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()  # 2 * SUFFIX_BUCKETS at most
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    model = Model(fit(np.zeros((0, 1)), np.zeros(0)), {r.s: (float(r.n), float(r.ones)) for r in stats}, (total.ones + 0.5) / (total.n + 1))
    if not total.n:
        model.trees.base = -np.inf
        return model
    h = F.xxhash64("url", F.lit("trees"))
    sample = rows.where(picked(h, max_train, total.n)).select(h.alias("h"), F.col("label").cast("int").alias("label"), "suffix1", "suffix2", "features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[1]))
        y = np.array([r[1] for r in seen], np.float64)
        t = fit(model.rows([r[4] for r in seen], [r[2] for r in seen], [r[3] for r in seen], y), y)
        yield pa.RecordBatch.from_arrays([pa.array([t.base]), *(pa.array([np.asarray(a, kind).tobytes()], pa.binary()) for a, kind in ((t.feature, "<i8"), (t.cut, "<f8"), (t.leaf, "<f8")))], ["base", "feature", "cut", "leaf"])

    fitted = sample.repartition(1).mapInArrow(learn, "base double, feature binary, cut binary, leaf binary").first()
    if fitted is not None:
        model.trees = Trees(fitted.base, np.frombuffer(fitted.feature, "<i8").reshape(-1, 2**DEPTH - 1), np.frombuffer(fitted.cut, "<f8").reshape(-1, 2**DEPTH - 1), np.frombuffer(fitted.leaf, "<f8").reshape(-1, 2**DEPTH))
    return model


def judge(spark: SparkSession, urls: DataFrame, model: Model, keep: list[str], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """keep (columns of urls), with host, path, rule, verdict and score of the column url."""
    rows = lexical(urls.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), "url")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = m.rows(*(b.column(c).to_pylist() for c in ("features", "suffix1", "suffix2")))
            p = 1 / (1 + np.exp(-np.clip(m.trees.margin(x), -35, 35)))
            held = [n for n in b.schema.names if n not in ("features", "suffix1", "suffix2")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), pa.array(p)], [*held, "score"])

    rows = rows.select(*(f"k{i}" for i in range(len(keep))), "host", "path", "fit", "features", "suffix1", "suffix2")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("features", "suffix1", "suffix2"))
    scored = rows.mapInArrow(run, f"{schema}, score double")
    by_trees = F.when((F.col("score") >= THRESHOLD) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_trees).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labelled = pages.select("url", weak_label(host_of(F.col("url"))).alias("label"))
    return judge(spark, pages, train(labelled), ["page_id"])


QUERIES = {"op2_url_filter": op2_url_filter}
