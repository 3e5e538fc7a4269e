"""Exact top-k inner products: groups of norm-sorted blocks that all queries pass, and matrix products that only a few pairs leave.

Components become integers (``floor(scale * x)``), so scores are exact. Candidates
are range-partitioned by descending length and packed into blocks of ``BLOCK``, at
most ``BLOCK_BYTES``; queries are packed into blocks of ``QUERY_BLOCK``. The longest
block of all gives each query a first threshold (its k-th best score there).

Blocks of candidates are dealt into groups of ``GROUP_BYTES`` at most; a task holds
one group, and all query blocks pass it as a stream, each sent once to each group:
what travels is the candidates once and the queries once for each group, not both
sides of each pair of blocks. A query block meets the blocks of the group by
descending length and raises its thresholds as it goes; a block whose longest
vector can't reach a query's threshold is left out for that query. The rest is one
matrix product; of its scores, those that reach the threshold, and of these the k
best of each query, go on. Doubles hold the scores of integers exactly below 2**53;
where they could be larger, what is within the rounding error of the threshold is
scored again in integers. Each group returns k rows at most for a query, which one
window merges.

Defined cases: vectors that are null or hold null, NaN or infinite components, and
rows without an id, take no part; rows that share an id count once (the smallest
by their components' bytes); vectors only meet those of their own dimension; ties
go to the smaller id; a query with fewer than k candidates gets them all; sums that
could pass 64 bits are made in Python's integers, a score beyond a long is its end,
and a component beyond +-2**62 after scaling counts as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, saved, table

BLOCK, QUERY_BLOCK, LARGEST = 4096, 1024, 2.0**62
#: Bytes of a block's vectors and of the vectors that a task holds at a time, and rows of queries in one matrix product.
BLOCK_BYTES, GROUP_BYTES, ROWS = 2 << 20, 64 << 20, 256


def integers(df: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, norm, v): the scaled floors of column ``embedding`` as packed 64-bit integers, valid rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, norms, vs = [], [], [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.clip(np.floor(scale * v), -LARGEST, LARGEST)
                ids.append(i), dims.append(len(v)), norms.append(float(np.sqrt(v @ v))), vs.append(v.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(vs, pa.binary())], ["vec_id", "dim", "norm", "v"])

    return df.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, dim int, norm double, v binary")


PACKED = "dim int, longest double, n int, ids binary, vs binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to size vectors of one dimension, and BLOCK_BYTES, in the order of each partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, norms, vs = zip(*held.pop(dim))
            return pa.RecordBatch.from_pylist([{"dim": dim, "longest": max(norms), "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "vs": b"".join(vs)}], schema)

        for b in batches:
            for i, dim, norm, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "norm", "v"))):
                held.setdefault(dim, []).append((i, norm, v))
                if len(held[dim]) == min(size, max(1, BLOCK_BYTES // (8 * max(dim, 1)))):
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    schema = pa.schema([("dim", pa.int32()), ("longest", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vs", pa.binary())])
    return rows.mapInArrow(run, PACKED)


class Side:
    """One block: vectors as integers and as doubles, by ascending id."""

    def __init__(self, dim: int, ids: bytes, vs: bytes):
        given = np.frombuffer(ids, "<i8")
        order = np.argsort(given, kind="stable")
        self.ids = given[order]
        self.whole = np.frombuffer(vs, "<i8").reshape(len(given), dim)[order]
        self.v = self.whole.astype(np.float64)
        self.norms = np.sqrt((self.v * self.v).sum(1))
        self.longest = float(self.norms.max(initial=0.0))
        self.largest = float(np.abs(self.v).max(initial=0.0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integers, exact: in 64 bits where no sum can pass them, else in Python's integers, and the ends of a long for what is beyond."""
    if not a.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**62:
        return (a * b).sum(1)
    sums = (a.astype(object) * b.astype(object)).sum(1)
    return np.array([max(-(2**63) + 1, min(2**63 - 1, x)) for x in sums], np.int64)


def _first(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k largest of each row, of equal ones those that come first; minus infinity is none."""
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above = s > kth
        level = (s == kth) & np.isfinite(s)
        keep = above | (level & (level.cumsum(1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
    else:
        keep = np.isfinite(s)
    return np.nonzero(keep)


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, queries: Side, k: int, least: np.ndarray):
        self.q, self.k, self.least = queries, k, least.copy()
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, c: Side) -> None:
        q = self.q
        # whether no sum of products can leave the integers that doubles hold
        plain = q.largest * c.largest * q.v.shape[1] < 2.0**53
        room = 1e-6 + 1e-9 * q.norms * c.longest
        rows = np.nonzero(q.norms * c.longest + room >= self.least)[0]
        found = [self._met(rows[i : i + ROWS], c, 0.0 if plain else room[rows[i : i + ROWS]]) for i in range(0, len(rows), ROWS)]
        qi, ci, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if not len(qi):
            return
        row, ids, score = np.append(self.row, qi), np.append(self.id, c.ids[ci]), np.append(self.score, score)
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        first = rank < self.k
        self.row, self.id, self.score = row[first], ids[first], score[first]
        full = rank == self.k - 1
        self.least[row[full]] = np.maximum(self.least[row[full]], score[full])

    def _met(self, rows: np.ndarray, c: Side, room: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of what can be among the k best of the queries in rows."""
        q = self.q
        s = q.v[rows] @ c.v.T
        # a query doesn't meet itself; ids of a block ascend
        own = np.searchsorted(c.ids, q.ids[rows])
        at = np.nonzero((own < len(c.ids)) & (c.ids[np.minimum(own, len(c.ids) - 1)] == q.ids[rows]))[0]
        s[at, own[at]] = -np.inf
        exact = isinstance(room, float)
        if not exact:
            s = np.where(np.isfinite(s), np.clip(s, -(2.0**63), 2.0**63), s)  # scores beyond a long are its end, and tie
        reach = s >= (self.least[rows] - room)[:, None]
        many = np.count_nonzero(reach, axis=1)
        some, crowded = np.nonzero((many > 0) & (many <= self.k))[0], np.nonzero(many > self.k)[0]
        qi, ci = np.nonzero(reach[some])
        qi = some[qi]
        if len(crowded):
            t = np.where(reach[crowded], s[crowded], -np.inf)
            if exact:
                r, m = _first(t, self.k)
            else:
                kth = np.partition(t, t.shape[1] - self.k, axis=1)[:, t.shape[1] - self.k] if t.shape[1] > self.k else np.full(len(t), -np.inf)
                r, m = np.nonzero((t >= (kth - 2 * room[crowded])[:, None]) & np.isfinite(t))
            qi, ci = np.append(qi, crowded[r]), np.append(ci, m)
        hit = np.isfinite(s[qi, ci])
        qi, ci = qi[hit], ci[hit]
        if exact:
            score = s[qi, ci].astype(np.int64)
        else:
            score = np.concatenate([_exact(q.whole[rows[qi[i : i + 65536]]], c.whole[ci[i : i + 65536]]) for i in range(0, len(qi), 65536)] or [np.zeros(0, np.int64)])
        return rows[qi], ci, score


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0, block: int = BLOCK, queries: int = QUERY_BLOCK, group: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) with is_query, its k best among all other rows."""
    bounded_batches(spark)
    rows = integers(vectors, scale).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("x")).select("vec_id", "x.*")
    rows = saved(spark, rows, "vectors")

    by_length = rows.repartitionByRange(F.desc("dim"), F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("dim"), F.desc("norm"), F.asc("vec_id"))
    candidates = saved(spark, _packed(by_length, block).withColumn("c", F.monotonically_increasing_id()), "candidates")
    asked = _packed(rows.where(is_query).repartition("vec_id"), queries)
    asked = saved(spark, asked.withColumn("qb", F.monotonically_increasing_id()), "queries")

    # one block for each dimension, so at most BLOCK_BYTES of it, or one vector
    first = candidates.groupBy("dim").agg(F.max_by("c", F.struct("longest", "n")).alias("c"))
    first = candidates.join(F.broadcast(first.select("c")), "c", "left_semi").select("dim", "ids", "vs").collect()
    heads = spark.sparkContext.broadcast({r.dim: (bytes(r.ids), bytes(r.vs)) for r in first})

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = []
            for r in b.to_pylist():
                q = Side(r["dim"], r["ids"], r["vs"])
                best = Best(q, k, np.full(len(q.ids), -np.inf))
                if r["dim"] in heads.value:
                    best.meet(Side(r["dim"], *heads.value[r["dim"]]))
                # in the order of the block's bytes
                given = np.frombuffer(r["ids"], "<i8")
                least.append(best.least[np.argsort(np.argsort(given, kind="stable"))].astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.binary())], [*b.schema.names, "least"])

    asked = asked.select("qb", "dim", "ids", "vs").mapInArrow(seed, "qb bigint, dim int, ids binary, vs binary, least binary")

    # groups: as many as the vectors need, and more where there are fewer than cores; each has blocks of all lengths, and dimensions that have blocks in it get its queries
    sizes = candidates.agg(F.count("*").alias("n"), F.sum(F.col("n") * F.greatest("dim", F.lit(1)) * F.lit(8).cast("bigint")).alias("b")).first()
    groups = max(1, min(sizes.n, max(-(-(sizes.b or 0) // group), 2 * spark.sparkContext.defaultParallelism)))
    dealt = F.pmod(F.dense_rank().over(Window.orderBy("c")) - 1, F.lit(groups)).cast("bigint")  # ids and numbers of blocks alone
    places = saved(spark, candidates.select("c", "dim").withColumn("g", dealt), "places")
    nothing = F.lit(None).cast("binary")
    held = candidates.join(F.broadcast(places.select("c", "g")), "c").select("g", "dim", F.lit(0).alias("kind"), (-F.col("longest")).alias("turn"), "ids", "vs", nothing.alias("least"))
    sent = asked.join(F.broadcast(places.select("dim", "g").distinct()), "dim").select("g", "dim", F.lit(1).alias("kind"), F.col("qb").cast("double").alias("turn"), "ids", "vs", "least")
    met = held.unionByName(sent).repartition(max(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), "g", "dim").sortWithinPartitions("g", "dim", "kind", "turn")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: each is a block
                r = b.slice(i, 1).to_pylist()[0]
                if at != (r["g"], r["dim"]):
                    at, blocks = (r["g"], r["dim"]), []
                side = Side(r["dim"], r["ids"], r["vs"])
                if r["kind"] == 0:
                    blocks.append(side)
                    continue
                least = np.frombuffer(r["least"], "<f8")[np.argsort(np.frombuffer(r["ids"], "<i8"), kind="stable")]
                best = Best(side, k, least)
                for c in blocks:
                    best.meet(c)
                if len(best.row):
                    yield pa.RecordBatch.from_arrays([pa.array(side.ids[best.row]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op9_exact_topk": op9_exact_topk}
ORACLES = {"op9_exact_topk": ORACLE}
