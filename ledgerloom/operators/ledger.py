"""The ledger: statements that retire older ones, what still stands, who replaced whom.

A statement has an id (a logical clock), a store, a subject, a relation, an object
and a date. Nothing is overwritten: a retirement names the statement that caused
it, and every serving query reads only what stands.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import saved, table

#: A chain of replacements is followed this far: 2**HOPS steps.
HOPS = 5
CAP, PAGE = 40, 120
MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements: each user is a store, and an event's type says what its number is about."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("store"), F.col("event_type").alias("relation"), F.regexp_extract("props", r'"k": ?([0-9]+)', 1).alias("object"), F.expr(MS).alias("created"), "value"
    )


def heirs(rows: DataFrame) -> DataFrame:
    """(id, heir): for each statement that is retired by key, the first later one of the same key with another object that is not older.

    Keys are sorted once, and each task passes over its rows in that order: statements that still wait for an heir lie in heaps by
    object, the oldest first, and a new one takes from all heaps but its own object's what is not newer than it is. Each statement
    enters and leaves a heap once; an old statement that arrives late retires nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, tops = None, {}, []
        for b in batches:
            ids, found = [], []
            for store, relation, i, obj, created in zip(*(b.column(c).to_pylist() for c in ("store", "relation", "id", "object", "created"))):
                if at != (store, relation):
                    at, waiting, tops = (store, relation), {}, []
                if obj is None or created is None:
                    continue
                kept = []
                while tops and tops[0][0] <= created:
                    then, other = heapq.heappop(tops)
                    heap = waiting.get(other)
                    if not heap or heap[0][0] != then:
                        continue
                    if other == obj:
                        kept.append((then, other))
                        continue
                    ids.append(heapq.heappop(heap)[1])
                    found.append(i)
                    if heap:
                        heapq.heappush(tops, (heap[0][0], other))
                    else:
                        del waiting[other]
                heap = waiting.setdefault(obj, [])
                first = heap[0][0] if heap else None
                heapq.heappush(heap, (created, i))
                for entry in kept[:1]:
                    heapq.heappush(tops, entry)
                if first is None or created < first:
                    heapq.heappush(tops, (created, obj))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["id", "heir"])

    keyed = rows.where("store is not null and relation is not null").select("store", "relation", "id", "object", "created").repartition("store", "relation").sortWithinPartitions("store", "relation", "id")
    return keyed.mapInArrow(run, "id bigint, heir bigint")


def served(rows: DataFrame, retired: DataFrame) -> DataFrame:
    """What still stands: the only rows that serving queries may read."""
    return rows.join(retired.select("id"), "id", "left_anti")


def chain_ends(spark: SparkSession, links: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, last, steps): where each chain of heirs ends, by doubling: after n joins, 2**n steps are known."""
    now = saved(spark, links.select("id", F.col("heir").alias("last"), F.lit(1).cast("bigint").alias("steps")), "chain")
    for _ in range(hops):
        onward = now.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        if now.join(onward, "last", "left_semi").isEmpty():  # nothing moves any more
            break
        now = saved(spark, now.join(onward, "last", "left").select("id", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chain")
    return now


def m2_supersede_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heirs(statements(spark, sf_dir))


def flt1_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    return served(rows, heirs(rows)).select("id", "store", "relation", "object")


def r27_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_ends(spark, heirs(statements(spark, sf_dir)))


def ag3_heirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heir with the ids it retired, ascending."""
    got = heirs(statements(spark, sf_dir)).groupBy("heir").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    return got.select("heir", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


def m1_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each hash of its parts: the first writer wins; how many were ignored."""
    parts = F.concat_ws("|", F.lit("episode"), "source", F.lit("states"), "lang", "text")
    return table(spark, sf_dir, "documents").groupBy(F.sha2(parts.cast("binary"), 256).alias("dedup")).agg(F.min("doc_id").alias("id"), (F.count("*") - 1).alias("ignored"))


def jn2_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of standing statements of one key that say different things (what came late and so retired nothing)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("relation"), F.col("o_orderstatus").alias("object"))
    other = rows.select("subject", "relation", F.col("id").alias("other_id"), F.col("object").alias("other"))
    return rows.join(other, ["subject", "relation"]).where("id < other_id AND object <> other").select("id", "other_id", "subject")


def r28_marked_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts found now, and marked ones whose two sides still stand."""
    found = jn2_conflicts(spark, sf_dir).select("id", "other_id")
    marked = found.where("(id + other_id) % 3 = 0").select(F.col("other_id").alias("id"), F.col("id").alias("other_id"))
    stand = table(spark, sf_dir, "orders").where("o_totalprice > 1000").select(F.col("o_orderkey").alias("id"))
    marked = marked.join(stand, "id", "left_semi").join(stand.withColumnRenamed("id", "other_id"), "other_id", "left_semi").select("id", "other_id")
    return found.union(marked).select(F.least("id", "other_id").alias("id"), F.greatest("id", "other_id").alias("other_id")).distinct()


def tk4_cap_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each store with more than CAP statements, the oldest beyond it that no retirement refers to."""
    rows = statements(spark, sf_dir)
    refs = heirs(rows).select(F.col("heir").alias("id"))
    over = rows.groupBy("store").agg((F.count("*") - CAP).alias("over")).where("over > 0")
    free = rows.join(refs, "id", "left_anti").join(over, "store")
    rn = F.row_number().over(Window.partitionBy("store").orderBy("created", "id"))
    return free.withColumn("rn", rn).where("rn <= over").select("id", "store", "rn")


def tk3_catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of standing statements, and one row more that tells that it is cut."""
    rows = statements(spark, sf_dir)
    return served(rows, heirs(rows)).orderBy(F.desc("created"), F.desc("id")).limit(PAGE + 1).select("id", "relation", "created")


def wn1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds interleaved: the newest of each, then the second newest of each, and so on; errors first among equals; 64 of them.

    Only each kind's first 64 matter, which Spark's window limit finds within each task before any kind's rows meet.
    """
    rows = statements(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("created"), F.desc("id"))) - 1
    first = rows.withColumn("rn", rn).where("rn < 64")
    return first.orderBy("rn", F.when(F.col("relation") == "error", 0).otherwise(1), F.desc("created"), F.desc("id")).limit(64).select("id", "relation", "rn")


def jn7_first_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each statement's words were first said in its store: its own date, or an earlier saying's."""
    rows = statements(spark, sf_dir)
    first = rows.groupBy("store", "relation", "object").agg(F.min("created").alias("earliest"), F.count("*").alias("sayings"))
    return rows.join(first, ["store", "relation", "object"]).where("sayings > 1").select("id", F.least("created", "earliest").alias("first_said"), "sayings")


def jn8_anaphoric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the newest earlier event of its store within three hours that was no purchase.

    A range join as an equality join: each side is cut into buckets of three hours, and the earlier side is put into its own and the next.
    """
    span = 3 * 3600 * 1000
    rows = statements(spark, sf_dir)
    later = rows.where("relation = 'purchase'").select("store", "id", "created", F.floor(F.col("created") / span).alias("bucket"))
    earlier = rows.where("relation <> 'purchase'").select("store", F.col("id").alias("earlier"), F.col("created").alias("then"), F.floor(F.col("created") / span).alias("b"))
    earlier = earlier.select("store", "earlier", "then", F.explode(F.array("b", F.col("b") + 1)).alias("bucket"))
    met = later.join(earlier, ["store", "bucket"]).where(f"created > then AND created - then <= {span}")
    return met.groupBy("id").agg(F.max_by("earlier", F.struct("then", "earlier")).alias("earlier"))


def jn9_previous_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each statement, the newest earlier one of its key that holds another number: the last row of the run before its own."""
    rows = statements(spark, sf_dir)
    order = Window.partitionBy("store", "relation").orderBy("id")
    changed = F.when(F.col("object") != F.lag("object").over(order), 1).otherwise(0)
    runs = rows.withColumn("c", changed).withColumn("run", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy("store", "relation", (F.col("run") + 1).alias("run")).agg(F.max("id").alias("holder"))
    return runs.join(ends, ["store", "relation", "run"]).select("id", "holder")


def m14_last_run_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a store whose last event of the kind (error or purchase) is no error: they are settled."""
    rows = statements(spark, sf_dir).where("relation IN ('error', 'purchase')")
    last = rows.groupBy("store").agg(F.max_by("relation", F.struct("created", "id")).alias("last"))
    return rows.where("relation = 'error'").join(last.where("last = 'purchase'"), "store").select("id", "store")


def m16_anchor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose anchor's content is gone or has changed since, compared null-safely."""
    now = table(spark, sf_dir, "part").where("p_size % 7 <> 0").select("p_partkey", F.md5(F.concat_ws("|", "p_name", F.when(F.col("p_size") % 5 == 0, F.lit("x")).otherwise(F.col("p_brand"))).cast("binary")).alias("now"))
    then = table(spark, sf_dir, "part").select("p_partkey", F.md5(F.concat_ws("|", "p_name", "p_brand").cast("binary")).alias("then"))
    return then.join(now, "p_partkey", "left").where(~F.col("then").eqNullSafe(F.col("now"))).select("p_partkey", F.col("now").isNull().alias("gone"))


def m17_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the statements of one kind: standing ones become revoked, retired ones keep their heir."""
    rows = statements(spark, sf_dir).where("relation = 'signup'").select("id")
    return rows.join(heirs(statements(spark, sf_dir)), "id", "left").select("id", F.when(F.col("heir").isNull(), "revoked").otherwise("superseded").alias("reason"), "heir")


def jn5_jn6_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an open order and none of the highest priority."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf_dir, "customer").join(orders.where("o_orderstatus = 'O'"), "c_custkey", "left_semi").join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def jn15_id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage whose both ends get new ids on import; of small value nothing is imported, and ends that are not become null."""
    links = heirs(statements(spark, sf_dir))
    ids = statements(spark, sf_dir).where("value > 5").select("id", (F.col("id") * 10 + 7).alias("new_id"))
    to = ids.select(F.col("id").alias("heir"), F.col("new_id").alias("new_heir"))
    return links.join(ids, "id").join(to, "heir", "left").select(F.col("new_id").alias("id"), F.col("new_heir").alias("heir"))


def c5_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two listings of (name, content), either way."""
    was = table(spark, sf_dir, "part").select("p_name", "p_brand")
    now = table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select("p_name", F.when(F.col("p_partkey") % 13 == 0, "changed").otherwise(F.col("p_brand")).alias("p_brand"))
    return was.exceptAll(now).withColumn("side", F.lit("was")).unionByName(now.exceptAll(was).withColumn("side", F.lit("now")))


_S = r"""s AS (SELECT event_id AS id, user_id AS store, event_type AS relation, regexp_extract(props, '"k": ?([0-9]+)', 1) AS object, epoch_us(ts) // 1000 AS created, value FROM events)"""
_H = _S + """,
h AS (SELECT a.id, min(b.id) AS heir FROM s a JOIN s b ON a.store = b.store AND a.relation = b.relation AND b.id > a.id AND b.object <> a.object AND b.created >= a.created GROUP BY a.id)"""
_F = "f AS (SELECT o.o_orderkey AS id, p.o_orderkey AS other_id, o.o_custkey AS subject FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey AND o.o_orderpriority = p.o_orderpriority AND o.o_orderkey < p.o_orderkey AND o.o_orderstatus <> p.o_orderstatus)"

ORACLES = {
    "m2_supersede_by_key": f"WITH {_H} SELECT id, heir FROM h",
    "flt1_served": f"WITH {_H} SELECT id, store, relation, object FROM s WHERE id NOT IN (SELECT id FROM h)",
    "r27_lineage": f"""WITH RECURSIVE {_H},
walk AS (SELECT id, heir AS last, CAST(1 AS BIGINT) AS steps FROM h UNION ALL SELECT w.id, h.heir, w.steps + 1 FROM walk w JOIN h ON h.id = w.last WHERE w.steps < 32)
SELECT id, max_by(last, steps) AS last, max(steps) AS steps FROM walk GROUP BY id""",
    "ag3_heirs": f"WITH {_H} SELECT heir, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n FROM h GROUP BY heir",
    "m1_insert_or_ignore": "SELECT sha256('episode|' || source || '|states|' || lang || '|' || text) AS dedup, min(doc_id) AS id, count(*) - 1 AS ignored FROM documents GROUP BY 1",
    "jn2_conflicts": f"WITH {_F} SELECT id, other_id, subject FROM f",
    "r28_marked_conflicts": f"""WITH {_F}, stand AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 1000)
SELECT id, other_id FROM f UNION SELECT id, other_id FROM f WHERE (id + other_id) % 3 = 0 AND id IN (SELECT id FROM stand) AND other_id IN (SELECT id FROM stand)""",
    "tk4_cap_archive": f"""WITH {_H}, o AS (SELECT store, count(*) - {CAP} AS over_by FROM s GROUP BY store HAVING count(*) > {CAP})
SELECT id, store, rn FROM (SELECT s.id, s.store, over_by, CAST(row_number() OVER (PARTITION BY s.store ORDER BY created, s.id) AS INTEGER) AS rn FROM s JOIN o USING (store) WHERE s.id NOT IN (SELECT heir FROM h)) WHERE rn <= over_by""",
    "tk3_catalogue_page": f"WITH {_H} SELECT id, relation, created FROM s WHERE id NOT IN (SELECT id FROM h) ORDER BY created DESC, id DESC LIMIT {PAGE + 1}",
    "wn1_interleave": f"""WITH {_S} SELECT id, relation, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY relation ORDER BY created DESC, id DESC) - 1 AS INTEGER) AS rn FROM s)
ORDER BY rn, CASE WHEN relation = 'error' THEN 0 ELSE 1 END, created DESC, id DESC LIMIT 64""",
    "jn7_first_said": f"WITH {_S} SELECT id, first_said, sayings FROM (SELECT id, min(created) OVER w AS first_said, count(*) OVER w AS sayings FROM s WINDOW w AS (PARTITION BY store, relation, object)) WHERE sayings > 1",
    "jn8_anaphoric": f"""WITH {_S} SELECT p.id, max_by(e.id, e.created * 1000000 + e.id) AS earlier FROM s p JOIN s e ON p.store = e.store AND p.relation = 'purchase' AND e.relation <> 'purchase' AND e.created < p.created AND p.created - e.created <= 10800000 GROUP BY p.id""",
    "jn9_previous_holder": f"WITH {_S} SELECT a.id, max(b.id) AS holder FROM s a JOIN s b ON a.store = b.store AND a.relation = b.relation AND b.id < a.id AND b.object <> a.object GROUP BY a.id",
    "m14_last_run_wins": f"WITH {_S}, l AS (SELECT store, max_by(relation, created * 1000000 + id) AS last FROM s WHERE relation IN ('error', 'purchase') GROUP BY store) SELECT id, store FROM s JOIN l USING (store) WHERE relation = 'error' AND last = 'purchase'",
    "m16_anchor_validation": """WITH n AS (SELECT p_partkey, md5(p_name || '|' || CASE WHEN p_size % 5 = 0 THEN 'x' ELSE p_brand END) AS now FROM part WHERE p_size % 7 <> 0)
SELECT p.p_partkey, n.now IS NULL AS gone FROM part p LEFT JOIN n USING (p_partkey) WHERE md5(p_name || '|' || p_brand) IS DISTINCT FROM n.now""",
    "m17_revoke": f"WITH {_H} SELECT s.id, CASE WHEN heir IS NULL THEN 'revoked' ELSE 'superseded' END AS reason, heir FROM s LEFT JOIN h USING (id) WHERE relation = 'signup'",
    "jn5_jn6_semi_anti": """SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "jn15_id_remap": f"WITH {_H}, m AS (SELECT id, id * 10 + 7 AS new_id FROM s WHERE value > 5) SELECT a.new_id AS id, b.new_id AS heir FROM h JOIN m a ON h.id = a.id LEFT JOIN m b ON h.heir = b.id",
    "c5_staleness": """WITH w AS (SELECT p_name, p_brand FROM part), n AS (SELECT p_name, CASE WHEN p_partkey % 13 = 0 THEN 'changed' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 11 <> 0)
SELECT *, 'was' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'now' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM w)""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
