"""Who wrote a prompt, told by what sessions hand over, and the ledger that follows.

A prompt is an agent's if another session has handed its whole text over as a task:
both are hashed with white space made single and letters made small, from ``LEAST``
characters on. That can come to light long after the prompt was read. ``settle``
gives the ledger that all statements and tasks together say, whatever came first:

* a person's statement stands until the next one of a person with the same kind and
  key says another object (``superseded``, by the first that does);
* a statement of a prompt that an agent wrote is ``revoked`` and supersedes nothing,
  so that what it had retired stands again;
* an episode of such a turn is ``relabelled``: an heir of its own text, said by the
  agent, takes its place, and no episode supersedes another.

``streaming.authorship`` emits the same states as signed rows while rows arrive.
A hash has one row of tasks (the least and the greatest session that handed it over),
so that a text that many sessions type meets a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import table

LEAST = 40


def text_hash(text: Column) -> Column:
    """What a whole text is matched by; null if it is too short to be a task."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(plain) >= LEAST, F.md5(plain.cast("binary")))


def by_agents(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """rows (session, hash, ...) with agent: whether another session handed the text over. tasks: session, hash."""
    handed = tasks.where("hash is not null").groupBy("hash").agg(F.min("session").alias("_low"), F.max("session").alias("_high"))
    agent = (F.col("_low") != F.col("session")) | (F.col("_high") != F.col("session"))
    return rows.join(handed, "hash", "left").withColumn("agent", F.coalesce(agent, F.lit(False))).drop("_low", "_high")


def settle(statements: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, state, by, via) of statements id, session, hash, kind, key, object, created; heirs of relabelled episodes have the negative id."""
    rows = by_agents(statements, tasks)
    episodes, agents = rows.where("kind = 'episode'"), rows.where("kind <> 'episode' and agent")
    order = Window.partitionBy("kind", "key").orderBy("created", "id")
    said = rows.where("kind <> 'episode' and not agent").withColumn("turns", F.when(F.lag("object").over(order).eqNullSafe(F.col("object")), 0).otherwise(1))
    said = said.withColumn("run", F.sum("turns").over(order))
    runs = said.select("id", "kind", "key", "run")
    heads = said.where("turns = 1").select("kind", "key", (F.col("run") - 1).alias("run"), F.col("id").alias("by"))
    stands = runs.join(heads, ["kind", "key", "run"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    return (
        stands.select("id", F.when(F.col("by").isNull(), "standing").otherwise("superseded").alias("state"), "by", F.when(F.col("by").isNotNull(), "key").alias("via"))
        .unionByName(agents.select("id", F.lit("revoked").alias("state"), none("bigint").alias("by"), F.lit("agent_prompt").alias("via")))
        .unionByName(episodes.select("id", F.when(F.col("agent"), "relabelled").otherwise("standing").alias("state"), F.when(F.col("agent"), -F.col("id")).alias("by"), F.when(F.col("agent"), "agent_prompt").alias("via")))
        .unionByName(episodes.where("agent").select((-F.col("id")).alias("id"), F.lit("standing").alias("state"), none("bigint").alias("by"), none("string").alias("via")))
    )


# --- queries over documents: a source is a session; every third text is also an input of one of its tools -----------------------


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session"), text_hash(F.col("text")).alias("hash"), "lang", "text", "n_chars")


def _statements(prompts: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "lang", (F.col("n_chars") % 50).cast("string"))
    kind = F.when(F.col("id") % 4 == 0, "episode").otherwise("decision")
    return prompts.select("id", "session", "hash", kind.alias("kind"), key.alias("key"), F.substring("text", 1, 12).alias("object"), F.col("id").alias("created"))


def x23_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a length to be a task, and whether an agent wrote them."""
    rows = _prompts(spark, sf_dir)
    return by_agents(rows.where("hash is not null"), rows.where("id % 3 = 0").select("session", "hash")).select("id", "session", "agent")


def m12_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger once all is known of who wrote what."""
    rows = _prompts(spark, sf_dir)
    return settle(_statements(rows), rows.where("id % 3 = 0").select("session", "hash"))


QUERIES = {f.__name__: f for f in (x23_authorship, m12_retraction)}

_ROWS = r"""p AS (SELECT doc_id AS id, source AS session, lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'))) AS plain, lang, text, n_chars FROM documents),
h AS (SELECT *, CASE WHEN length(plain) >= 40 THEN md5(plain) END AS hash FROM p),
a AS (SELECT h.*, EXISTS (SELECT 1 FROM h t WHERE t.id % 3 = 0 AND t.hash = h.hash AND t.session <> h.session) AS agent FROM h)"""

ORACLES = {
    "x23_authorship": f"WITH {_ROWS} SELECT id, session, agent FROM a WHERE hash IS NOT NULL",
    "m12_retraction": f"""WITH {_ROWS}, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'episode' ELSE 'decision' END AS kind, lang || ':' || (n_chars % 50) AS key, substr(text, 1, 12) AS object, agent FROM a),
d AS (SELECT x.id, (SELECT min(y.id) FROM s y WHERE y.kind = 'decision' AND NOT y.agent AND y.key = x.key AND y.id > x.id AND y.object <> x.object) AS heir FROM s x WHERE kind = 'decision' AND NOT agent)
SELECT id, CASE WHEN heir IS NULL THEN 'standing' ELSE 'superseded' END AS state, heir AS by, CASE WHEN heir IS NOT NULL THEN 'key' END AS via FROM d
UNION ALL SELECT id, 'revoked', NULL, 'agent_prompt' FROM s WHERE kind = 'decision' AND agent
UNION ALL SELECT id, CASE WHEN agent THEN 'relabelled' ELSE 'standing' END, CASE WHEN agent THEN -id END, CASE WHEN agent THEN 'agent_prompt' END FROM s WHERE kind = 'episode'
UNION ALL SELECT -id, 'standing', NULL, NULL FROM s WHERE kind = 'episode' AND agent""",
}
