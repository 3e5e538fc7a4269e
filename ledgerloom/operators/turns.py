"""Turns that are still open: held until they are over, released when nothing answers, grown when the answer comes after all.

Lines of a session (``session, at, begin, end, role, text``: milliseconds, byte
offsets, and user, assistant, tool or end) make turns, each begun by a user's line. A
turn is over when the next one begins, when its session ends, or after ``IDLE_MS``
without a line. What is over is read once:

* ``stored``: it has been answered, or the next turn shows that it won't be;
* ``released``: it ended unanswered, as an answer may never come;
* ``grown``: lines came after it had been read; it is read again as a whole, and its
  rows take the place (``replaces``) of what the earlier reading wrote;
* ``held``: not over yet at the clock.

``streaming.turns`` does the same with timers; both give the same rows for the same
lines, however these are cut into batches. Here, a session's lines are windows in
order, which Spark sorts on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import table

IDLE_MS = 3_600_000
STUCK_MS, GONE_MS = 120_000, 3_600_000


def held_turns(lines: DataFrame, now: Column, idle_ms: int = IDLE_MS) -> DataFrame:
    """session, begin, end, answers, what, closed (prompt, end, idle; null while held) and replaces (the end of the reading that this one follows)."""
    order = Window.partitionBy("session").orderBy("begin")
    later, following = F.lead("at").over(order), F.lead("role").over(order)
    breaks = F.when(F.col("role") == "end", "end").when(F.coalesce(later, now) - F.col("at") >= idle_ms, "idle")
    rows = lines.select("session", "at", "begin", "end", "role", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order).alias("turn"), breaks.alias("breaks"), following.alias("following"))
    within = Window.partitionBy("session", "turn").orderBy("begin")
    before = F.count("breaks").over(within.rowsBetween(Window.unboundedPreceding, -1))
    closed = F.coalesce(F.col("breaks"), F.when(F.col("following") == "user", "prompt"))
    rows = rows.where("turn > 0").withColumn("reading", before).withColumn("closed", closed)
    one = rows.groupBy("session", "turn", "reading").agg(
        F.max(F.when(F.col("role") != "end", F.col("end"))).alias("end"),
        F.min(F.when(F.col("role") == "user", F.col("begin"))).alias("begin"),
        F.count(F.when(F.col("role").isin("assistant", "tool"), 1)).alias("answers"),
        F.max_by("closed", "begin").alias("closed"),
    )
    readings = Window.partitionBy("session", "turn").orderBy("reading")
    upto = readings.rowsBetween(Window.unboundedPreceding, 0)
    out = one.where("end is not null").select("session", F.first("begin").over(readings).alias("begin"), "end", F.sum("answers").over(upto).alias("answers"), "closed", F.lag("end").over(readings).alias("replaces"))
    what = F.when(F.col("closed").isNull(), "held").when(F.col("replaces").isNotNull(), "grown").when((F.col("answers") > 0) | (F.col("closed") == "prompt"), "stored").otherwise("released")
    return out.select("session", "begin", "end", "answers", what.alias("what"), "closed", "replaces")


def answered(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """episodes (id, session, ref) with by and via: those of a reading that has grown are retired by the head episode of the reading that followed it."""
    head = episodes.groupBy("session", "ref").agg(F.min("id").alias("by"))
    grown = turns.where("what = 'grown'").select("session", F.col("end").alias("ref"), F.col("replaces").alias("old"))
    heirs = head.join(grown, ["session", "ref"]).select("session", F.col("old").alias("ref"), "by")
    return episodes.join(heirs, ["session", "ref"], "left").withColumn("via", F.when(F.col("by").isNotNull(), "answered"))


def stuck_runs(lines: DataFrame, clocks: DataFrame) -> DataFrame:
    """(clock, hook, session, started_at): runs that at a clock have been open for STUCK_MS or more, and under GONE_MS. lines: hook, session, at, ok (null: a start)."""
    order = Window.partitionBy("hook", "session").orderBy("at")
    starts = lines.select("hook", "session", "ok", F.col("at").alias("started_at"), F.lead("at").over(order).alias("next_at")).where("ok is null")
    # a clock can only see starts of its hour and the one before
    by_hour = clocks.select("clock", F.explode(F.array(F.expr(f"clock div {GONE_MS}"), F.expr(f"clock div {GONE_MS} - 1"))).alias("hour"))
    at = starts.withColumn("hour", F.expr(f"started_at div {GONE_MS}")).join(by_hour, "hour")
    age = F.col("clock") - F.col("started_at")
    return at.where((age >= STUCK_MS) & (age < GONE_MS) & (F.col("next_at").isNull() | (F.col("next_at") > F.col("clock")))).select("clock", "hook", "session", "started_at")


# --- queries over events: each user is a session ------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and signups are prompts, errors end a session, the rest answers; the text is 100 bytes."""
    kind = F.col("event_type")
    role = F.when(kind.isin("view", "signup"), "user").when(kind == "error", "end").otherwise("assistant")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") * 100).alias("begin"), (F.col("event_id") * 100 + 100).alias("end"), role.alias("role"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    now = F.broadcast(lines.agg(F.max("at").alias("now")))  # one row
    return held_turns(lines.join(now), F.col("now"), 6 * IDLE_MS)


def st5_held_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of every turn; idle after six hours, as these sessions are slow."""
    return _turns(spark, sf_dir)


def m15_grown_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes, two for each reading that has been answered and else one, and which of them a later reading retires."""
    turns = _turns(spark, sf_dir)
    parts = F.explode(F.sequence(F.lit(0), F.least(F.col("answers"), F.lit(1)).cast("int")))
    episodes = turns.where("what <> 'held'").select("session", F.col("end").alias("ref"), parts.alias("part")).select((F.col("ref") + F.col("part")).alias("id"), "session", "ref")
    return answered(episodes, turns).select("id", "session", "ref", "by", "via")


def st4_stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the end of each hour of the log: runs open for two minutes to an hour. Clicks and views start a run, other events finish it."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("hook"), F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.when(~kind.isin("click", "view"), F.when(kind == "error", 0).otherwise(1)).alias("ok"))
    ends = rows.agg(F.expr(f"min(at) div {GONE_MS}").alias("a"), F.expr(f"max(at) div {GONE_MS}").alias("b"))
    clocks = ends.select(F.explode(F.sequence("a", "b")).alias("hour")).select((F.col("hour") * GONE_MS + GONE_MS).alias("clock"))
    return stuck_runs(rows, clocks)


QUERIES = {f.__name__: f for f in (st5_held_turns, m15_grown_turns, st4_stuck_runs)}

_LINES = """l AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS tm, event_id AS i, event_id * 100 AS b, event_id * 100 + 100 AS e, CASE WHEN event_type IN ('view', 'signup') THEN 'user' WHEN event_type = 'error' THEN 'end' ELSE 'assistant' END AS role FROM events),
c AS (SELECT max(tm) AS now FROM l),
s AS (SELECT l.*, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS turn, lead(role) OVER w AS following,
  CASE WHEN role = 'end' THEN 'end' WHEN coalesce(lead(tm) OVER w, now) - tm >= 21600000 THEN 'idle' END AS breaks FROM l, c WINDOW w AS (PARTITION BY session ORDER BY b)),
r AS (SELECT *, count(breaks) OVER (PARTITION BY session, turn ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reading, coalesce(breaks, CASE WHEN following = 'user' THEN 'prompt' END) AS shut FROM s WHERE turn > 0),
g AS (SELECT session, turn, reading, max(e) FILTER (role <> 'end') AS e, min(b) FILTER (role = 'user') AS b, count(*) FILTER (role = 'assistant') AS n, arg_max(coalesce(shut, 'none'), b) AS shut FROM r GROUP BY ALL),
t AS (SELECT session, first_value(b) OVER w AS "begin", e AS "end", CAST(sum(n) OVER w AS BIGINT) AS answers, nullif(shut, 'none') AS closed, lag(e) OVER w AS replaces FROM g WHERE e IS NOT NULL WINDOW w AS (PARTITION BY session, turn ORDER BY reading)),
turns AS (SELECT session, "begin", "end", answers, CASE WHEN closed IS NULL THEN 'held' WHEN replaces IS NOT NULL THEN 'grown' WHEN answers > 0 OR closed = 'prompt' THEN 'stored' ELSE 'released' END AS what, closed, replaces FROM t)"""

ORACLES = {
    "st5_held_turns": f"WITH {_LINES} SELECT * FROM turns",
    "m15_grown_turns": f"""WITH {_LINES}, ep AS (SELECT session, "end" AS ref, "end" + unnest(range(CASE WHEN answers > 0 THEN 2 ELSE 1 END)) AS id FROM turns WHERE what <> 'held'),
h AS (SELECT g.session, g.replaces AS ref, min(ep.id) AS heir FROM turns g JOIN ep ON ep.session = g.session AND ep.ref = g."end" WHERE g.what = 'grown' GROUP BY ALL)
SELECT ep.id, ep.session, ep.ref, h.heir AS by, CASE WHEN h.heir IS NOT NULL THEN 'answered' END AS via FROM ep LEFT JOIN h ON h.session = ep.session AND h.ref = ep.ref""",
    "st4_stuck_runs": """WITH r AS (SELECT user_id % 3 AS hook, user_id AS session, epoch_us(ts) // 1000 AS tm, event_type IN ('click', 'view') AS begins FROM events),
s AS (SELECT *, lead(tm) OVER (PARTITION BY hook, session ORDER BY tm) AS next_at FROM r),
c AS (SELECT unnest(range(min(tm) // 3600000, max(tm) // 3600000 + 1)) * 3600000 + 3600000 AS clock FROM r)
SELECT clock, hook, session, tm AS started_at FROM s JOIN c ON clock - tm BETWEEN 120000 AND 3599999 WHERE begins AND (next_at IS NULL OR next_at > clock)""",
}
