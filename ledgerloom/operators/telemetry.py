"""Telemetry and evaluation: delivery ledgers, failure runs, percentiles, tallies and precision over logged events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import duck, redaction, text
from ledgerloom.operators.ledger import statements
from ledgerloom.session import table

PERCENTILES = (0.5, 0.95, 0.99)


def ag1_delivery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By reason: rows, tokens and distinct deliveries."""
    rows = table(spark, sf_dir, "events")
    tokens = F.coalesce(F.sum(F.floor("value").cast("bigint")), F.lit(0))
    return rows.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), tokens.alias("tokens"), F.countDistinct("user_id", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("deliveries"))


def ag2_budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that end in a count are folded: the count is stripped, and n times the events is what was cut."""
    key = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(":gated:budget:"), (F.col("event_id") % 7).cast("string"))).otherwise(F.lit("")))
    counted = table(spark, sf_dir, "events").groupBy(key.alias("key")).agg(F.count("*").alias("events"))
    cut = F.regexp_extract("key", ":budget:([0-9]+)$", 1)
    folded = counted.select(F.regexp_replace("key", ":budget:[0-9]+$", ":budget").alias("reason"), "events", F.when(cut != "", cut.cast("bigint") * F.col("events")).otherwise(0).alias("cut"))
    return folded.groupBy("reason").agg(F.sum("events").alias("events"), F.sum("cut").alias("cut"))


def ag9_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of events in a row that are errors, and the run it stands at now."""
    order = Window.partitionBy("store").orderBy("created", "id")
    rows = statements(spark, sf_dir).withColumn("bad", (F.col("relation") == "error").cast("int"))
    island = F.sum(1 - F.col("bad")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("island", island).groupBy("store", "island").agg(F.sum("bad").alias("run"))
    return runs.groupBy("store").agg(F.max("run").alias("longest"), F.max_by("run", "island").alias("now"))


def ag11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is older than ten days before the newest event is pruned; the count is carried."""
    rows = statements(spark, sf_dir)
    edge = F.broadcast(rows.agg((F.max("created") - 10 * 86_400_000).alias("edge")))
    old = F.col("created") < F.col("edge")
    return rows.join(edge).groupBy("relation").agg(F.sum(F.when(old, 0).otherwise(1)).alias("kept"), F.sum(F.when(old, 1).otherwise(0)).alias("carried"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares=PERCENTILES) -> DataFrame:
    """key, p, at: the value at place min(floor(n * p), n - 1) of each key's sorted values.

    Two passes, both with partial aggregation: counts by whole value tell in which
    whole value each place lies, and only that one's rows are ranked. No key's rows
    ever meet in one task as a whole.
    """
    whole = F.floor(value)
    counts = rows.groupBy(key, whole.alias("whole")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy("whole")
    upto = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    asked = upto.select("*", F.explode(F.array(*map(F.lit, shares))).alias("p")).withColumn("place", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1))
    asked = asked.where("place < upto AND place >= upto - c").select(key, "whole", "p", (F.col("place") - F.col("upto") + F.col("c") + 1).alias("k"))
    near = rows.withColumn("whole", whole).join(asked.select(key, "whole").distinct(), [key, "whole"], "left_semi")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy(key, "whole").orderBy(value)))
    return ranked.join(asked, [key, "whole", "k"]).select(key, "p", F.col(value).alias("at"))


def ag14_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


def ag15_gate_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked and falsely blocked, overall and by pattern."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") >= 0.05).alias("blocked"), (F.col("l_returnflag") == "R").alias("bad"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.rollup(F.col("l_returnflag").alias("pattern")).agg(F.count("*").alias("cases"), count(F.col("blocked") & F.col("bad")).alias("blocked"), count(F.col("blocked") & ~F.col("bad")).alias("falsely"))


def ag16_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule (short texts are of low quality) held against labels: the four counts, precision and recall to four places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") < 600).alias("said"))
    met = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("true")), "doc_id")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = met.agg(count(F.col("said") & F.col("true")).alias("tp"), count(F.col("said") & ~F.col("true")).alias("fp"), count(~F.col("said") & F.col("true")).alias("fn"), count(~F.col("said") & ~F.col("true")).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return t.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def wn5_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event of each user and type, by one aggregation instead of two sorts."""
    at = F.struct("created", "id")
    return statements(spark, sf_dir).groupBy("store", "relation").agg(F.min_by("id", at).alias("first"), F.max_by("id", at).alias("last"))


def wn6_last_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, the 64 latest of them."""
    return statements(spark, sf_dir).groupBy("store").agg(F.max("id").alias("pos")).orderBy(F.desc("pos")).limit(64)


def wn8_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut into turns: each user line opens one; with its first answer's length."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    lines = table(spark, sf_dir, "conversations").withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    answered = F.max((F.col("role") == "assistant").cast("int")) == 1
    turns = lines.where("turn_no > 0").groupBy("conv_id", "turn_no").agg(F.min("turn").alias("first_line"), F.count("*").alias("lines"), answered.alias("answered"), said("assistant").alias("reply"))
    return turns.select("conv_id", F.col("turn_no").cast("bigint").alias("turn_no"), "first_line", "lines", "answered", F.when(F.col("answered"), F.length("reply").cast("bigint")).alias("reply_chars"))


def src3_resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user line of each conversation before the watermark, its last answer."""
    order = Window.partitionBy("conv_id")
    lines = table(spark, sf_dir, "conversations").withColumn("mark", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(order)).where("role = 'user' and turn < mark")
    return lines.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.sha2(F.max_by("text", "turn").cast("binary"), 256).alias("text_sha"))


def src11_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of each conversation that fit whole into 1000 bytes."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    lines = table(spark, sf_dir, "conversations").withColumn("bytes", F.sum(F.octet_length("text") + 1).over(order))
    return lines.where("bytes <= 1000").select("conv_id", "turn", "bytes")


def snk3_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index page: the newest of each kind up to the kind's cap, cut where the whole would pass 200 lines."""
    caps = F.when(F.col("relation").isin("error", "purchase"), 60).when(F.col("relation") == "signup", 40).when(F.col("relation") == "view", 30).otherwise(10)
    rn = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("created"), F.desc("id")))
    kept = statements(spark, sf_dir).withColumn("rn", rn).where(F.col("rn") <= 60).where(F.col("rn") <= caps)
    return kept.orderBy("relation", "rn").limit(200).select("relation", "rn", "id")


def flt7_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates given in ms, µs or ns, or nonsense, made epoch milliseconds or null."""
    rows = statements(spark, sf_dir)
    given = F.when(F.col("id") % 4 == 1, F.col("created") * 1000).when(F.col("id") % 4 == 2, F.col("created") * 1_000_000).when(F.col("id") % 4 == 3, F.col("id")).otherwise(F.col("created"))
    return rows.select("id", text.date_ms(given, F.lit(1_735_689_600_000)).alias("at"))


def flt8_intent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which user lines ask for retrieval: four words or more, after a leading slash command is taken off."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.regexp_replace("text", r"^\s*/[a-z]+\s*", "").alias("t"))
    return asked.select("conv_id", "turn", (F.size(text.words(F.col("t"))) >= 4).alias("retrieves"))


def x15_topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.topic_words(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("words"))


def shared_words(lines: DataFrame) -> DataFrame:
    """(store, id, other, shared) of lines (store, id, words): pairs of a store that share two words or more, and half of the smaller set.

    Prefix filter: a pair that shares half of the smaller set shares one of each set's
    first words in any one order; taken is the order of rarity in the store, so that
    lines meet by rare words alone and not by those that most lines hold.
    """
    word = lines.select("store", "id", F.size("words").alias("n"), F.explode("words").alias("word"))
    held = word.groupBy("store", "word").agg(F.count("*").alias("df"))
    listed = word.join(held, ["store", "word"]).groupBy("store", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by_df"))
    # sharing k of n words leaves n - k that may differ: one of the first n - k + 1 is shared
    needed = F.greatest(F.lit(2), F.ceil(F.lit(0.5) * F.col("n"))).cast("int")
    first = listed.where("n >= 2").select("store", "id", "n", F.explode(F.slice("by_df", F.lit(1), F.col("n") - needed + 1)).alias("w")).select("store", "id", "n", "w.word")
    # of a pair, the smaller set needs half of its own words; the larger may hold them anywhere
    whole = word.where("n >= 2").select("store", F.col("id").alias("with"), F.col("n").alias("m"), "word")
    pairs = first.join(whole, ["store", "word"]).where("id != with and (n < m or n = m and id < with)").select("store", "id", "with").distinct()
    sets = lines.select("store", "id", "words")
    met = pairs.join(sets, ["store", "id"]).join(sets.select("store", F.col("id").alias("with"), F.col("words").alias("others")), ["store", "with"])
    shared = F.size(F.array_intersect("words", "others"))
    met = met.withColumn("shared", shared.cast("bigint")).where((F.col("shared") >= 2) & (F.col("shared") >= 0.5 * F.size("words")))
    return met.select("store", F.least("id", "with").alias("id"), F.greatest("id", "with").alias("other"), "shared")


def jn10_shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source that share topic words, edited copies of one another for the most part."""
    return shared_words(table(spark, sf_dir, "documents").select(F.col("source").alias("store"), F.col("doc_id").alias("id"), text.topic_words(F.col("text"), 400).alias("words")))


def x1_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses, network addresses, telephone numbers and keys are masked, in that order; how many texts change, and to what."""
    t = F.col("text")
    for pattern, mask in MASKS:
        t = F.regexp_replace(t, pattern, mask)
    changed = table(spark, sf_dir, "documents").select("doc_id", "text", t.alias("clean")).where("text <> clean")
    return changed.select("doc_id", F.sha2(F.col("clean").cast("binary"), 256).alias("sha"))


MASKS = [
    (r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[mail]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ip]"),
    (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[phone]"),
    (r"(AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{8,}", "[key]"),
]


def x1_all_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that redaction of secrets and homes, and then the masks, change; and to what."""
    t = redaction.redact(F.col("text"))
    for pattern, mask in MASKS:
        t = F.regexp_replace(t, pattern, mask)
    changed = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text", t.alias("clean")).where("text <> clean")
    return changed.select("doc_id", F.sha2(F.col("clean").cast("binary"), 256).alias("sha"))


def e4_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each language and source, by a hash of the id."""
    h = F.md5(F.concat(F.lit("s1:"), F.col("doc_id").cast("string")).cast("binary"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", h.alias("h"))
    rn = F.row_number().over(Window.partitionBy("lang", "source").orderBy("h", "doc_id"))
    return rows.withColumn("rn", rn).where("rn <= 5").select("doc_id", "lang", "source", "rn")


def e9_matched_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irrelevant control: the first forty by a shuffle of ids, as many as fit into 4000 tokens."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.col("doc_id") + 17, F.lit(101)).alias("o"), text.tokens_estimate(F.col("text")).alias("t"))
    used = F.sum("t").over(Window.orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.orderBy("o", "doc_id").limit(40).withColumn("used", used).where("used <= 4000").select("doc_id", "t", "used")


def g5_kinds_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs by what their path ends in."""
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    kind = F.when(path.rlike(r"\.(json|ya?ml|toml|lock)$"), "config").when(path.rlike(r"\.(html?|md)$"), "document").when(path.endswith("/"), "folder").otherwise("other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(path).alias("paths"))


def r12_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some group of cues holds as a whole: user, and event type as group; an event is a cue that holds from 5 on."""
    groups = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.bool_and(F.col("value") >= 0.5).alias("fires"), F.count("*").alias("cues"))
    return groups.where("fires").groupBy("user_id").agg(F.count("*").alias("groups"), F.sum("cues").alias("cues"))


def st9_delivery_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row for each delivered id; a delivery's tokens are split by whole division."""
    ids = F.sequence(F.lit(1).cast("bigint"), F.col("event_id") % 4)
    rows = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("bigint").alias("tokens"), F.when(F.col("event_id") % 4 > 0, ids).alias("ids"))
    return rows.select("event_id", F.explode_outer("ids").alias("record"), F.when(F.col("ids").isNull(), F.col("tokens")).otherwise(F.expr("tokens div size(ids)")).alias("tokens"))


_S = r"""s AS (SELECT event_id AS id, user_id AS store, event_type AS relation, regexp_extract(props, '"k": ?([0-9]+)', 1) AS object, epoch_us(ts) // 1000 AS created, value FROM events)"""


def _mask_sql(t: str = "text") -> str:
    for pattern, mask in MASKS:
        t = f"regexp_replace({t}, '{pattern}', '{mask}', 'g')"
    return t


_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '\s+'), lambda w: w <> '')"

ORACLES = {
    "ag1_delivery_ledger": "SELECT event_type AS reason, count(*) AS n, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS tokens, count(DISTINCT (user_id, epoch_us(ts) // 3600000000)) AS deliveries FROM events GROUP BY 1",
    "ag2_budget_fold": """WITH c AS (SELECT event_type || CASE WHEN event_id % 3 = 0 THEN ':gated:budget:' || (event_id % 7) ELSE '' END AS key, count(*) AS events FROM events GROUP BY 1)
SELECT regexp_replace(key, ':budget:[0-9]+$', ':budget') AS reason, CAST(sum(events) AS BIGINT) AS events, CAST(sum(coalesce(TRY_CAST(regexp_extract(key, ':budget:([0-9]+)$', 1) AS BIGINT), 0) * events) AS BIGINT) AS cut FROM c GROUP BY 1""",
    "ag9_failure_runs": f"""WITH {_S}, i AS (SELECT store, CAST(relation = 'error' AS INTEGER) AS bad, sum(CAST(relation <> 'error' AS INTEGER)) OVER (PARTITION BY store ORDER BY created, id) AS island FROM s),
r AS (SELECT store, island, CAST(sum(bad) AS BIGINT) AS run FROM i GROUP BY ALL) SELECT store, max(run) AS longest, max_by(run, island) AS now FROM r GROUP BY store""",
    "ag11_retention": f"WITH {_S} SELECT relation, count(*) FILTER (created >= edge) AS kept, count(*) FILTER (created < edge) AS carried FROM s, (SELECT max(created) - 864000000 AS edge FROM s) GROUP BY relation",
    "ag14_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(p AS DOUBLE) AS p, value AS at FROM r, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS p) WHERE k = least(CAST(floor(n * p) AS BIGINT), n - 1)""",
    "ag15_gate_tallies": "SELECT l_returnflag AS pattern, count(*) AS cases, count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') AS blocked, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') AS falsely FROM (SELECT l_returnflag, l_discount FROM lineitem) GROUP BY ROLLUP (l_returnflag)",
    "ag16_precision_recall": """WITH m AS (SELECT length(text) < 600 AS said, quality = 0 AS t FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (said AND t) AS tp, count(*) FILTER (said AND NOT t) AS fp, count(*) FILTER (NOT said AND t) AS fn, count(*) FILTER (NOT said AND NOT t) AS tn FROM m)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM c""",
    "wn5_first_last": f"WITH {_S} SELECT store, relation, min_by(id, created * 1000000 + id) AS first, max_by(id, created * 1000000 + id) AS last FROM s GROUP BY ALL",
    "wn6_last_mentions": f"WITH {_S} SELECT store, max(id) AS pos FROM s GROUP BY store ORDER BY pos DESC LIMIT 64",
    "wn8_turns": """WITH l AS (SELECT *, sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)
SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, min(turn) AS first_line, count(*) AS lines, bool_or(role = 'assistant') AS answered, length(min_by(text, turn) FILTER (role = 'assistant')) AS reply_chars FROM l WHERE turn_no > 0 GROUP BY conv_id, turn_no""",
    "src3_resume_state": "SELECT conv_id, max(turn) AS turn, sha256(max_by(text, turn)) AS text_sha FROM conversations c WHERE role = 'user' AND turn < (SELECT max(turn) FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant') GROUP BY 1",
    "src11_tail": "SELECT conv_id, turn, bytes FROM (SELECT conv_id, turn, CAST(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS bytes FROM conversations) WHERE bytes <= 1000",
    "snk3_index": f"""WITH {_S} SELECT relation, rn, id FROM (SELECT relation, id, CAST(row_number() OVER (PARTITION BY relation ORDER BY created DESC, id DESC) AS INTEGER) AS rn FROM s)
WHERE rn <= CASE WHEN relation IN ('error', 'purchase') THEN 60 WHEN relation = 'signup' THEN 40 WHEN relation = 'view' THEN 30 ELSE 10 END ORDER BY relation, rn LIMIT 200""",
    "flt7_dates": f"""WITH {_S}, g0 AS (SELECT id, CASE id % 4 WHEN 1 THEN created * 1000 WHEN 2 THEN created * 1000000 WHEN 3 THEN id ELSE created END AS v FROM s),
g1 AS (SELECT id, CASE WHEN v > 1735776000000 THEN v // 1000 ELSE v END AS v FROM g0), g2 AS (SELECT id, CASE WHEN v > 1735776000000 THEN v // 1000 ELSE v END AS v FROM g1), g3 AS (SELECT id, CASE WHEN v > 1735776000000 THEN v // 1000 ELSE v END AS v FROM g2)
SELECT id, CASE WHEN v BETWEEN 946684800000 AND 1735776000000 THEN v END AS at FROM g3""",
    "flt8_intent_gate": "SELECT conv_id, turn, len(" + _WORDS.format(r"regexp_replace(text, '^\s*/[a-z]+\s*', '')") + ") >= 4 AS retrieves FROM conversations WHERE role = 'user'",
    "x15_topic_words": f"SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, array_to_string(w, ' ') AS words FROM (SELECT conv_id, turn, {duck.topic_words('text')} AS w FROM conversations WHERE role = 'user')",
    "jn10_shared_words": f"""WITH l AS (SELECT source AS store, doc_id AS id, {duck.topic_words('text', 400)} AS w FROM documents)
SELECT store, id, other, shared FROM (SELECT a.store, a.id, b.id AS other, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS shared, least(len(a.w), len(b.w)) AS small FROM l a JOIN l b ON a.store = b.store AND a.id < b.id) WHERE shared >= 2 AND shared >= 0.5 * small""",
    "x1_all_shapes": f"SELECT doc_id, sha256(clean) AS sha FROM (SELECT doc_id, text, {_mask_sql(redaction.redact_sql('text'))} AS clean FROM documents) WHERE text <> clean",
    "x1_redaction": f"SELECT doc_id, sha256(clean) AS sha FROM (SELECT doc_id, text, {_mask_sql()} AS clean FROM documents) WHERE text <> clean",
    "e4_stratified_sample": "SELECT doc_id, lang, source, rn FROM (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY md5('s1:' || doc_id), doc_id) AS INTEGER) AS rn FROM documents) WHERE rn <= 5",
    "e9_matched_control": """WITH f AS (SELECT doc_id, (doc_id + 17) % 101 AS o, CAST(ceil(length(text) / 3.0) AS BIGINT) AS t FROM documents ORDER BY o, doc_id LIMIT 40)
SELECT doc_id, t, used FROM (SELECT *, CAST(sum(t) OVER (ORDER BY o, doc_id) AS BIGINT) AS used FROM f) WHERE used <= 4000""",
    "g5_kinds_of_files": r"""WITH p AS (SELECT regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT CASE WHEN regexp_matches(path, '\.(json|ya?ml|toml|lock)$') THEN 'config' WHEN regexp_matches(path, '\.(html?|md)$') THEN 'document' WHEN ends_with(path, '/') THEN 'folder' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT path) AS paths FROM p GROUP BY 1""",
    "r12_cues": "SELECT user_id, count(*) AS groups, CAST(sum(cues) AS BIGINT) AS cues FROM (SELECT user_id, event_type, count(*) AS cues FROM events GROUP BY ALL HAVING bool_and(value >= 0.5)) GROUP BY 1",
    "st9_delivery_fold": """SELECT event_id, CAST(unnest(CASE WHEN event_id % 4 = 0 THEN [NULL] ELSE range(1, event_id % 4 + 1) END) AS BIGINT) AS record, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) // (event_id % 4) END AS tokens FROM events""",
}
#: x1_all_shapes has no SQL: whether an opaque token is a secret depends on its entropy.
QUERIES = {name: globals()[name] for name in [*ORACLES, "x1_all_shapes"]}
