"""Recall over what stands: exclusions, twins, floors with survivors, side matches, cues, merging, catalogue, rationale and replays.

Documents are records here: an id names its kind, trust, turn and heir by rule
(``told``), so that every state that recall has to respect occurs. All filters come
before ranks are read: a row that may not be served takes no place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import duck, text
from ledgerloom.operators import retrieval as rt
from ledgerloom.operators.ledger import _H, _S, heirs, statements
from ledgerloom.session import saved, table

RRF, SHOWN, SLOTS, LIMIT = 60.0, 64, 120, 10


def kind_of(i: Column) -> Column:
    d = i % 10
    return F.when(d == 0, "invariant").when(d == 1, "correction").when(d.isin(2, 3, 4), "decision").when(d == 5, "observation").otherwise("episode")


def told(docs: DataFrame) -> DataFrame:
    """docs (id, subject, ...) with kind, trust, turn and heir (null while it stands); subjects of src1... are commit logs."""
    i = F.col("id")
    return docs.select("*", kind_of(i).alias("kind"), (4 - i % 4).alias("trust"), F.floor(i / 3).alias("turn"), F.when(i % 7 == 3, i + 1).alias("heir"), F.col("subject").startswith("src1").alias("is_log"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rt.records(spark, sf_dir).select("id", "subject"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25(spark, rt.records(spark, sf_dir), rt.prompts(spark, sf_dir))


def standing(rows: DataFrame) -> DataFrame:
    return rows.where("heir is null and not is_log")


def jn1_served_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of what stands and is no commit log."""
    return rt.top(found(spark, sf_dir).join(standing(states(spark, sf_dir)), "id")).select("prompt_id", "rank", "id", "score")


def r7_stale_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, without episodes whose turn has a retired decision, invariant or correction."""
    s = states(spark, sf_dir)
    stale = s.where("heir is not null and kind in ('decision', 'invariant', 'correction')").select("turn", F.lit("episode").alias("kind")).distinct()
    return rt.top(found(spark, sf_dir).join(standing(s).join(stale, ["turn", "kind"], "left_anti"), "id")).select("prompt_id", "rank", "id", "kind")


def twin_free(s: DataFrame) -> DataFrame:
    """What stands, without episodes whose turn has a retired decision, invariant or correction."""
    stale = s.where("heir is not null and kind in ('decision', 'invariant', 'correction')").select("turn", F.lit("episode").alias("kind")).distinct()
    return standing(s).join(stale, ["turn", "kind"], "left_anti")


def read(hits: DataFrame, served: DataFrame, given: Column, limit: int = LIMIT) -> DataFrame:
    """The rows of a search (prompt_id, id, score, matched) that recall reads, in order, with best and newest: limit rows that were not given before and, with all rows read, the next such row."""
    order = Window.partitionBy("prompt_id").orderBy("score", F.desc("id"))
    fresh = (~given).cast("int")
    rows = hits.join(served, "id").withColumn("fresh", fresh).withColumn("upto", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") - F.col("fresh") <= limit)
    every = Window.partitionBy("prompt_id")
    return rows.withColumn("best", F.min("score").over(every)).withColumn("newest", F.max("id").over(every)).where((F.col("fresh") == 1) & (F.col("upto") <= limit))


def floors(rows: DataFrame, need: DataFrame) -> DataFrame:
    """rows of read with half, enough and side: whether each is over the floor of the best match, over the floor of words (need: prompt_id, need), and has a place beside the rules.

    ``kept`` is the newest row, where it is strictly newer than the best of these rows: no floor cuts it.
    """
    every, order = Window.partitionBy("prompt_id"), Window.partitionBy("prompt_id").orderBy("score", F.desc("id"))
    lead = F.first("id").over(order)
    rows = rows.join(need, "prompt_id").withColumn("kept", (F.col("id") == F.col("newest")) & (F.col("id") > lead))
    rows = rows.withColumn("half", (F.col("score") <= F.col("best") * 0.5) | (F.col("trust") >= 3) | F.col("kept"))
    words = F.col("half") & ((F.col("need") <= 1) | (F.col("matched") >= F.col("need")) | F.col("kept"))
    rule = F.col("kind").isin("invariant", "correction")
    weakest = F.max(F.when(words, F.col("score"))).over(every)
    rows = rows.withColumn("enough", words | (F.col("half") & rule & F.coalesce(F.col("score") <= weakest, F.lit(False))))
    other = F.col("enough") & ~rule & ~F.col("kept")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("other", other)
    seen = F.min(F.when(F.col("other"), F.col("place"))).over(Window.partitionBy("prompt_id", "turn"))
    rows = rows.withColumn("seen", F.when(F.col("other"), seen))
    nth = F.dense_rank().over(every.orderBy(F.col("seen").asc_nulls_last()))
    return rows.withColumn("side", F.col("enough") & (~F.col("other") | (nth <= 2)))


def floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth record was given before."""
    hits, chosen = rt.search(spark, rt.records(spark, sf_dir), rt.prompts(spark, sf_dir))
    need = chosen.groupBy("prompt_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 3)).cast("bigint").alias("need"))
    return floors(read(hits, twin_free(states(spark, sf_dir)), F.col("id") % 4 == 0), need)


def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, id, kind, subject, turn, rank): recall as a whole, from what stands to the places beside the rules."""
    order = Window.partitionBy("prompt_id").orderBy("place")
    return floored(spark, sf_dir).where("side").select("prompt_id", "id", "kind", "subject", "turn", F.row_number().over(order).alias("rank"))


def r8_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows that were not delivered yet; the best score and the newest id are those of all rows read, the eleventh such row included."""
    return read(found(spark, sf_dir), twin_free(states(spark, sf_dir)), F.col("id") % 4 == 0).select("prompt_id", "id", "score", "best", "newest")


def r9_floor_with_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as strong as the best, trusted (3 and more), or the newest where newer than the best row."""
    return floored(spark, sf_dir).where("half").select("prompt_id", "id", "trust", "kept")


def r10_floor_with_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these, what matches a third of the prompt's terms, or is the newest; invariants and corrections also where as strong as the weakest of them."""
    return floored(spark, sf_dir).where("enough").select("prompt_id", "id", "kind", "matched", "need")


def r11_side_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these, invariants, corrections and the newest stay; of the rest, what belongs to the first two turns that appear."""
    return floored(spark, sf_dir).where("side").select("prompt_id", "id", "kind", "kept", F.row_number().over(Window.partitionBy("prompt_id").orderBy("place")).alias("rank"))


def r13_cue_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants are told at a session's start and after its compaction, corrections at its start."""
    cues = F.when(F.col("kind") == "invariant", F.array(F.lit("session_start"), F.lit("post_compact"))).when(F.col("kind") == "correction", F.array(F.lit("session_start")))
    return standing(states(spark, sf_dir)).select("id", F.explode(cues).alias("event"))


def jn3_event_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands and is told after a compaction, newest first: 64, and how many more there are."""
    cues = r13_cue_derivation(spark, sf_dir).where("event = 'post_compact'").select("id")
    total = F.broadcast(cues.agg(F.greatest(F.count("*") - SHOWN, F.lit(0)).alias("dropped")))
    return cues.orderBy(F.desc("id")).limit(SHOWN).join(total)


def r12_cue_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records some group of whose cues holds as a whole: a keyword said, a time that has come, an event that is now; what has a cool-down never holds."""
    s = statements(spark, sf_dir)
    kind = F.when(F.col("id") % 40 == 3, "cooldown").when(F.col("id") % 3 == 0, "keyword").when(F.col("id") % 3 == 1, "after").otherwise("event")
    holds = F.when(F.col("cue") == "keyword", F.col("object").cast("int") % 5 < 4).when(F.col("cue") == "after", F.col("created") <= 1_705_000_000_000).when(F.col("cue") == "event", F.col("relation").isin("error", "view", "click")).otherwise(F.lit(False))
    cues = s.withColumn("cue", kind).select(F.col("store").alias("record"), (F.col("id") % 50).alias("grp"), holds.alias("holds"))
    fired = cues.groupBy("record", "grp").agg(F.bool_and("holds").alias("fires"), F.count("*").alias("cues")).where("fires")
    return fired.groupBy("record").agg(F.count("*").alias("groups"), F.sum("cues").alias("cues"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, id, fused, lists): reciprocal ranks of what is recalled, and of the newest standing records of the sources that it names (three each)."""
    hits = saved(spark, recalled(spark, sf_dir), "recalled")
    named = hits.select("prompt_id", "subject").distinct()
    newest = Window.partitionBy("subject").orderBy(F.desc("id"))
    recent = standing(states(spark, sf_dir)).select("id", "subject").withColumn("rn", F.row_number().over(newest)).where("rn <= 3")
    cue = named.join(recent, "subject").select("prompt_id", "id", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("id"))).alias("rank"))
    lists = hits.select("prompt_id", "id", "rank").unionByName(cue)
    return lists.groupBy("prompt_id", "id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("fused"), F.count("*").alias("lists"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fused with place: rules and corrections first, then by score, the newest first among equals. That is the order of a prompt; events take turns by kind (wn2)."""
    rows = fused(spark, sf_dir).join(states(spark, sf_dir).select("id", "kind", "turn"), "id")
    rule = F.when(F.col("kind").isin("invariant", "correction"), 0).otherwise(1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("prompt_id").orderBy(rule, F.desc("fused"), F.desc("id"))))


def r14_cue_and_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


def r15_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("prompt_id", "place", "id", "kind")


def r16_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each turn, and one for what says the same; those that fit into 700 tokens in order, each counted as 200 at most, skipping those that don't."""
    body = F.col("body")
    docs = rt.records(spark, sf_dir).select("id", F.md5(body.cast("binary")).alias("said"), F.least(text.tokens_estimate(body), F.lit(200)).cast("bigint").alias("cost"))
    rows = merged(spark, sf_dir).join(docs, "id")
    first = lambda by: F.row_number().over(Window.partitionBy("prompt_id", by).orderBy("place"))
    once = rows.withColumn("n", first("turn")).where("n = 1").withColumn("n", first("said")).where("n = 1")
    return rt.greedy_pack(once, "prompt_id", "place", "cost", "id", 700)


def r17_block_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks may be shown: none with a role's marker at a line's start; an episode's single label of the answer is taken off first."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit(": "))).otherwise(""), "text").alias("block"))
    kept = F.regexp_replace("block", r"^assistant: ", "")
    return lines.select("conv_id", "turn", (~kept.rlike(r"(?m)^(system|assistant|user): ") & ~F.lower(kept).contains("ignore previous")).alias("ok"))


def r20_show_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for, newest first: shown, over budget (after 64 that stand), retired, or unknown."""
    asked = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).alias("id")).distinct()
    met = asked.join(states(spark, sf_dir).select("id", "heir", F.lit(True).alias("known")), "id", "left")
    stands = met.where("known and heir is null").select("id").orderBy(F.desc("id")).limit(SHOWN).withColumn("shown", F.lit(True))
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("heir").isNotNull(), "retired").when(F.col("shown"), "shown").otherwise("over budget")
    return met.join(stands, "id", "left").select("id", state.alias("state"))


def r21_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of what stands: observations take places but are not listed, a first line is listed once, rules come before decisions and episodes."""
    line = F.lower(F.substring(F.substring_index("body", "\n", 1), 1, 160))
    docs = standing(told(rt.records(spark, sf_dir))).select("id", "kind", line.alias("line"))
    page = docs.orderBy(F.desc("id")).limit(SLOTS).where("kind <> 'observation'")
    once = page.withColumn("n", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("id")))).where("n = 1")
    part = F.when(F.col("kind").isin("invariant", "correction"), 0).when(F.col("kind") == "decision", 1).otherwise(2)
    return once.select("id", "kind", F.row_number().over(Window.orderBy(part, F.desc("id"))).alias("place"))  # a page is 120 rows at most


def r23_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to why: by score, preferred kinds, then newest; 20."""
    hits = found(spark, sf_dir).join(states(spark, sf_dir).select("id", "kind"), "id")
    order = Window.partitionBy("prompt_id").orderBy("score", F.when(F.col("kind").isin("decision", "correction"), 0).otherwise(1), F.desc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("prompt_id", "rank", "id", "kind")


def r25_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's rows with logs sunk, and whether some standing row of trust 2 or more is no log."""
    rows = rt.top(found(spark, sf_dir)).join(states(spark, sf_dir), "id")
    order = Window.partitionBy("prompt_id").orderBy(F.col("is_log").cast("int"), "rank")
    enough = F.max(F.expr("heir is null and not is_log and trust >= 2")).over(Window.partitionBy("prompt_id"))
    return rows.select("prompt_id", F.row_number().over(order).alias("place"), "id", "heir", enough.alias("sufficient"))


def r30_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each prompt of two long terms or more: the newest record that holds all of its six longest."""
    longest = Window.partitionBy("prompt_id").orderBy(F.desc(F.octet_length("term")), "term")
    terms = rt.prompt_terms(rt.prompts(spark, sf_dir)).where(F.octet_length("term") >= 4).withColumn("rn", F.row_number().over(longest)).where("rn <= 6")
    wanted = terms.groupBy("prompt_id").agg(F.count("*").alias("k")).where("k >= 2")
    hits = rt.index(spark, rt.records(spark, sf_dir), terms).where("term <> ''").join(terms, "term").groupBy("prompt_id", "id").agg(F.count("*").alias("k"))
    return hits.join(wanted, ["prompt_id", "k"]).groupBy("prompt_id").agg(F.max("id").alias("id"), F.max("k").alias("k"))


def jn11_shortest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each prompt's rarest term, the shortest record that holds it as a token, the first such."""
    rare = rt.search(spark, rt.records(spark, sf_dir), rt.prompts(spark, sf_dir))[1].where("rn = 1").select("prompt_id", "term")
    hits = rt.index(spark, rt.records(spark, sf_dir), rare).where("term <> ''")
    size = rt.records(spark, sf_dir).select("id", F.length("body").alias("chars"))
    return hits.join(rare, "term").join(size, "id").groupBy("prompt_id", "term").agg(F.min_by("id", F.struct("chars", "id")).alias("id"))


def g7_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selected term that more than three sources hold is vocabulary and proves nothing."""
    terms = rt.search(spark, rt.records(spark, sf_dir), rt.prompts(spark, sf_dir))[1].select("term").distinct()
    hits = rt.index(spark, rt.records(spark, sf_dir), terms).where("term <> ''").join(rt.records(spark, sf_dir).select("id", "subject"), "id")
    return hits.groupBy("term").agg(F.count_distinct("subject").alias("files")).select("term", "files", (F.col("files") > 3).alias("vocabulary"))


def e6_known_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record whose id leaves 7 by 50 is asked for by its first 160 characters: the place at which it comes, the share within ten, and the mean reciprocal place."""
    docs = rt.records(spark, sf_dir)
    asked = docs.where("id % 50 = 7").select(F.col("id").alias("prompt_id"), F.col("object").alias("prompt"))
    hits = rt.top(rt.bm25(spark, docs, asked)).where("id = prompt_id").select("prompt_id", "rank")
    met = asked.select("prompt_id").join(hits, "prompt_id", "left")
    return met.agg(F.count("*").alias("asked"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr_at_10"))


def e2_delivery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt would have been given when only the first part of the corpus was there: rows, labelled ones, harmful ones, tokens."""
    docs = rt.records(spark, sf_dir)
    then = docs.join(F.broadcast(docs.agg((F.max("id") / 2).alias("cut")))).where("id < cut").drop("cut")
    hits = rt.top(rt.bm25(spark, then, rt.prompts(spark, sf_dir))).join(docs.select("id", text.tokens_estimate(F.col("body")).alias("t")), "id")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    met = hits.join(labels, "id", "left")
    return met.groupBy("prompt_id").agg(F.count("*").alias("given"), F.count("toxic").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("harmful"), F.sum("t").alias("tokens"))


def e1_extraction_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule held against labels, by language, split and overall: precision and recall to four places, null where nothing is asked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("kind"), F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("held").alias("split"), (F.length("text") < 600).alias("said"))
    met = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("is_true")), "doc_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counted = met.cube("kind", "split").agg(n(F.expr("said and is_true")).alias("hit"), n(F.expr("said")).alias("said"), n(F.expr("is_true")).alias("asked"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return counted.select("kind", "split", "hit", ratio("hit", "said").alias("precision"), ratio("hit", "asked").alias("recall"))


def e5_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pattern passes its gate: nine tenths blocked, a tenth falsely blocked at most."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("pattern"), (F.col("l_discount") >= 0.01).alias("blocked"), (F.col("l_returnflag") == "R").alias("bad"))
    share = lambda c: F.avg(F.when(c, F.col("blocked").cast("int")))
    return rows.groupBy("pattern").agg(F.round(share(F.col("bad")), 6).alias("block"), F.round(share(~F.col("bad")), 6).alias("falsely")).select("*", ((F.col("block") >= 0.9) & (F.col("falsely") <= 0.1)).alias("passes"))


def flt2_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by a predicate given as text, with the other ids of their key that day."""
    s = statements(spark, sf_dir).withColumn("day", F.floor(F.col("created") / 86_400_000))
    same = s.groupBy("store", "relation", "day").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return s.where("relation = 'error' and value > 20").join(same, ["store", "relation", "day"]).select("id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def flt9_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that a session was shown: none that was gated, cut or only listed."""
    reason = F.concat("relation", F.when(F.col("id") % 3 == 0, ":gated:budget").when(F.col("id") % 5 == 0, ":cut").when(F.col("id") % 7 == 0, ":list").otherwise(":prompt"))
    s = statements(spark, sf_dir).withColumn("reason", reason)
    return s.where("reason not like '%:gated%' and reason not like '%:cut' and reason not like '%:list'").groupBy("store").agg(F.count("*").alias("shown"), F.max("id").alias("last"))


def r29_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that each session was given since its last epoch began, an epoch being a signup; from the ledger and the tail that is not folded yet."""
    s = statements(spark, sf_dir)
    begun = s.groupBy("store").agg(F.max(F.when(F.col("relation") == "signup", F.col("id"))).alias("begun"))
    folded, tail = s.where("id % 10 < 8"), s.where("id % 10 >= 8")
    given = folded.unionByName(tail).where("relation <> 'signup'").join(begun, "store").where("begun is null or id > begun")
    return given.select("store", "id")


def jn4_handed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that another source has as well: equal by hash, sources differ."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    several = docs.groupBy("h").agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b").select("h")
    return docs.join(several, "h", "left_semi").select("doc_id", "source")


def jn12_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of each store between two signups that follow one another."""
    order = Window.partitionBy("store").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = statements(spark, sf_dir).withColumn("begun", F.max(F.when(F.col("relation") == "signup", F.struct("created", "id"))).over(order)["id"])
    ended = rows.where("relation = 'signup'").select("store", F.col("id").alias("until"), F.lag("id").over(Window.partitionBy("store").orderBy("created", "id")).alias("begun")).where("begun is not null")
    last = rows.where("relation = 'purchase' and begun is not null").groupBy("store", "begun").agg(F.max(F.struct("created", "id"))["id"].alias("id"))
    return last.join(ended, ["store", "begun"]).select("begun", "until", "id")


def jn14_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose restored marker, a key made from their number, is among the returned lines."""
    marks = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("restored:"), F.col("l_orderkey").cast("string")).alias("mark")).distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("restored:"), F.col("o_orderkey").cast("string")).alias("mark"))
    return orders.join(marks, "mark", "left_semi").select("o_orderkey")


def tk5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 400 candidates of a pass over changes, decisions before episodes."""
    s = states(spark, sf_dir).where("heir is null and kind in ('decision', 'episode')")
    return s.orderBy(F.desc("id")).limit(400).select("id", F.row_number().over(Window.orderBy("kind", F.desc("id"))).alias("place"))


def tk7_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by kind: invariants, corrections, decisions, then the rest, the newest first."""
    priority = F.when(F.col("kind") == "invariant", 0).when(F.col("kind") == "correction", 1).when(F.col("kind") == "decision", 2).otherwise(3)
    return standing(states(spark, sf_dir)).select("id", priority.alias("priority")).orderBy("priority", F.desc("id")).limit(100)


def x4_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each message that says something: three words or more, no heading, label, fence or list mark."""
    lines = F.filter(F.split("text", "\n"), lambda v: (F.size(text.words(v)) >= 3) & ~v.rlike(r"^\s*(#|```|~~~|[-*] )|:\s*$"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_element_at(lines, F.lit(1)).alias("title"))


def m3_restated_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a user that restate the user's line before: a tenth or more of their topic words in common."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.topic_words(F.col("text"), 4000).alias("w"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    met = rows.select("conv_id", "turn", "w", F.lag("turn").over(order).alias("before"), F.lag("w").over(order).alias("v")).where("before is not null")
    shared, whole = F.size(F.array_intersect("w", "v")), F.size(F.array_union("w", "v"))
    return met.select("conv_id", "turn", "before", shared.cast("bigint").alias("shared"), (shared * 10 >= whole).alias("restates"))


def m7_topic_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An heir's topic gains what it replaced: the sorted objects of both."""
    s, h = statements(spark, sf_dir), heirs(statements(spark, sf_dir))
    gained = h.join(s.select("id", "object"), "id").select("heir", "object").union(h.select(F.col("heir").alias("id")).distinct().join(s.select("id", "object"), "id").select("id", "object"))
    return gained.groupBy("heir").agg(F.array_join(F.array_sort(F.collect_set("object")), " ").alias("topic"))


def m10_said_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements said again: the last saying of the same, and whether something else was said in between."""
    key = Window.partitionBy("store", "relation").orderBy("id")
    rows = statements(spark, sf_dir).select("id", F.lag("id").over(Window.partitionBy("store", "relation", "object").orderBy("id")).alias("again_of"), F.lag("id").over(key).alias("last"))
    return rows.where("again_of is not null").select("id", "again_of", (F.col("again_of") != F.col("last")).alias("between"))


def g2_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of status P reverts its customer's newest earlier order of the same priority, and what that one had replaced stands again."""
    order = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lag("o_orderkey").over(order).alias("reverted"), F.lag("o_orderkey", 2).over(order).alias("stands_again"))
    return rows.where("o_orderstatus = 'P' and reverted is not null").select("o_orderkey", "reverted", "stands_again")


def st10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each session's start, whether what is rendered has changed since the last, and how often it did so far."""
    order = Window.partitionBy("store").orderBy("created", "id")
    rows = statements(spark, sf_dir).where("relation = 'signup'").select("store", "id", "created", F.md5(F.col("object").cast("binary")).alias("now"))
    rows = rows.withColumn("before", F.lag("now").over(order)).withColumn("rolled", F.coalesce(F.col("now") != F.col("before"), F.lit(False)))
    return rows.select("store", "id", "rolled", F.sum(F.col("rolled").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rolls"))


def ag13_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each page's address."""
    return table(spark, sf_dir, "pages").select("page_id", F.round(text.entropy(F.col("url")), 6).alias("bits"))


_TOLD = f""",
told AS (SELECT id, subject, CASE id % 10 WHEN 0 THEN 'invariant' WHEN 1 THEN 'correction' WHEN 2 THEN 'decision' WHEN 3 THEN 'decision' WHEN 4 THEN 'decision' WHEN 5 THEN 'observation' ELSE 'episode' END AS kind,
  4 - id % 4 AS trust, id // 3 AS turn, CASE WHEN id % 7 = 3 THEN id + 1 END AS heir, starts_with(subject, 'src1') AS is_log, body FROM docs),
stand AS (SELECT * FROM told WHERE heir IS NULL AND NOT is_log),
stale AS (SELECT DISTINCT turn FROM told WHERE heir IS NOT NULL AND kind IN ('decision', 'invariant', 'correction'))"""
_RECORDS = "WITH docs AS (SELECT doc_id AS id, source AS subject, text AS body FROM documents)" + _TOLD
_RANKED = "SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score, id DESC) AS INTEGER) AS rank FROM scored JOIN {which} USING (id)) WHERE rank <= 10"
_PRIORITY = "CASE kind WHEN 'invariant' THEN 0 WHEN 'correction' THEN 1 WHEN 'decision' THEN 2 ELSE 3 END"


_CHAIN = f""",
served AS (SELECT * FROM stand WHERE NOT (kind = 'episode' AND turn IN (SELECT turn FROM stale))),
f AS (SELECT scored.*, kind, trust, turn, subject, CAST(id % 4 <> 0 AS INTEGER) AS fresh FROM scored JOIN served USING (id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY prompt_id ORDER BY score, id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM f),
h AS (SELECT * FROM (SELECT *, min(score) OVER w AS best, max(id) OVER w AS newest FROM r WHERE upto - fresh <= {LIMIT} WINDOW w AS (PARTITION BY prompt_id)) WHERE fresh = 1 AND upto <= {LIMIT}),
needs AS (SELECT prompt_id, CAST(greatest(1, ceil(count(*) / 3.0)) AS BIGINT) AS need FROM chosen GROUP BY 1),
k0 AS (SELECT h.*, need, id = newest AND id > first_value(id) OVER (PARTITION BY prompt_id ORDER BY score, id DESC) AS kept FROM h JOIN needs USING (prompt_id)),
k1 AS (SELECT *, score <= best * 0.5 OR trust >= 3 OR kept AS half FROM k0),
k2 AS (SELECT *, half AND (need <= 1 OR matched >= need OR kept) AS words FROM k1),
k3 AS (SELECT *, words OR (half AND kind IN ('invariant', 'correction') AND coalesce(score <= max(CASE WHEN words THEN score END) OVER (PARTITION BY prompt_id), false)) AS enough FROM k2),
k4 AS (SELECT *, kind NOT IN ('invariant', 'correction') AND NOT kept AS other, row_number() OVER (PARTITION BY prompt_id ORDER BY score, id DESC) AS p FROM k3 WHERE enough),
turns AS (SELECT prompt_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY p) AS nth FROM (SELECT prompt_id, turn, min(p) AS p FROM k4 WHERE other GROUP BY 1, 2)) WHERE nth <= 2),
recalled AS (SELECT k4.*, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY p) AS INTEGER) AS rank FROM k4 WHERE NOT other OR (prompt_id, turn) IN (SELECT (prompt_id, turn) FROM turns)),
recent AS (SELECT id, subject FROM (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY id DESC) AS rn FROM stand) WHERE rn <= 3),
cue AS (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY id DESC) AS rank FROM (SELECT DISTINCT prompt_id, subject FROM recalled) JOIN recent USING (subject)),
fused AS (SELECT prompt_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS fused, count(*) AS lists FROM (SELECT prompt_id, id, rank FROM recalled UNION ALL SELECT prompt_id, id, rank FROM cue) GROUP BY 1, 2),
merged AS (SELECT fused.*, kind, turn, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY CASE WHEN kind IN ('invariant', 'correction') THEN 0 ELSE 1 END, fused DESC, id DESC) AS INTEGER) AS place FROM fused JOIN told USING (id))"""


def _chain(select: str, more: str = "") -> str:
    return _told(select, _CHAIN + more)


def _told(select: str, more: str = "", **kw: str) -> str:
    return rt._sql(select, _TOLD + more, **kw)


ORACLES = {
    "jn1_served_recall": _told(_RANKED.format(cols="prompt_id, rank, id, score", which="stand")),
    "r7_stale_twins": _told(_RANKED.format(cols="prompt_id, rank, id, kind", which="(SELECT * FROM stand WHERE NOT (kind = 'episode' AND turn IN (SELECT turn FROM stale)))")),
    "r8_exclusion": _chain("SELECT prompt_id, id, score, best, newest FROM h"),
    "r9_floor_with_trust": _chain("SELECT prompt_id, id, trust, kept FROM k1 WHERE half"),
    "r10_floor_with_kinds": _chain("SELECT prompt_id, id, kind, matched, need FROM k3 WHERE enough"),
    "r11_side_matches": _chain("SELECT prompt_id, id, kind, kept, rank FROM recalled"),
    "r13_cue_derivation": _RECORDS + " SELECT id, unnest(CASE kind WHEN 'invariant' THEN ['session_start', 'post_compact'] ELSE ['session_start'] END) AS event FROM stand WHERE kind IN ('invariant', 'correction')",
    "jn3_event_cues": _RECORDS + f" SELECT id, greatest((SELECT count(*) FROM stand WHERE kind = 'invariant') - {SHOWN}, 0) AS dropped FROM stand WHERE kind = 'invariant' ORDER BY id DESC LIMIT {SHOWN}",
    "r12_cue_evaluation": f"""WITH {_S}, c AS (SELECT store AS record, id % 50 AS grp, CASE WHEN id % 40 = 3 THEN false WHEN id % 3 = 0 THEN CAST(object AS INTEGER) % 5 < 4 WHEN id % 3 = 1 THEN created <= 1705000000000 ELSE relation IN ('error', 'view', 'click') END AS holds FROM s)
SELECT record, count(*) AS groups, CAST(sum(n) AS BIGINT) AS cues FROM (SELECT record, grp, count(*) AS n FROM c GROUP BY ALL HAVING bool_and(holds)) GROUP BY 1""",
    "r14_cue_and_lexical": _chain("SELECT prompt_id, id, fused, lists FROM fused"),
    "r15_merge_order": _chain("SELECT prompt_id, place, id, kind FROM merged"),
    "r16_blocks": _chain("SELECT prompt_id, place, id, cost FROM walk WHERE taken", """, o AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY place) AS step FROM (
    SELECT *, row_number() OVER (PARTITION BY prompt_id, body ORDER BY place) AS b FROM (
      SELECT m.*, body, CAST(least(ceil(length(body) / 3.0), 200) AS BIGINT) AS cost, row_number() OVER (PARTITION BY prompt_id, m.turn ORDER BY place) AS n FROM merged m JOIN docs USING (id)) WHERE n = 1) WHERE b = 1),
walk AS (
  SELECT prompt_id, place, id, cost, step, CASE WHEN cost <= 700 THEN cost ELSE 0 END AS used, cost <= 700 AS taken FROM o WHERE step = 1
  UNION ALL SELECT o.prompt_id, o.place, o.id, o.cost, o.step, CASE WHEN w.used + o.cost <= 700 THEN w.used + o.cost ELSE w.used END, w.used + o.cost <= 700 FROM walk w JOIN o ON o.prompt_id = w.prompt_id AND o.step = w.step + 1)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "r17_block_validation": r"""SELECT conv_id, turn, NOT regexp_matches(k, '(?m)^(system|assistant|user): ') AND NOT contains(lower(k), 'ignore previous') AS ok FROM (
  SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 0 THEN role || ': ' ELSE '' END || text, '^assistant: ', '') AS k FROM conversations)""",
    "r20_show_by_ids": _RECORDS + f""", a AS (SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN doc_id + 10000000 ELSE doc_id END AS id FROM labels),
m AS (SELECT a.id, t.heir, t.id AS known, row_number() OVER (PARTITION BY t.id IS NOT NULL AND t.heir IS NULL ORDER BY a.id DESC) AS rn FROM a LEFT JOIN told t USING (id))
SELECT id, CASE WHEN known IS NULL THEN 'unknown' WHEN heir IS NOT NULL THEN 'retired' WHEN rn <= {SHOWN} THEN 'shown' ELSE 'over budget' END AS state FROM m""",
    "r21_catalogue": _RECORDS + f""", p AS (SELECT id, kind, lower(substr(string_split(body, chr(10))[1], 1, 160)) AS line FROM (SELECT * FROM stand ORDER BY id DESC LIMIT {SLOTS}) WHERE kind <> 'observation')
SELECT id, kind, CAST(row_number() OVER (ORDER BY CASE WHEN kind IN ('invariant', 'correction') THEN 0 WHEN kind = 'decision' THEN 1 ELSE 2 END, id DESC) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY id DESC) AS n FROM p) WHERE n = 1""",
    "r23_why": _told("""SELECT prompt_id, rank, id, kind FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score, CASE WHEN kind IN ('decision', 'correction') THEN 0 ELSE 1 END, id DESC) AS INTEGER) AS rank FROM scored JOIN told USING (id)) WHERE rank <= 20"""),
    "r25_sufficiency": _told("""SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY CAST(is_log AS INTEGER), rank) AS INTEGER) AS place, id, heir,
bool_or(heir IS NULL AND NOT is_log AND trust >= 2) OVER (PARTITION BY prompt_id) AS sufficient FROM best JOIN told USING (id)"""),
    "r30_rationale": rt._sql("SELECT prompt_id, max(id) AS id, max(k) AS k FROM (SELECT prompt_id, id, count(*) AS k FROM posts JOIN six USING (term) GROUP BY 1, 2) JOIN (SELECT prompt_id, count(*) AS k FROM six GROUP BY 1) USING (prompt_id, k) WHERE k >= 2 GROUP BY prompt_id",
        ", six AS (SELECT prompt_id, term FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY octet_length(encode(term)) DESC, term) AS n FROM terms WHERE octet_length(encode(term)) >= 4) WHERE n <= 6)"),
    "jn11_shortest_match": rt._sql("SELECT prompt_id, term, id FROM (SELECT prompt_id, term, id, row_number() OVER (PARTITION BY prompt_id ORDER BY length(body), id) AS n FROM (SELECT prompt_id, term FROM chosen WHERE rn = 1) JOIN posts USING (term) JOIN docs USING (id)) WHERE n = 1"),
    "g7_vocabulary": rt._sql("SELECT term, count(DISTINCT subject) AS files, count(DISTINCT subject) > 3 AS vocabulary FROM (SELECT DISTINCT term FROM chosen) JOIN posts USING (term) JOIN docs USING (id) GROUP BY term"),
    "e6_known_item": rt._sql("SELECT count(*) AS asked, round(avg(CAST(rank IS NOT NULL AS INTEGER)), 6) AS recall_at_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr_at_10 FROM asked LEFT JOIN (SELECT prompt_id, rank FROM best WHERE id = prompt_id) USING (prompt_id)",
        asked="SELECT doc_id AS prompt_id, substr(text, 1, 160) AS text FROM documents WHERE doc_id % 50 = 7"),
    "e2_delivery_replay": rt._sql("""SELECT prompt_id, count(*) AS given, count(toxic) AS labelled, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS harmful, CAST(sum(CAST(ceil(length(body) / 3.0) AS BIGINT)) AS BIGINT) AS tokens
FROM best JOIN docs USING (id) LEFT JOIN (SELECT doc_id AS id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (id) GROUP BY prompt_id""").replace("FROM documents)", "FROM documents WHERE doc_id < (SELECT max(doc_id) / 2 FROM documents))", 1),
    "e1_extraction_replay": """WITH m AS (SELECT coalesce(lang, 'none') AS kind, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'held' END AS split, length(text) < 600 AS said, quality = 0 AS t FROM documents JOIN labels USING (doc_id)),
c AS (SELECT kind, split, count(*) FILTER (said AND t) AS hit, count(*) FILTER (said) AS n, count(*) FILTER (t) AS asked FROM m GROUP BY CUBE (kind, split))
SELECT kind, split, hit, CASE WHEN n > 0 THEN round(hit / n, 4) END AS precision, CASE WHEN asked > 0 THEN round(hit / asked, 4) END AS recall FROM c""",
    "e5_gates": "SELECT *, block >= 0.9 AND falsely <= 0.1 AS passes FROM (SELECT l_linestatus AS pattern, round(avg(CAST(l_discount >= 0.01 AS INTEGER)) FILTER (l_returnflag = 'R'), 6) AS block, round(avg(CAST(l_discount >= 0.01 AS INTEGER)) FILTER (l_returnflag <> 'R'), 6) AS falsely FROM lineitem GROUP BY 1)",
    "flt2_predicate": f"WITH {_S}, d AS (SELECT *, created // 86400000 AS day FROM s) SELECT d.id, (SELECT string_agg(CAST(e.id AS VARCHAR), ',' ORDER BY e.id) FROM d e WHERE e.store = d.store AND e.relation = d.relation AND e.day = d.day) AS ids FROM d WHERE relation = 'error' AND value > 20",
    "flt9_shown": f"WITH {_S} SELECT store, count(*) AS shown, max(id) AS last FROM s WHERE id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 GROUP BY store",
    "r29_delivered": f"WITH {_S} SELECT store, id FROM s WHERE relation <> 'signup' AND id > coalesce((SELECT max(e.id) FROM s e WHERE e.store = s.store AND e.relation = 'signup'), -1)",
    "jn4_handed_over": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE coalesce(e.text, '') = coalesce(d.text, '') AND e.source <> d.source)",
    "jn12_between": f"""WITH {_S}, j AS (SELECT store, id AS until, created AS c, lag(id) OVER w AS begun, lag(created) OVER w AS b FROM s WHERE relation = 'signup' WINDOW w AS (PARTITION BY store ORDER BY created, id))
SELECT begun, until, max_by(p.id, p.created * 1000000 + p.id) AS id FROM j JOIN s p ON p.store = j.store AND p.relation = 'purchase' AND (p.created, p.id) > (j.b, j.begun) AND (p.created, p.id) < (j.c, j.until) WHERE begun IS NOT NULL GROUP BY 1, 2""",
    "jn14_marker": "SELECT o_orderkey FROM orders WHERE 'restored:' || o_orderkey IN (SELECT 'restored:' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "tk5_candidates": _RECORDS + " SELECT id, CAST(row_number() OVER (ORDER BY kind, id DESC) AS INTEGER) AS place FROM (SELECT * FROM told WHERE heir IS NULL AND kind IN ('decision', 'episode') ORDER BY id DESC LIMIT 400)",
    "tk7_priority": _RECORDS + f" SELECT id, {_PRIORITY} AS priority FROM stand ORDER BY 2, id DESC LIMIT 100",
    "x4_title": r"SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda v: len(list_filter(string_split_regex(v, '\s+'), lambda w: w <> '')) >= 3 AND NOT regexp_matches(v, '^\s*(#|```|~~~|[-*] )|:\s*$'))[1] AS title FROM conversations",
    "m3_restated_corrections": f"""WITH r AS (SELECT conv_id, turn, {duck.topic_words('text', 4000)} AS w FROM conversations WHERE role = 'user'),
p AS (SELECT *, lag(turn) OVER o AS before, lag(w) OVER o AS v FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, before, CAST(len(list_intersect(w, v)) AS BIGINT) AS shared, len(list_intersect(w, v)) * 10 >= len(list_distinct(list_concat(w, v))) AS restates FROM p WHERE before IS NOT NULL""",
    "m7_topic_inheritance": f"WITH {_H}, g AS (SELECT heir, object FROM h JOIN s USING (id) UNION SELECT heir, object FROM h JOIN s ON s.id = h.heir) SELECT heir, string_agg(object, ' ' ORDER BY object) AS topic FROM g GROUP BY heir",
    "m10_said_again": f"""WITH {_S}, a AS (SELECT b.id, max(a.id) AS again_of, b.store, b.relation FROM s b JOIN s a ON a.store = b.store AND a.relation = b.relation AND a.object = b.object AND a.id < b.id GROUP BY ALL)
SELECT id, again_of, EXISTS (SELECT 1 FROM s m WHERE m.store = a.store AND m.relation = a.relation AND m.id > a.again_of AND m.id < a.id) AS between FROM a""",
    "g2_revert": "SELECT * FROM (SELECT o_orderkey, lag(o_orderkey) OVER w AS reverted, lag(o_orderkey, 2) OVER w AS stands_again FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) QUALIFY o_orderstatus = 'P') WHERE reverted IS NOT NULL",
    "st10_fingerprints": f"""WITH {_S}, r AS (SELECT store, id, created, coalesce(object <> lag(object) OVER w, false) AS rolled FROM s WHERE relation = 'signup' WINDOW w AS (PARTITION BY store ORDER BY created, id))
SELECT store, id, rolled, CAST(sum(CAST(rolled AS INTEGER)) OVER (PARTITION BY store ORDER BY created, id) AS BIGINT) AS rolls FROM r""",
    "ag13_entropy": "SELECT page_id, round(list_aggregate(string_split(url, ''), 'entropy'), 6) AS bits FROM pages",
}
QUERIES = {name: globals()[name] for name in ORACLES}
