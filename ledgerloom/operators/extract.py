"""Turns to records: episodes, corrections, invariants, decisions, commits and dead ends, as column expressions.

The input is a table of turns (sources.transcripts). Sentences are exploded once;
each kind of statement is a predicate over them. The cue words are this library's
own lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx

CORRECTION = r"(?i)^(no[,.! ]|wrong\b|that('s| is) (not|wrong)|not what i\b|stop\b|actually[, ]|you (should|must) not have|i (said|told you)\b)"
EXPLAINED = r"(?i)\b(can you explain|why (is|does|did)|not allowed)\b"
MODAL = r"(?i)\b(must|never|always|only|do not|don't|required|forbidden)\b"
CHANGE = r"(?i)\b(switch(ed|ing)? to|instead of|no longer|moved? to|replac(e|ed|ing)|rather than)\b"
CHOICE = r"(?i)\b(we (use|will use|decided|chose|go with)|let's (use|go with)|decision:|use \S+ for)\b"
QUANTITY = r"(?i)^\W*([0-9]+\s+[a-z]{3,}|[a-z]{3,}\s+[0-9]+)\W*$"
WISH = r"(?i)^(i want|i'd like|please (use|make|keep)|it should)\b"
ACK = r"(?i)^\W*(ok(ay)?|yes|yep|sure|thanks?|thank you|great|good|fine|go|continue|next)\W*$"
COMMIT = r"\[([^\s\]]+) (?:\(root-commit\) )?([0-9a-f]{7,40})\] (.+)"
TESTS = r"(?i)\b(test|build|check|lint|compile|pytest|cargo|make)\b"
FENCE = r"(?s)```.*?(```|\z)"


def own_words(prompt: Column) -> Column:
    """What a person typed themselves: without fences, quoted lines, paste wrappers and long quotations."""
    out = F.regexp_replace(F.coalesce(prompt, F.lit("")), FENCE, " ")
    out = F.regexp_replace(out, r"(?m)^\s*>.*$", "")
    out = F.regexp_replace(out, r"(?s)<(pasted|system-reminder|command-[a-z]+)[^>]*>.*?(</\1>|\z)", " ")
    out = F.regexp_replace(out, "[\"“][^\"”]{40,}[\"”]", " ")
    return F.when(F.regexp_count(out, F.lit(r"(?mi)^\s*(user|assistant|human|system)\s*:")) >= 2, F.lit("")).otherwise(F.trim(out))


def sentences(text: Column) -> Column:
    """Sentences: cut at line ends, and after . ! or ; before white space, but not after an abbreviation of up to three letters before a small letter."""
    marked = F.regexp_replace(text, r"(?<![ (.][A-Za-z]{1,3})(\.)\s+|(\.)\s+(?=[A-Z])|([!;])\s+|\n+", "$1$2$3\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda s: s != "")


def head_and_tail(text: Column, most: int = 700, head: int = 350, tail: int = 300) -> Column:
    """A text as it is, or its beginning and end around a mark."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.substring(text, -tail, tail)))


def episodes(turns: DataFrame) -> DataFrame:
    """One labelled excerpt of each turn that says something; a lone acknowledgement without an answer says nothing."""
    prompt, reply = own_words(F.col("prompt")), F.coalesce("reply", F.lit(""))
    short = F.when(F.length(prompt) <= 600, prompt).otherwise(F.regexp_replace(F.substring(prompt, 1, 600), r"\s+\S*$", ""))
    failed = F.slice(F.transform(F.filter("tools", lambda t: t["is_error"]), lambda t: F.concat(F.lit("failed: "), F.substring(t["target"], 1, 120))), 1, 12)
    body = F.array_join(F.concat(F.array(F.concat(F.lit("user: "), short)), F.when(reply != "", F.array(F.concat(F.lit("assistant: "), head_and_tail(reply)))).otherwise(F.array().cast("array<string>")), failed), "\n")
    kept = turns.where((prompt != "") & ~(prompt.rlike(ACK) & (reply == "")))
    return kept.select(F.concat(F.lit("session:"), "session_id", F.lit("#"), F.col("turn_no").cast("string")).alias("subject"), F.lit("episode").alias("kind"), F.substring(body, 1, 2000).alias("body"), "session_id", "turn_no")


def chunks(turns: DataFrame, size: int = 1800, most: int = 12) -> DataFrame:
    """What an episode's head leaves out of a long prompt, in pieces of up to size characters cut at white space, most of them at most."""
    rest = turns.select("session_id", "turn_no", F.expr("substring(prompt, 601)").alias("rest")).where("rest <> ''")
    pieces = F.regexp_extract_all("rest", F.lit(rf"(?s)\S.{{0,{size - 1}}}(?=\s|\z)|\S{{1,{size}}}"), F.lit(0))
    return rest.select("session_id", "turn_no", F.posexplode(F.slice(pieces, 1, most)).alias("k", "body"))


def corrections(turns: DataFrame) -> DataFrame:
    said = own_words(F.col("prompt"))
    return turns.where(said.rlike(CORRECTION) & ~said.rlike(EXPLAINED) & (F.length(said) <= 1500)).select("session_id", "turn_no", F.lit("correction").alias("kind"), said.alias("body"))


def statements(turns: DataFrame) -> DataFrame:
    """(session_id, turn_no, k, kind, by, key, body): the decisions and invariants among a turn's own sentences."""
    s = turns.select("session_id", "turn_no", F.posexplode(sentences(own_words(F.col("prompt")))).alias("k", "body"))
    b, asked = F.col("body"), F.col("body").contains("?")
    words = tx.topic_words(b)
    key = tx.norm_key(b, 80)
    rule = b.rlike(MODAL) & ~asked & F.length(b).between(12, 220) & (F.size(F.split(key, " ")) >= 3)
    by = F.when(b.rlike(CHANGE), "change").when(b.rlike(CHOICE), "choice").when(b.rlike(QUANTITY), "quantity").when(b.rlike(WISH), "wish")
    decision = by.isNotNull() & ~asked & ~b.endswith(":") & F.length(b).between(6, 300) & ((F.size(words) >= 2) | by.isin("change", "quantity"))
    found = s.select("*", F.when(rule, "invariant").when(decision, "decision").alias("kind"), F.when(~rule, by).alias("by"), F.when(rule, key).otherwise(F.concat(F.lit("said:"), F.when(by == "change", "change").otherwise("state"), F.lit(":"), F.array_join(words, " "))).alias("key"))
    # of a turn's wishes, only the first counts
    wishes = F.row_number().over(Window.partitionBy("session_id", "turn_no", "kind", "by").orderBy("k"))
    return found.where("kind is not null").withColumn("nth", wishes).where("by is distinct from 'wish' or nth = 1").drop("nth")


def commits(turns: DataFrame) -> DataFrame:
    """Commits that a tool's output reports."""
    out = turns.select("session_id", "turn_no", F.explode("tools").alias("t")).select("session_id", "turn_no", F.regexp_extract("t.result", COMMIT, 2).alias("hash"), F.regexp_extract("t.result", COMMIT, 3).alias("message"))
    return out.where("hash <> ''").select("session_id", "turn_no", F.concat(F.lit("commit:"), F.substring("hash", 1, 7)).alias("subject"), "message")


def dead_ends(turns: DataFrame) -> DataFrame:
    """Commands whose last run failed, and that failed twice, or once for tests and builds."""
    runs = turns.select("session_id", "turn_no", F.posexplode("tools").alias("i", "t")).select("session_id", "turn_no", "i", F.substring(F.regexp_replace(F.trim("t.target"), r"\s+", " "), 1, 120).alias("command"), "t.is_error", "t.result")
    at = F.struct("turn_no", "i")
    by_command = runs.groupBy("session_id", "command").agg(F.sum(F.col("is_error").cast("int")).alias("fails"), F.max_by("is_error", at).alias("failed_last"), F.max_by("result", at).alias("output"))
    return by_command.where(F.col("failed_last") & ((F.col("fails") >= 2) | F.col("command").rlike(TESTS))).select("session_id", "command", "fails", "output")


def route(question: Column) -> Column:
    """What a question is about, the first that fits: an id, a commit, a rule, a dead end, a file, a decision, or all."""
    return (
        F.when(question.rlike(r"(?i)^\s*#?[0-9]+\s*$"), "id").when(question.rlike(r"\b[0-9a-f]{7,40}\b"), "commit").when(question.rlike(r"(?i)\b(rule|allowed|forbidden|never|must)\b"), "rule")
        .when(question.rlike(r"(?i)\b(fail\w*|tried|broke\w*|error)\b"), "deadend").when(question.rlike(r"\b[\w/-]+\.[a-z]{1,4}\b"), "file").when(question.rlike(r"(?i)\b(decid\w*|why|chose\w*|use|switch\w*)\b"), "decision").otherwise("all")
    )
