"""Session transcripts, two dialects of line-delimited JSON, as one table of turns.

Lines are read as text and parsed by the JVM. A line's order is its file, block
and place; its end offset is the running sum of bytes in its file, so that a later
read can resume after it. Bad lines are skipped. A file that names itself a
rollout, or lies in the folder of that dialect, is of dialect B; all others of A.

Turns: session_id, turn_no, prompt, reply, tools (array of struct<name, target,
is_error, result>), answered, automated, start_offset, end_offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
LINE_A = "type string, sessionId string, timestamp string, isMeta boolean, isSidechain boolean, message struct<role:string,content:string>, toolUseResult string"
LINE_B = "timestamp string, type string, payload string"
PAYLOAD = "id string, session_id string, source string, thread_source string, type string, role string, name string, call_id string, arguments string, output string, message string, content string, item string, turn_attribution struct<turn_trigger:string>"
ITEM = "type string, id string, status string, text string, content string, command string, exit_code bigint, aggregated_output string, changes string, tool string, result string"
ROLLOUT = r"(/\.codex/|/rollout-[^/]*$)"


def lines(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(file, ord, value, start_offset, end_offset) of the complete lines from a byte offset on, in order within each file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    order = Window.partitionBy("file").orderBy("block", "m")
    end = F.sum(F.octet_length("value") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = raw.withColumn("end_offset", end).withColumn("ord", F.row_number().over(order)).withColumn("start_offset", F.col("end_offset") - F.octet_length("value") - 1)
    return out.where(F.col("start_offset") >= start).select("file", "ord", "value", "start_offset", "end_offset")


def is_rollout(file: Column) -> Column:
    return file.rlike(ROLLOUT)


def _texts(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")


def _turns(events: DataFrame) -> DataFrame:
    """Turns from events: file, ord, session_id, kind (open, say, call, result, note), text, name, call, is_error, automated and offsets."""
    order = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("turn_no", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(order)).where("turn_no > 0")
    results = numbered.where("kind = 'result' AND call IS NOT NULL").groupBy("file", "call").agg(F.max_by(F.struct(F.col("text").alias("result"), F.coalesce("is_error", F.lit(False)).alias("is_error")), "ord").alias("r"))
    calls = numbered.where("kind = 'call'").join(results, ["file", "call"], "left")
    tool = F.struct("ord", "name", F.col("text").alias("target"), F.coalesce("r.is_error", F.lit(False)).alias("is_error"), F.col("r.result").alias("result"))
    tools = calls.groupBy("file", "turn_no").agg(F.transform(F.array_sort(F.collect_list(tool)), lambda t: F.struct(t["name"].alias("name"), t["target"].alias("target"), t["is_error"].alias("is_error"), t["result"].alias("result"))).alias("tools"))
    say = F.array_sort(F.collect_list(F.when((F.col("kind") == "say") & (F.col("text") != ""), F.struct("ord", "text"))))
    turns = numbered.groupBy("file", "turn_no").agg(
        F.first("session_id", ignorenulls=True).alias("session_id"), F.min_by("text", F.when(F.col("kind") == "open", F.col("ord"))).alias("prompt"), F.array_join(F.transform(say, lambda s: s["text"]), "\n").alias("reply"),
        F.bool_or("automated").alias("automated"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"),
    )
    out = turns.join(tools, ["file", "turn_no"], "left")
    return out.select("file", "session_id", "turn_no", "prompt", "reply", F.coalesce("tools", F.array().cast("array<struct<name:string,target:string,is_error:boolean,result:string>>")).alias("tools"), (F.col("reply") != "").alias("answered"), "automated", "start_offset", "end_offset")


def read_a(rows: DataFrame) -> DataFrame:
    """Turns of dialect A from its lines."""
    j = F.from_json("value", LINE_A)
    parsed = rows.select("file", "ord", "start_offset", "end_offset", j.alias("j")).where("j.type in ('user', 'assistant') AND NOT coalesce(j.isMeta, false) AND NOT coalesce(j.isSidechain, false)")
    content = F.col("j.message.content")
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")), F.lit(None).cast("boolean").alias("is_error")))
    blocks = F.coalesce(F.when(content.startswith("["), F.from_json(content, BLOCKS)), plain.cast(BLOCKS))
    held = parsed.select("file", "ord", "start_offset", "end_offset", F.col("j.type").alias("role"), F.col("j.sessionId").alias("session_id"), blocks.alias("b"))
    base = ["file", "start_offset", "end_offset", "session_id"]
    text = _texts(F.col("b"))
    said = held.where(text != "").select(*base, (F.col("ord") * 1000).alias("ord"), F.when(F.col("role") == "user", "open").otherwise("say").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("call"), F.lit(None).cast("boolean").alias("is_error"))
    each = held.select(*base, "ord", F.posexplode("b").alias("i", "x")).where("x.type in ('tool_use', 'tool_result')")
    used = each.select(
        *base, (F.col("ord") * 1000 + F.col("i") + 1).alias("ord"), F.when(F.col("x.type") == "tool_use", "call").otherwise("result").alias("kind"),
        F.when(F.col("x.type") == "tool_use", F.coalesce(F.get_json_object("x.input", "$.command"), F.get_json_object("x.input", "$.file_path"), F.col("x.input"))).otherwise(F.col("x.content")).alias("text"),
        F.col("x.name").alias("name"), F.coalesce("x.id", "x.tool_use_id").alias("call"), F.col("x.is_error").alias("is_error"),
    )
    return _turns(said.unionByName(used).withColumn("automated", F.lit(False)))


def read_b(rows: DataFrame) -> DataFrame:
    """Turns of dialect B: completed items, or, in files without a user item, the older response items."""
    j = rows.select("file", "ord", "start_offset", "end_offset", F.from_json("value", LINE_B).alias("j")).where("j.type is not null")
    p = j.select("file", "ord", "start_offset", "end_offset", F.col("j.type").alias("type"), F.from_json("j.payload", PAYLOAD).alias("p")).withColumn("item", F.from_json("p.item", ITEM))
    whole, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    is_item = (F.col("type") == "event_msg") & (F.col("p.type") == "item_completed")
    marked = p.select(
        "*", F.max(F.coalesce("p.session_id", F.when(F.col("type") == "session_meta", F.col("p.id")))).over(whole).alias("session_id"),
        F.max(F.when(F.col("type") == "session_meta", F.col("p.source").isin("cli", "vscode") & F.coalesce(F.col("p.thread_source") == "user", F.lit(True)))).over(whole).alias("by_person"),
        F.last(F.when(F.col("p.type") == "task_started", F.coalesce("p.turn_attribution.turn_trigger", F.lit("user"))), ignorenulls=True).over(before).alias("trigger"),
        F.max(F.when(is_item & (F.col("item.type") == "UserMessage"), 1).otherwise(0)).over(before).alias("items_seen"),
    )
    text = F.coalesce("item.text", _texts(F.from_json("item.content", BLOCKS)), F.lit(""))
    old = (F.col("type") == "response_item") & (F.col("items_seen") == 0)
    message = _texts(F.from_json("p.content", BLOCKS))
    kind = (
        F.when(is_item & (F.col("item.type") == "UserMessage"), "open").when(is_item & (F.col("item.type") == "AgentMessage"), "say")
        .when(is_item & F.col("item.type").isin("CommandExecution", "FileChange", "McpToolCall"), "both").when((F.col("type") == "event_msg") & (F.col("p.type") == "user_message") & (F.col("items_seen") == 0), "open")
        .when(old & (F.col("p.type") == "message") & (F.col("p.role") == "assistant"), "say").when(old & F.col("p.type").isin("function_call", "custom_tool_call", "local_shell_call"), "call")
        .when(old & F.col("p.type").endswith("_output"), "result")
    )
    body = F.when(is_item & F.col("item.type").isin("UserMessage", "AgentMessage"), text).when(is_item, F.coalesce("item.command", "item.changes", "item.tool")).when(F.col("p.type") == "user_message", F.col("p.message")).when(F.col("p.type") == "message", message).otherwise(F.coalesce("p.arguments", "p.output"))
    failed = F.coalesce((F.col("item.exit_code") != 0) | (F.col("item.status") == "failed"), F.lit(False))
    made = marked.select(
        "file", (F.col("ord") * 1000).alias("ord"), "start_offset", "end_offset", "session_id", kind.alias("kind"), body.alias("text"), F.when(is_item, F.col("item.type")).otherwise(F.col("p.name")).alias("name"),
        F.coalesce("p.call_id", "item.id").alias("call"), failed.alias("is_error"), F.coalesce("item.aggregated_output", "item.result").alias("out"), (~(F.coalesce("by_person", F.lit(False)) & (F.coalesce("trigger", F.lit("user")) == "user"))).alias("automated"),
    ).where("kind is not null")
    both = made.where("kind = 'both'")
    events = made.where("kind <> 'both'").unionByName(both.withColumn("kind", F.lit("call"))).unionByName(both.withColumn("kind", F.lit("result")).withColumn("ord", F.col("ord") + 1).withColumn("text", F.col("out")))
    return _turns(events.drop("out"))


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Turns of all transcripts under path, each by its dialect."""
    rows = lines(spark, path, start)
    return read_a(rows.where(~is_rollout(F.col("file")))).unionByName(read_b(rows.where(is_rollout(F.col("file")))))
