import json

from ledgerloom.sources import git, records, transcripts


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_dialect_a(spark, tmp_path):
    say = lambda role, content, **k: {"type": role, "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": role, "content": content}, **k}
    write(tmp_path / "one.jsonl", [
        say("user", "we use postgres"), "{broken", say("user", "ignored", isMeta=True),
        say("assistant", [{"type": "text", "text": "fine"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "make test"}}]),
        say("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "2 failed", "is_error": True}]), say("assistant", [{"type": "text", "text": "it failed"}]),
        say("user", [{"type": "text", "text": "[odd] try sqlite"}]), say("user", "[not json"),
    ])
    got = transcripts.read(spark, str(tmp_path / "one.jsonl")).orderBy("turn_no").collect()
    assert [(r.turn_no, r.prompt, r.reply, r.answered) for r in got] == [(1, "we use postgres", "fine\nit failed", True), (2, "[odd] try sqlite", "", False), (3, "[not json", "", False)]
    assert [tuple(t) for t in got[0].tools] == [("Bash", "make test", True, "2 failed")]
    size = (tmp_path / "one.jsonl").stat().st_size
    assert got[-1].end_offset == size and got[0].session_id == "s1"
    later = transcripts.read(spark, str(tmp_path / "one.jsonl"), start=got[0].end_offset).collect()
    assert sorted(r.prompt for r in later) == ["[not json", "[odd] try sqlite"]


def test_dialect_b(spark, tmp_path):
    item = lambda **k: {"type": "event_msg", "payload": {"type": "item_completed", "item": k}}
    write(tmp_path / "rollout-x.jsonl", [
        {"type": "session_meta", "payload": {"id": "s9", "source": "cli"}}, {"type": "event_msg", "payload": {"type": "task_started", "turn_attribution": {"turn_trigger": "user"}}},
        item(type="UserMessage", content=[{"type": "text", "text": "run it"}]), item(type="CommandExecution", id="c1", command="ls", exit_code=1, aggregated_output="no"), item(type="AgentMessage", text="done"),
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done twice"}]}},
        {"type": "event_msg", "payload": {"type": "task_started", "turn_attribution": {"turn_trigger": "agent"}}}, item(type="UserMessage", text="from an agent"),
    ])
    write(tmp_path / "rollout-old.jsonl", [
        {"type": "session_meta", "payload": {"id": "s8", "source": "exec"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "old style"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "k", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": "ok"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "yes"}]}},
    ])
    got = {(r.session_id, r.turn_no): r for r in transcripts.read(spark, str(tmp_path)).collect()}
    assert set(got) == {("s9", 1), ("s9", 2), ("s8", 1)}
    one = got["s9", 1]
    assert (one.prompt, one.reply, one.automated) == ("run it", "done", False) and [tuple(t) for t in one.tools] == [("CommandExecution", "ls", True, "no")]
    assert got["s9", 2].automated and got["s8", 1].automated and got["s8", 1].reply == "yes" and got["s8", 1].tools[0].result == "ok"


def test_git(spark):
    log = spark.createDataFrame([("\x1eab1\x1f1700000000\x1fUse redis\x1f\ncfg.toml\n\x1ecd2\x1f1700000100\x1fMore\x1f\na\nb\n",)], "value string")
    assert [(r.hash, r.anchor, len(r.files)) for r in git.commits(log).orderBy("at").collect()] == [("ab1", "cfg.toml", 1), ("cd2", None, 2)]
    text = "--- a/cfg.toml\n+++ b/cfg.toml\n@@ -1 +1 @@\n-cache = memcached\n+cache = redis\n@@ -9,2 +9 @@\n-x\n-y\n+z\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-old"
    diff = spark.createDataFrame([("h", i, x) for i, x in enumerate(text.split("\n"))], "hash string, ord int, line string")
    found = git.hunks(diff)
    assert {(r.hunk, r.file, tuple(r.removed), tuple(r.added)) for r in found.collect()} == {(1, "cfg.toml", ("cache = memcached",), ("cache = redis",)), (2, "cfg.toml", ("x", "y"), ("z",)), (3, "gone", (), ())}
    assert [(r.was, r.now) for r in git.swaps(found).collect()] == [("cache = memcached", "cache = redis")]
    assert spark.createDataFrame([("Use foo.bar/baz at 12",)], "t string").select(git.code_tokens("t").alias("w")).first().w == ["bar", "baz", "foo", "foo.bar/baz", "use"]


def test_records_round_trip(spark, tmp_path):
    rows = [{"id": 1, "kind": "decision", "body": "b", "origin": "user_said", "created_at": 1_700_000_000_000}, {"id": 2, "kind": "decision", "body": "b", "origin": "user_said", "created_at": 1_700_000_000_000}, {"id": 3, "kind": "nonsense", "body": "b", "created_at": 1_700_000_000_000}, {"id": 4, "body": "x", "created_at": 1_700_000_000_000, "invalid": 1}]
    write(tmp_path / "in.jsonl", rows)
    got = records.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert sorted((r.id, r.kind, r.trust) for r in got.collect()) == [(1, "decision", 3), (4, "episode", 0)]
    records.write_jsonl(got, str(tmp_path / "out"))
    assert [r.id for r in spark.read.json(str(tmp_path / "out")).collect()] == [1]
