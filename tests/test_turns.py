import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import turns
from ledgerloom.streaming import telemetry as st
from ledgerloom.streaming import turns as timers

LINES = "session string, at bigint, begin bigint, end bigint, role string, text string"
H = turns.IDLE_MS


def lines(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def line(session, at, begin, role, text=""):
    """at counts from 10 seconds after 1970, as what is not after the first watermark is late."""
    return {"session": session, "at": at + 10_000, "begin": begin, "end": begin + 10, "role": role, "text": text}


def streamed(spark, tmp_path, batches, build, schema, name):
    """The rows after each micro-batch: one file each, the same checkpoint."""
    seen = []
    for i, rows in enumerate(batches):
        lines(tmp_path / f"{name}-in/{i:03}.json", rows)
        st.to_end(build(st.log(spark, str(tmp_path / f"{name}-in"), schema, files=1)), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check"))
        seen.append([tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()])
    return seen


def test_three_batches_each_case_once(spark, tmp_path):
    other = lambda at, n: line("clock", at, n, "user", "tick")  # noqa: E731  moves the watermark
    batches = [
        [line("a", 0, 0, "user", "why?"), line("a", 5_000, 10, "assistant"), line("a", 9_000, 20, "user", "and then?"), line("b", 1_000, 0, "user", "ends"), line("b", 2_000, 10, "end"), line("c", 4_000, 0, "assistant", "no turn")],
        [other(H + 2_000_000, 0)],  # a's second turn has been idle for an hour
        [line("a", 2 * H, 30, "assistant", "late answer"), line("a", 2 * H + 1_000, 40, "user", "next"), line("d", 2 * H, 0, "user", "q"), line("d", 4 * H, 10, "tool"), other(6 * H, 10)],
    ]
    first, second, third = streamed(spark, tmp_path, batches, timers.held_turns, LINES, "turns")
    assert set(first) == {("a", 0, 20, "why?", 1, "stored", "prompt", None), ("b", 0, 10, "ends", 0, "released", "end", None)}
    assert set(second) - set(first) == {("a", 20, 30, "and then?", 0, "released", "idle", None)}
    new = set(third) - set(second)
    assert {x for x in new if x[0] == "a"} >= {("a", 20, 40, "and then?", 1, "grown", "prompt", 30)}
    assert ("d", 0, 10, "q", 0, "released", "idle", None) in new
    assert len(third) == len(set(third))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_do_not_matter(spark, tmp_path, seed):
    """A stream in any cut, and the batch operator: the same readings."""
    rnd = random.Random(seed)
    rows = []
    for s in range(6):
        at = rnd.randint(0, H)
        for i in range(rnd.randint(1, 9)):
            rows.append(line(f"s{s}", at, i * 10, rnd.choice(["user", "user", "assistant", "tool", "end"]), f"t{i}"))
            at += rnd.choice([1_000, 60_000, H - 1, H, 3 * H])
    rows.sort(key=lambda r: r["at"])
    end = rows[-1]["at"] + 9 * H - 10_000
    cuts = sorted(rnd.sample(range(1, len(rows)), 2))
    clock = [line("clock", end, 0, "user", "tick")]
    batches = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :] + clock, [line("clock", end + 1, 10, "user", "tick")]]
    got = streamed(spark, tmp_path, batches, lambda x: timers.held_turns(x, late="200 hours"), LINES, "turns")[-1]
    got += streamed(spark, tmp_path, [*batches, [line("clock", end + 500 * H, 20, "end")], [line("clock", end + 501 * H, 30, "end")]], lambda x: timers.held_turns(x, late="200 hours"), LINES, "whole")[-1]
    got = {x[:3] + x[4:] for x in got if x[0] != "clock"}
    want = turns.held_turns(spark.createDataFrame(rows), F.lit(end + 10_000))
    assert got == {tuple(r) for r in want.where("what <> 'held'").collect()}


def test_held_at_the_clock(spark):
    rows = spark.createDataFrame([line("a", 0, 0, "user"), line("a", 10, 10, "assistant"), line("b", 0, 0, "user")])
    got = {(r.session, r.what, r.closed) for r in turns.held_turns(rows, F.lit(H + 10_005)).collect()}
    assert got == {("a", "held", None), ("b", "released", "idle")}
    assert turns.held_turns(rows.limit(0), F.lit(0)).collect() == []


def test_the_head_of_a_grown_turn_is_the_heir(spark):
    said = turns.held_turns(spark.createDataFrame([line("a", 0, 0, "user"), line("a", 2 * H, 10, "assistant"), line("a", 4 * H, 20, "assistant"), line("b", 0, 0, "user")]), F.lit(9 * H + 10_000))
    episodes = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (4, "a", 20), (3, "a", 20), (5, "a", 30), (6, "b", 10)], "id long, session string, ref long")
    got = {r.id: (r.by, r.via) for r in turns.answered(episodes, said).collect()}
    assert got == {1: (3, "answered"), 2: (3, "answered"), 3: (5, "answered"), 4: (5, "answered"), 5: (None, None), 6: (None, None)}


def test_stuck_runs(spark, tmp_path):
    beat = lambda session, at, ok=None: {"hook": "h", "session": session, "at": at, "ok": ok, "ms": 1.0 if ok is not None else None}
    batches = [
        [beat("quick", 1_000), beat("quick", 2_000, 1), beat("slow", 1_000), beat("dead", 1_000)],
        [beat("x", 200_000, 1)],  # two minutes have passed
        [beat("slow", 300_000, 0), beat("x", 300_001, 1)],
        [beat("x", 3_700_000, 1)],
        [beat("x", 3_800_000, 1)],
    ]
    seen = streamed(spark, tmp_path, batches, timers.stuck_runs, st.BEAT, "runs")
    told = [{x[1:5] for x in rows if x[1] != "x"} for rows in seen]
    assert told[0] == {("quick", 1_000, "finished", 1)}
    assert told[2] - told[0] == {("slow", 1_000, "stuck", None), ("dead", 1_000, "stuck", None), ("slow", 1_000, "finished", 0)}
    assert told[4] - told[2] == {("dead", 1_000, "gone", None)}
    rows = spark.createDataFrame([(r["hook"], r["session"], r["at"], r["ok"]) for b in batches for r in b], "hook string, session string, at long, ok int")
    clocks = spark.createDataFrame([(121_000,), (120_999,), (3_600_999,), (3_601_000,)], "clock long")
    got = {(r.clock, r.session) for r in turns.stuck_runs(rows, clocks).collect()}
    assert got == {(121_000, "slow"), (121_000, "dead"), (3_600_999, "dead")}


def test_wall_clock(spark, tmp_path):
    """An hour of wall clock hasn't passed; a timer of no length has. One batch: with such timers a stream never has nothing to do."""
    lines(tmp_path / "in/a.json", [line("a", 0, 0, "user", "q")])
    for idle, want in ((10**15, []), (1, ["released"])):
        rows = timers.held_turns(st.log(spark, str(tmp_path / "in"), LINES), clock="processing", idle_ms=idle)
        out = rows.writeStream.option("checkpointLocation", str(tmp_path / f"c{idle}")).format("memory").queryName(f"wall{idle}").trigger(once=True).start()
        assert out.awaitTermination(120)
        assert [r.what for r in spark.table(f"wall{idle}").collect()] == want
