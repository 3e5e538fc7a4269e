"""Timers over streams: turns that wait for their answer, and runs that don't come to an end.

State is one turn of a session (``held_turns``) or one open run (``stuck_runs``). What is
emitted depends on the lines and on the clock alone, not on how lines are cut into
batches: where two lines of a batch are further apart than the timer, the timer's work
is done between them. Timers go by event time, so that a replay gives the same rows, or
by the wall clock where ``clock`` is "processing".
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.turns import GONE_MS, IDLE_MS, STUCK_MS

READINGS = "session string, begin bigint, end bigint, prompt string, answers bigint, what string, closed string, replaces bigint"
TURN = "begin bigint, end bigint, prompt string, answers bigint, at bigint, fresh boolean, replaces bigint"
RUNS = "hook string, session string, started_at bigint, what string, ok int, ms double"
LATE = "10 minutes"
CLOCKS = {"event": GroupStateTimeout.EventTimeTimeout, "processing": GroupStateTimeout.ProcessingTimeTimeout}


def timed(lines: DataFrame, clock: str, late: str) -> DataFrame:
    return lines.withColumn("stamp", F.timestamp_millis("at")).withWatermark("stamp", late) if clock == "event" else lines.withColumn("stamp", F.timestamp_millis("at"))


def wait(state: GroupState, until: int, clock: str) -> bool:
    """Sets the timer; false if its time has come already."""
    if clock == "processing":
        left = until - state.getCurrentProcessingTimeMs()
        if left > 0:
            state.setTimeoutDuration(left)
        return left > 0
    passed = until <= max(0, state.getCurrentWatermarkMs())
    if not passed:
        state.setTimeoutTimestamp(until)
    return not passed


def held_turns(lines: DataFrame, idle_ms: int = IDLE_MS, clock: str = "event", late: str = LATE) -> DataFrame:
    """Readings of turns (see operators.turns) as they are over, from lines session, at, begin, end, role, text."""

    def read(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        turn = dict(zip((f.split()[0] for f in TURN.split(", ")), state.get, strict=True)) if state.exists else None

        def over(closed: str) -> None:
            if turn is None or not turn["fresh"]:
                return
            what = "grown" if turn["replaces"] is not None else "stored" if turn["answers"] or closed == "prompt" else "released"
            out.append((key[0], turn["begin"], turn["end"], turn["prompt"], turn["answers"], what, closed, turn["replaces"]))
            turn.update(fresh=False, replaces=turn["end"])

        if state.hasTimedOut:
            over("idle")
        else:
            for r in pd.concat(list(batches)).sort_values("begin", kind="stable").itertuples():
                if turn is not None and turn["at"] is not None and r.at - turn["at"] >= idle_ms:
                    over("idle")
                if r.role == "user":
                    over("prompt")
                    turn = {"begin": r.begin, "end": r.end, "prompt": r.text, "answers": 0, "at": r.at, "fresh": True, "replaces": None}
                elif turn is not None and r.role == "end":
                    over("end")
                    turn["at"] = r.at
                elif turn is not None:
                    turn.update(end=r.end, answers=turn["answers"] + 1, at=r.at, fresh=True)
        if turn is not None:
            if turn["fresh"] and not wait(state, turn["at"] + idle_ms, clock):
                over("idle")
            state.update(tuple(None if x is None else bool(x) if isinstance(x, bool) else x if isinstance(x, str) else int(x) for x in turn.values()))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in READINGS.split(", ")])

    return timed(lines, clock, late).groupBy("session").applyInPandasWithState(read, READINGS, TURN, "append", CLOCKS[clock])


def stuck_runs(lines: DataFrame, stuck_ms: int = STUCK_MS, gone_ms: int = GONE_MS, clock: str = "event", late: str = "0 seconds") -> DataFrame:
    """Runs from lines hook, session, at, ok (null: a start), ms: finished; stuck once it has been open for stuck_ms; gone when gone_ms pass without an end."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        began, told = state.get if state.exists else (None, False)

        def pass_to(now: int) -> None:
            """What the timers tell up to now."""
            nonlocal began, told
            if began is not None and not told and now - began >= stuck_ms:
                out.append((*key, began, "stuck", None, None))
                told = True
            if began is not None and now - began >= gone_ms:
                out.append((*key, began, "gone", None, None))
                began, told = None, False

        if state.hasTimedOut:
            pass_to(began + (gone_ms if told else stuck_ms))
        else:
            for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
                pass_to(int(r.at))
                if pd.isna(r.ok):
                    began, told = int(r.at), False
                else:
                    out.append((*key, int(r.at) if began is None else began, "finished", int(r.ok), None if pd.isna(r.ms) else float(r.ms)))
                    began, told = None, False
        while began is not None and not wait(state, began + (gone_ms if told else stuck_ms), clock):
            pass_to(began + (gone_ms if told else stuck_ms))
        if began is None:
            state.remove()
        else:
            state.update((began, told))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in RUNS.split(", ")]).astype({"ok": "Int32"})

    return timed(lines, clock, late).groupBy("hook", "session").applyInPandasWithState(watch, RUNS, "began bigint, told boolean", "append", CLOCKS[clock])
