"""Streams of log lines: folding, paired starts and finishes, epochs with a fixed gap, and the ledger's fold as keyed state.

Late data is never dropped where the rules say what it means: the ledger's state
resolves it. State holds one small value for each key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.plans.fold import EVENTS, Store, run

LOG = "at bigint, session string, reason string, ids array<bigint>, tokens bigint"
BEAT = "hook string, session string, at bigint, ok int, ms double"
GAP_MS = 30_000


def log(spark: SparkSession, path: str, schema: str = LOG, files: int = 64) -> DataFrame:
    """New files of JSON lines, some at a time; the checkpoint remembers what is done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def deliveries(lines: DataFrame) -> DataFrame:
    """One row for each delivered id; a line's tokens are split by whole division; a line without ids stays one row."""
    n = F.greatest(F.size(F.coalesce("ids", F.array().cast("array<bigint>"))), F.lit(1))
    return lines.select("at", "session", "reason", F.explode_outer("ids").alias("record"), F.expr("tokens div 1").alias("tokens"), n.alias("n")).select("at", "session", "reason", "record", F.expr("tokens div n").alias("tokens"))


def by_reason(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def beats(lines: DataFrame) -> DataFrame:
    """Hook runs: a finish completes the open start of its key; a finish without a start is a run of its own."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_at = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            if pd.isna(r.ok):
                open_at = int(r.at)
            else:
                out.append((*key, open_at if open_at is not None else int(r.at), int(r.ok), None if pd.isna(r.ms) else float(r.ms)))
                open_at = None
        state.update((open_at,))
        yield pd.DataFrame(out, columns=["hook", "session", "started_at", "ok", "ms"])

    return lines.groupBy("hook", "session").applyInPandasWithState(pair, "hook string, session string, started_at bigint, ok int, ms double", "open bigint", "append", GroupStateTimeout.NoTimeout)


def epochs(lines: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Compaction epochs of each session: a new one begins gap_ms or more after the last began; events between don't extend it."""

    def bump(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for at in sorted(int(x) for b in batches for x in b["at"]):
            if last is None or at - last >= gap_ms:
                last, n = at, n + 1
                out.append((*key, n, at))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["session", "epoch", "began"])

    return lines.groupBy("session").applyInPandasWithState(bump, "session string, epoch int, began bigint", "last bigint, n int", "append", GroupStateTimeout.NoTimeout)


def ledger(statements: DataFrame) -> DataFrame:
    """The ordered fold over a stream: each store's standing statements are its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = pickle.loads(state.get[0]) if state.exists else Store()
        yield run(int(key[0]), pd.concat(list(batches)), store)
        state.update((pickle.dumps(store),))

    return statements.groupBy("store").applyInPandasWithState(step, EVENTS, "store binary", "append", GroupStateTimeout.NoTimeout)


def to_end(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is, into the in-memory table name, or, if name is a path, as files there."""
    out = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out = out.format("parquet").option("path", name) if "/" in name else out.format("memory").queryName(name)
    out.start().awaitTermination()
