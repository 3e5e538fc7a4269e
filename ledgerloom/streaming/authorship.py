"""Authorship and the ledger over streams, in signed rows: late evidence takes back what was said before.

Two stages, each with keyed state and its own checkpoint, and between them a folder of
changes that the first appends to and the second reads:

* ``authored``, by hash: statements and handed-over tasks meet. A statement is emitted
  as it is known, and once more, the old row with sign -1, where a task turns its
  author round;
* ``ledger``, by kind and key: the statements of a key and who supersedes whom. Each
  change of a state is emitted as the old row with sign -1 and the new one with +1.

The sum of the signs is the ledger (``standing``), the same for any order and any cut
of the input, and the same as ``operators.authorship.settle``. A statement that comes
twice counts once. A hash or key is held by one task; statements of one hash are spread
over ``SALTS`` parts, to each of which its tasks go.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: what is say or task; a task has session and hash only.
INPUT = "what string, id bigint, session string, hash string, kind string, key string, object string, created bigint"
CHANGES = "sign int, id bigint, kind string, key string, object string, created bigint, agent boolean"
STATES = "sign int, id bigint, state string, by bigint, via string"
SALTS = 16


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def authored(rows: DataFrame) -> DataFrame:
    """CHANGES of rows of INPUT."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"tasks": [], "said": {}}
        rows = pd.concat(list(batches))
        sessions = set(held["tasks"]) | set(rows.loc[rows["what"] == "task", "session"])
        held["tasks"] = sorted({min(sessions), max(sessions)}) if sessions else []
        out = []
        for id, said in held["said"].items():
            agent = any(t != said["session"] for t in held["tasks"])
            if agent != said["agent"]:
                out += [(-1, int(id), *said["row"], said["agent"]), (1, int(id), *said["row"], agent)]
                said["agent"] = agent
        for r in rows[rows["what"] == "say"].itertuples():
            if str(r.id) not in held["said"]:
                agent = r.hash is not None and any(t != r.session for t in held["tasks"])
                row = [r.kind, r.key, r.object, int(r.created)]
                held["said"][str(r.id)] = {"session": r.session, "row": row, "agent": agent}
                out.append((1, int(r.id), *row, agent))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=names(CHANGES))

    one = F.when(F.col("what") == "task", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    whole = {c: F.coalesce(c, F.lit(0)) for c in ("id", "created")}  # a null would make a column of floats
    keyed = rows.withColumns(whole).where("what = 'say' or hash is not null").withColumn("by_hash", F.coalesce("hash", F.concat(F.lit("id:"), F.col("id").cast("string")))).withColumn("salt", F.explode(one))
    return keyed.groupBy("by_hash", "salt").applyInPandasWithState(step, CHANGES, "held string", "append", GroupStateTimeout.NoTimeout)


def states_of(kind: str, said: dict[int, tuple]) -> dict[int, tuple]:
    """id: (state, by, via) of a key's statements id: (object, created, agent)."""
    out: dict[int, tuple] = {}
    if kind == "episode":
        for i, (_, _, agent) in said.items():
            out[i] = ("relabelled", -i, "agent_prompt") if agent else ("standing", None, None)
            if agent:
                out[-i] = ("standing", None, None)
        return out
    after, heir = None, None  # the object that follows, and the first of its run
    run: list[int] = []
    for i in sorted((i for i, s in said.items() if not s[2]), key=lambda i: (said[i][1], i), reverse=True):
        if said[i][0] != after and run:
            heir, run = run[-1], []
        after = said[i][0]
        run.append(i)
        out[i] = ("standing", None, None) if heir is None else ("superseded", heir, "key")
    return out | {i: ("revoked", None, "agent_prompt") for i, s in said.items() if s[2]}


def ledger(changes: DataFrame) -> DataFrame:
    """STATES of rows of CHANGES."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said = {int(i): tuple(s) for i, s in json.loads(state.get[0]).items()} if state.exists else {}
        old = states_of(key[0], said)
        sums: Counter = Counter()
        for r in pd.concat(list(batches)).itertuples():
            sums[int(r.id), r.object, int(r.created), bool(r.agent)] += int(r.sign)
        for (i, *row), n in sums.items():
            if n < 0 and said.get(i) == tuple(row):
                del said[i]
        for (i, *row), n in sums.items():
            if n > 0:
                said[i] = tuple(row)
        new = states_of(key[0], said)
        out = [(-1, i, *s) for i, s in old.items() if new.get(i) != s] + [(1, i, *s) for i, s in new.items() if old.get(i) != s]
        state.update((json.dumps(said),))
        yield pd.DataFrame(out, columns=names(STATES)).astype({"by": "Int64"})

    return changes.groupBy("kind", "key").applyInPandasWithState(step, STATES, "said string", "append", GroupStateTimeout.NoTimeout)


def standing(states: DataFrame) -> DataFrame:
    """What signed rows come to: (id, state, by, via)."""
    return states.groupBy("id", "state", "by", "via").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")
