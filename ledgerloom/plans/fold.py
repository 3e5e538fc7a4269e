"""The ordered fold: statements of a store, one after the other, each seeing what its predecessors left.

Most ledger operators are set operations (operators.ledger). Those whose outcome
depends on the store as it stood need order: supersession by words and by
quantity, restatement and its undo, and conflict marks for what arrives late.
Spark groups statements by store, and a small state machine folds each store; its
state holds CAP standing statements and the CAP that were retired last, and the same
machine runs per batch (``fold``) and over a stream (``streaming.ledger``).

Rules, in order, for a new statement that a person made: one with the same key and
another object replaces the older one (cause ``key``); a decision replaces the
standing decision that shares two topic words or more, and half of the smaller set
(a third for an announced change), if it announces a change or names a new value
(``said``); a bare quantity replaces the newest standing holder of its unit with
another number (``quantity``). Nothing is replaced by what is dated earlier: the
two are marked as a conflict. A statement said again revives its retired
original, unless what retired it is newer still. An undo of a statement returns
what it had retired, if nothing has changed it since.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.functions.text import STOP_WORDS

STOP = frozenset(STOP_WORDS)
CHANGE = re.compile(r"\b(switch(ed|ing)? to|instead of|no longer|moved? to|replac(e|ed|ing)|rather than)\b")
WORD = re.compile(r"[^\W_]+")
CAP = 20_000


def topic_words(text: str) -> frozenset[str]:
    return frozenset(w for w in WORD.findall(text.lower()) if len(w) >= 3 and not w.isdigit() and w not in STOP)


def slots(text: str) -> frozenset[tuple[str, str]]:
    w = WORD.findall(text.lower())
    out = set()
    for a, b in zip(w, w[1:]):
        for n, unit in ((a, b), (b, a)):
            if n.isdigit() and len(unit) >= 3 and not any(c.isdigit() for c in unit) and unit not in STOP:
                out.add((unit, n))
    return frozenset(out)


@dataclass
class Entry:
    id: int
    kind: str
    key: str
    body: str
    created: int
    words: frozenset[str]
    slots: frozenset[tuple[str, str]]
    by: int | None = None
    via: str | None = None


@dataclass
class Store:
    """Standing and retired statements of one store; events tell what each step did."""

    entries: dict[int, Entry] = field(default_factory=dict)
    said: dict[tuple[str, str, str], int] = field(default_factory=dict)
    live: dict[int, Entry] = field(default_factory=dict)
    retired: dict[int, None] = field(default_factory=dict)
    seq: int = 0

    def standing(self) -> list[Entry]:
        return list(self.live.values())

    def _retire(self, e: Entry, by: int | None, via: str) -> None:
        e.by, e.via = by, via
        self.live.pop(e.id, None)
        self.retired[e.id] = None
        if len(self.retired) > CAP:  # the one that was retired first is forgotten
            old = self.entries.pop(next(iter(self.retired)))
            del self.retired[old.id]
            self.said.pop((old.kind, old.key, old.body), None)

    def _revive(self, e: Entry) -> None:
        e.by = e.via = None
        self.retired.pop(e.id, None)
        self.live[e.id] = e

    def step(self, id: int, op: str, kind: str, key: str, body: str, created: int, target: int | None = None) -> Iterator[tuple[int, str, int | None, str]]:
        """(id, what, other, cause): what is stored, retired, revived, undone or in conflict."""
        if op == "undo":
            yield from self._undo(id, target)
            return
        hashed = (kind, key, body)
        if hashed in self.said:
            yield from self._again(id, self.said[hashed], created)
            return
        e = Entry(id, kind, key, body, created, topic_words(body), slots(body))
        self.said[hashed] = id
        yield id, "stored", None, ""
        for old, via in list(self._replaced(e)):
            if old.created > e.created:
                yield e.id, "conflict", old.id, via
            else:
                self._retire(old, e.id, via)
                yield old.id, "retired", e.id, via
        self.entries[id] = self.live[id] = e
        if len(self.live) > CAP:
            oldest = min((x for x in self.standing() if x.kind == "episode"), key=lambda x: (x.created, x.id), default=None)
            if oldest:
                self._retire(oldest, None, "cap")
                yield oldest.id, "retired", None, "cap"

    def _replaced(self, e: Entry) -> Iterator[tuple[Entry, str]]:
        standing = self.standing()
        done: set[int] = set()
        if e.kind not in ("episode", "correction") and e.key:
            for o in standing:
                if o.key == e.key and o.kind == e.kind and o.body != e.body:
                    done.add(o.id)
                    yield o, "key"
        if e.kind != "decision":
            return
        change = bool(CHANGE.search(e.body.lower()))
        for o in standing:
            if o.kind == "decision" and o.id not in done:
                shared, small = len(o.words & e.words), min(len(o.words), len(e.words))
                if shared >= 2 and shared >= (0.34 if change else 0.5) * small and (change or e.words - o.words):
                    done.add(o.id)
                    yield o, "said"
        if e.slots and len(e.words - {u for u, _ in e.slots}) <= 1:
            for unit, number in sorted(e.slots):
                held = [o for o in standing if o.id not in done and any(u == unit and n != number for u, n in o.slots)]
                if held:
                    newest = max(held, key=lambda o: o.id)
                    done.add(newest.id)
                    yield newest, "quantity"

    def _again(self, id: int, first: int, created: int) -> Iterator[tuple[int, str, int | None, str]]:
        e = self.entries[first]
        cause = self.entries.get(e.by) if e.by is not None else None
        if e.by is None and e.via is None:
            e.created = max(e.created, created)
            yield first, "moved", id, "restated"
        elif cause is None or cause.created <= created:
            self._revive(e)
            e.created = created
            yield first, "revived", id, "restated"
            if cause is not None and cause.by is None and cause.via is None:
                self._retire(cause, first, "restated")
                yield cause.id, "retired", first, "restated"

    def _undo(self, id: int, target: int | None) -> Iterator[tuple[int, str, int | None, str]]:
        e = self.entries.get(target) if target is not None else None
        if e is None or e.via is not None:
            return
        self._retire(e, None, "revoked")
        yield e.id, "revoked", id, "undo"
        for o in [x for x in self.entries.values() if x.by == e.id]:
            # not where something that stands now has taken its key meanwhile
            if not any(o.key and x.key == o.key and x.kind == o.kind and x.body != o.body for x in self.live.values()):
                self._revive(o)
                yield o.id, "revived", e.id, "undo"


EVENTS = "store bigint, seq bigint, id bigint, what string, other bigint, cause string"


def run(store: int, rows: pd.DataFrame, state: Store | None = None) -> pd.DataFrame:
    """The events of one store's statements, in the order of their ids."""
    state = state or Store()
    out = []
    for r in rows.sort_values("id").itertuples():
        target = None if pd.isna(r.target) else int(r.target)
        for e in state.step(int(r.id), r.op, r.kind, r.key or "", r.body or "", int(r.created), target):
            out.append((store, state.seq, *e))
            state.seq += 1
    got = pd.DataFrame(out, columns=["store", "seq", "id", "what", "other", "cause"])
    return got.astype({"other": "Int64"})


def fold(statements: DataFrame) -> DataFrame:
    """Events from columns store, id, op (say, undo), kind, key, body, created and target. A store is bounded by its cap."""
    return statements.groupBy("store").applyInPandas(lambda k, rows: run(int(k[0]), rows), EVENTS)
