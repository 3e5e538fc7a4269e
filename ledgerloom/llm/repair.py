"""Conversation structure repair: the cheapest edits that make turns alternate, by a persistent audit DP.

Roles must read ``(s?(ua)+)?``, by their first letter: four states. Row by row, each
state keeps its cheapest audit, the letters of the edits so far; ties go to the audit
that comes first in ASCII. Audits are nodes linked to their prefixes, which states
share; a node holds its ancestors 2**i letters back and a rolling hash of its letters.
Two audits of a tie are compared at the first letter that differs, which a descent
over the ancestors finds by equal hashes; what the hashes call equal is then walked
to the first shared node, and compared letter by letter where it isn't equal.

Of two audits that have used the same rows at the same cost neither is the other's
beginning (the rest would be inserts, which cost), so that the order of two audits
never changes with what follows, and a state needs one.

Texts take no part in the DP: a row is a code of one byte and 32 bytes of digest.
Rows of a conversation stream through one task in order, whatever their number; its
state is the four audits, whose common beginning is taken out as letters every
``SETTLE`` rows, so that a long conversation holds no more than the audit it returns.
Rows that repeat earlier ones are found by an aggregation with map-side combining and
a join that Spark can split, not by what a task remembers. A second stream applies the
audit to the texts, one row at a time, under SHA-256, which goes in order by nature.

Defined cases: rows go by turn, nulls first, then by role and by the text's digest; a
null conversation is a conversation; a null turn, role or text stands as one space
(a null turn has no part in gaps); a role that is empty or begins otherwise than with
s, u or a can't be kept; repeated rows are duplicates; a conversation with no row left
has zeros, an empty audit and the digest of nothing; an empty table gives an empty
result; very long texts are held one at a time; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, table

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 1, 2, 5, 5
#: From any state two inserts and one row less lead to whatever another state can have: one that costs more by over FAR can't win.
FAR = 2 * INSERT + DELETE
#: Rows after which the common beginning of the four audits is taken out.
SETTLE = 256
#: From a state over a role to a state. 0: nothing yet; 1: after the system's turn; 2: after a user's; 3: after an assistant's.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
BASE, PRIME = 1_000_003, (1 << 61) - 1
SPACE, END = " \t\n\x0b\x0c\r", "[.!?]"


class Node:
    """An audit: its last letter, its prefix, and marks to compare it by."""

    __slots__ = ("above", "depth", "hash", "letter")

    def __init__(self, letter: str, prefix: Node | None):
        self.letter = letter
        if prefix is None:
            self.depth, self.hash, self.above = 0, 0, []
            return
        self.depth, self.hash = prefix.depth + 1, (prefix.hash * BASE + ord(letter)) % PRIME
        above, i = [prefix], 0
        while i < len(above[i].above):
            above.append(above[i].above[i])
            i += 1
        self.above = above

    def back(self, n: int) -> Node:
        node, i = self, 0
        while n:
            if n & 1:
                node = node.above[i]
            n, i = n >> 1, i + 1
        return node

    def letters(self, upto: Node | None = None) -> str:
        """The letters after upto, or after the root."""
        out, node = [], self
        while node is not upto and node.above:
            out.append(node.letter)
            node = node.above[0]
        return "".join(reversed(out))


def shared(a: Node, b: Node) -> Node:
    """The deepest node that both are built on."""
    a, b = (a.back(a.depth - b.depth), b) if a.depth > b.depth else (a, b.back(b.depth - a.depth))
    for i in range(len(a.above) - 1, -1, -1):
        if i < len(a.above) and a.above[i] is not b.above[i]:
            a, b = a.above[i], b.above[i]
    return a if a is b else a.above[0]


def before(a: Node, b: Node) -> bool:
    """Whether audit a comes before audit b in ASCII; neither begins with the other, unless they are equal."""
    if a is b:
        return False
    x, y = (a.back(a.depth - b.depth), b) if a.depth > b.depth else (a, b.back(b.depth - a.depth))
    if x.hash == y.hash:
        return _walked(a, b, x, y)
    for i in range(len(x.above) - 1, -1, -1):  # down to the first letters that differ
        if i < len(x.above) and x.above[i].hash != y.above[i].hash:
            x, y = x.above[i], y.above[i]
    return x.letter < y.letter if _same(x.above[0], y.above[0]) else a.letters() < b.letters()


def _same(x: Node, y: Node) -> bool:
    """Whether what equal hashes call equal is so."""
    while x is not y:
        if x.letter != y.letter:
            return False
        x, y = x.above[0], y.above[0]
    return True


def _walked(a: Node, b: Node, x: Node, y: Node) -> bool:
    """One begins with the other by hashes: the shorter is first, if it is so."""
    return a.depth < b.depth if _same(x, y) else a.letters() < b.letters()


class Audit:
    """The DP over a conversation's rows."""

    def __init__(self):
        self.rows, self.settled = 0, []
        self.best: list[tuple[int, Node] | None] = [(0, Node("", None)), None, None, None]

    def _offer(self, best: list, state: int, cost: int, prefix: Node, letter: str) -> bool:
        held = best[state]
        if held is not None and (cost > held[0] or cost == held[0] and not before(made := Node(letter, prefix), held[1])):
            return False
        best[state] = (cost, made if held is not None and cost == held[0] else Node(letter, prefix))
        return True

    def _insert(self) -> None:
        """What states reach by inserts; two in a row lead through all."""
        for _ in range(2):
            for role in "ua":
                for state, to in STEPS[role].items():
                    if self.best[state] is not None:
                        cost, node = self.best[state]
                        self._offer(self.best, to, cost + INSERT, node, "I")

    def row(self, role: str, must_go: bool, unended: bool) -> None:
        self._insert()
        old, self.best = self.best, [None] * 4
        for state, held in enumerate(old):
            if held is None:
                continue
            cost, node = held
            self._offer(self.best, state, cost + DELETE, node, "D")
            if must_go:
                continue
            cost += UNENDED * unended
            if state in STEPS.get(role, ()):
                self._offer(self.best, STEPS[role][state], cost + KEEP, node, "K")
            for to in "ua":
                if state in STEPS[to]:
                    self._offer(self.best, STEPS[to][state], cost + REROLE, node, "R")
        least = min(held[0] for held in self.best if held is not None)
        self.best = [held if held is not None and held[0] <= least + FAR else None for held in self.best]
        self.rows += 1
        if self.rows % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        live = [held[1] for held in self.best if held is not None]
        root = live[0]
        for node in live[1:]:
            root = shared(root, node)
        if not root.above:
            return
        self.settled.append(root.letters())
        fresh, grown = Node("", None), {}
        for i, held in enumerate(self.best):
            if held is not None:
                node = fresh
                for letter in held[1].letters(root):
                    node = grown.get((id(node), letter)) or grown.setdefault((id(node), letter), Node(letter, node))
                self.best[i] = (held[0], node)

    def end(self) -> tuple[int, str]:
        """(cost, audit)"""
        if not self.rows:
            return 0, ""
        self._insert()
        cost, node = None, None
        for state in ENDS:
            held = self.best[state]
            if held is not None and (cost is None or held[0] < cost or held[0] == cost and before(held[1], node)):
                cost, node = held
        return cost, "".join(self.settled) + node.letters()


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that the audit makes of the rows; it alone tells the new roles, as they alternate."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = STEPS[role[0]][state]
        else:
            state = 3 if state == 2 else 2
            role = NAMES["a" if state == 3 else "u"]
        yield role, text


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: what the damage leaves; rows of no copies tell that there was a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    out = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), END, "")).otherwise(text("text"))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(text("role")).alias("role"), out.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """The rows with digest (of the text), fault (0 none, 1 blank, 3 truncated) and again (role and text stand in an earlier turn)."""
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", 1).when(~last.rlike(END), 3).otherwise(0)
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("fault", fault)
    first = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
    first = first.where("not first.turn <=> last.turn").select(F.col("conv_id").alias("c"), F.col("role").alias("o"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("o")) & (F.col("digest") == F.col("d"))
    return rows.join(first, on, "left").withColumn("again", F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).drop("c", "o", "d", "first")


AUDITED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = AUDITED + ", repaired_sha256 string"


def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from rows that come in order."""
    held: list[tuple] = []
    for conv, rows in by_conversation(batches, "turn", "role", "digest", "fault", "again", "copies"):
        dp, faults, illegal, turns, least, most = Audit(), [0, 0, 0, 0], 0, 0, None, None
        before_it = initial = None
        for turn, role, digest, fault, again, copies in rows:
            for _ in range(copies):
                same = (turn, role, digest) == before_it
                kind = fault if fault == 1 else 2 if again or same else fault
                faults[kind] += 1
                illegal += initial is not None and initial + role[:1] not in ("su", "ua", "au")
                if turn is not None and turn != most:
                    turns, least, most = turns + 1, turn if least is None else least, turn
                dp.row(role[:1], kind in (1, 2), kind == 3)
                before_it, initial = (turn, role, digest), role[:1]
        cost, audit = dp.end()
        held.append((conv, most - least + 1 - turns if turns else 0, *faults[1:], illegal, cost, audit))
        if len(held) == 1000 or len(audit) > 1 << 20:
            yield batch_of(held, AUDITED)
            held = []
    if held:
        yield batch_of(held, AUDITED)


def by_conversation(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted batches; the rows are read as they are asked for."""
    stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", *columns)), strict=True))
    ahead = next(stream, None)
    while ahead is not None:
        conv = ahead[0]

        def rows():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:  # noqa: B023
                row, ahead = ahead, next(stream, None)
                yield row[1:]

        mine = rows()
        yield conv, mine
        for _ in mine:
            pass


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, {"bigint": pa.int64(), "string": pa.string()}[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was told of each conversation, which comes as the first of its rows, with the digest of the repaired one."""
    held = []
    for _, rows in by_conversation(batches, "told", "role", "text", "copies"):
        told = next(rows)[0]
        texts = ((role, text) for _, role, text, copies in rows for _ in range(copies))
        sha, lead = hashlib.sha256(), ""
        for role, text in edited(told["audit"], texts):
            sha.update(f"{lead}{role}:{text}".encode())
            lead = "\n"
        held.append((*told.values(), sha.hexdigest()))
        if len(held) == 1000 or len(told["audit"]) > 1 << 20:
            yield batch_of(held, REPAIRED)
            held = []
    if held:
        yield batch_of(held, REPAIRED)


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Audits of conversations (conv_id, turn, role, text, copies), with the digest of each repaired one."""
    bounded_batches(spark)
    key, order = F.xxhash64("conv_id"), ["conv_id", "turn", "role", "digest"]
    codes = marked(rows).select(*order, "fault", "again", "copies").repartition(key).sortWithinPartitions(*order)
    told = codes.mapInArrow(audits, AUDITED)
    lead = told.select("conv_id", F.struct("*").alias("told"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    texts = rows.where("copies > 0").select("conv_id", F.lit(None).cast(lead.schema["told"].dataType).alias("told"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    both = lead.union(texts).withColumn("part", F.col("told").isNull()).repartition(key).sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return both.select("conv_id", "told", "role", "text", "copies").mapInArrow(digests, REPAIRED)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def _oracle() -> str:
    """SQL for the damage, the faults and the DP, a row of a conversation at each step; a state is (cost, audit, repaired rows)."""
    far = "{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}"

    def take(state: str, cost: str, letter: str, row: str | None = None) -> str:
        rows = f"{state}.r" if row is None else f"list_append({state}.r, {row})"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {rows}}}"

    def least(*states: str) -> str:
        return f"list_sort([{', '.join(states)}])[1]"

    user, assistant = "'user:'", "'assistant:'"
    both = [take(take(f"q{s}", "5", "I", user), "5", "I", assistant) for s in (0, 1)]
    closed = f"q0 AS i0, q1 AS i1, {least('q2', *(take(f'q{s}', '5', 'I', user) for s in (0, 1, 3)))} AS i2, {least('q3', take('q2', '5', 'I', assistant), *both)} AS i3"
    stay = "CASE WHEN kind IN (1, 2) OR NOT {} THEN 1000000000 ELSE {} + CASE WHEN kind = 3 THEN 5 ELSE 0 END END"
    keep = {x: stay.format(f"initial = '{x}'", 0) for x in "sua"}
    rerole = stay.format("true", 1)
    drop = [take(f"i{s}", "2", "D") for s in range(4)]
    to_user = [take(f"i{s}", f"({c})", x, row) for s in (0, 1, 3) for c, x, row in ((keep["u"], "K", "whole"), (rerole, "R", "'user:' || text"))]
    to_assistant = [take("i2", f"({c})", x, row) for c, x, row in ((keep["a"], "K", "whole"), (rerole, "R", "'assistant:' || text"))]
    row = f"{drop[0]} AS q0, {least(drop[1], take('i0', '(' + keep['s'] + ')', 'K', 'whole'))} AS q1, {least(drop[2], *to_user)} AS q2, {least(drop[3], *to_assistant)} AS q3"
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda v, x: xor(v >> 8, crc.t[(xor(v, x) & 255) + 1])), 4294967295) % 20 AS hit FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE hit <> 0),
v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM v),
k AS (SELECT conv_id, turn, role || ':' || text AS whole, text, role[1] AS initial, i, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS kind, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM w),
s AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS q0, {far} AS q1, {far} AS q2, {far} AS q3 FROM s
  UNION ALL
  SELECT conv_id, i, {row} FROM (SELECT x.conv_id, k.i, k.whole, k.text, k.initial, k.kind, {closed} FROM dp x JOIN k ON k.conv_id IS NOT DISTINCT FROM x.conv_id AND k.i = x.i + 1)
),
e AS (SELECT conv_id, {least('i0', 'i3')} AS b FROM (SELECT conv_id, {closed} FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(e.b.c AS BIGINT), 0) AS cost, coalesce(e.b.a, '') AS audit, sha256(coalesce(array_to_string(e.b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


QUERIES = {"op13_repair": op13_repair}
ORACLES = {"op13_repair": _oracle()}
