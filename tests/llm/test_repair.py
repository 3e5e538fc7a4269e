import hashlib
import itertools
import random
import re

import pytest

from ledgerloom.llm import repair

ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "": ""}


def cost_of(audit, rows):
    """Cost of an audit of rows (role, kind), or None where it isn't allowed; every new role is tried."""
    best, todo = None, [(0, 0, 0, "")]
    while todo:
        i, at, cost, roles = todo.pop()
        if i == len(audit):
            if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or cost < best):
                best = cost
            continue
        edit = audit[i]
        if edit == "I":
            todo += [(i + 1, at, cost + 5, roles + r) for r in "ua"]
        elif at < len(rows):
            role, kind = rows[at]
            if edit == "D":
                todo.append((i + 1, at + 1, cost + 2, roles))
            elif kind not in (1, 2):
                extra = 5 * (kind == 3)
                if edit == "K" and role:
                    todo.append((i + 1, at + 1, cost + extra, roles + role))
                elif edit == "R":
                    todo += [(i + 1, at + 1, cost + 1 + extra, roles + r) for r in "ua"]
    return best


def brute(rows):
    found = []
    for extra in range(3):  # deleting everything is cheaper than more inserts in so few rows
        for audit in itertools.product("DIKR", repeat=len(rows) + extra):
            audit = "".join(audit)
            if audit.count("I") == extra and (cost := cost_of(audit, rows)) is not None:
                found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        rows = [(rnd.choice(["s", "u", "u", "a", "a", "x", ""]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 5))]
        dp = repair.Audit()
        for role, kind in rows:
            dp.row(role, kind in (1, 2), kind == 3)
        assert dp.end() == brute(rows), rows


def plain(rows):
    """The same DP with audits as whole strings."""
    best = {0: (0, "")}

    def offer(to, state, cost, audit):
        to[state] = min(to.get(state, (cost, audit)), (cost, audit))

    def insert(b):
        for _ in range(4):
            for state, (cost, audit) in list(b.items()):
                for role in "ua":
                    if state in repair.STEPS[role]:
                        offer(b, repair.STEPS[role][state], cost + 5, audit + "I")

    for role, kind in rows:
        insert(best)
        new = {}
        for state, (cost, audit) in best.items():
            offer(new, state, cost + 2, audit + "D")
            if kind not in (1, 2):
                cost += 5 * (kind == 3)
                if state in repair.STEPS.get(role, ()):
                    offer(new, repair.STEPS[role][state], cost, audit + "K")
                for to in "ua":
                    if state in repair.STEPS[to]:
                        offer(new, repair.STEPS[to][state], cost + 1, audit + "R")
        best = new
    if not rows:
        return 0, ""
    insert(best)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("settle,base", [(256, repair.BASE), (7, repair.BASE), (1, repair.BASE), (5, 0), (1 << 30, 1)])
def test_long_conversations_and_colliding_hashes(monkeypatch, settle, base):
    """base 0: the hash is the last letter; base 1: the sum of letters. Both collide all the time."""
    monkeypatch.setattr(repair, "SETTLE", settle)
    monkeypatch.setattr(repair, "BASE", base)
    rnd = random.Random(settle + base)
    for n in (40, 300, 900):
        rows = [(rnd.choice("suuaaax"), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
        dp = repair.Audit()
        for role, kind in rows:
            dp.row(role, kind in (1, 2), kind == 3)
        assert dp.end() == plain(rows)


def test_live_state_stays_small():
    dp, rnd = repair.Audit(), random.Random(5)
    for _ in range(20_000):
        dp.row(rnd.choice("ua"), False, rnd.random() < 0.2)
    assert max(held[1].depth for held in dp.best if held is not None) < 2 * repair.SETTLE


def test_rows_ties_and_nulls(spark):
    rows = [
        (1, 0, "system", "Be kind.", 1), (1, 1, "user", "Hello.", 2), (1, 2, "assistant", "Hi", 1), (1, 5, "user", "Hello.", 1), (1, 6, "assistant", "Bye!", 1),
        (2, None, "user", "What?", 1), (2, None, "assistant", "That.", 1), (2, None, "assistant", "That.", 1),
        (3, 0, "user", "gone.", 0), (None, 4, "assistant", " ", 1), (None, 9, "", "Role.", 1), (4, 0, "user", "x" * 300_000 + ".", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").repartition(5)
    got = {r.conv_id: r.asDict() for r in repair.repair(spark, df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None}
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (2, 0, 2, 1, 1)
    assert (one["audit"], one["cost"]) == ("KKDDDK", 6)
    assert one["repaired_sha256"] == sha("system:Be kind.\nuser:Hello.\nassistant:Bye!")
    two = got[2]
    assert (two["gaps"], two["duplicate"], two["illegal"], two["audit"], two["cost"]) == (0, 1, 1, "RDR", 4)
    assert (got[3]["cost"], got[3]["audit"], got[3]["repaired_sha256"]) == (0, "", sha(""))
    assert (got[None]["blank"], got[None]["gaps"], got[None]["audit"]) == (1, 4, "DD")
    assert (got[4]["audit"], got[4]["cost"]) == ("D", 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert repair.repair(spark, repair.damaged(df)).collect() == []
