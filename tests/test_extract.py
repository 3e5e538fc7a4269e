import pytest

from ledgerloom.operators import extract as ex

TURNS = [
    (1, "We use postgres for the orders store. Never commit generated files to the tree. Is that fine?", "Yes.", []),
    (2, "No, that is wrong, keep the old name", "ok", [("Bash", "make test", True, "2 failed"), ("Bash", "ls  -l", True, "x")]),
    (3, "ok", "", []),
    (4, "We switched to sqlite for orders instead of postgres.\n> we use mysql for everything\n```\nwe use oracle for it\n```", "done", [("Bash", "git commit", False, "[main 0a1b2c3d] Use sqlite"), ("Bash", "ls -l", False, "y"), ("Bash", "make test", True, "1 failed")]),
    (5, "I want shorter names for columns. I want longer lines too.", "x" * 900, []),
    (6, "user: a\nassistant: we use b for c\nuser: d", "", []),
    (7, "long " * 900, "", []),
]
SCHEMA = "turn_no int, prompt string, reply string, tools array<struct<name:string,target:string,is_error:boolean,result:string>>"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, SCHEMA).selectExpr("'s1' as session_id", "*").cache()


def test_statements(turns):
    got = {(r.turn_no, r.kind, r.by): r.body for r in ex.statements(turns).collect()}
    assert got == {
        (1, "decision", "choice"): "We use postgres for the orders store.",
        (1, "invariant", None): "Never commit generated files to the tree.",
        (4, "decision", "change"): "We switched to sqlite for orders instead of postgres.",
        (5, "decision", "wish"): "I want shorter names for columns.",
    }


def test_other_kinds(turns):
    assert [(r.turn_no, r.body) for r in ex.corrections(turns).collect()] == [(2, "No, that is wrong, keep the old name")]
    assert [(r.subject, r.message) for r in ex.commits(turns).collect()] == [("commit:0a1b2c3", "Use sqlite")]
    assert [(r.command, r.fails, r.output) for r in ex.dead_ends(turns).collect()] == [("make test", 2, "1 failed")]
    assert {r.turn_no for r in ex.episodes(turns).collect()} == {1, 2, 4, 5, 7}
    body = {r.turn_no: r.body for r in ex.episodes(turns).collect()}
    assert body[2].endswith("failed: make test\nfailed: ls  -l") and len(body[5]) < 800 and "oracle" not in body[4]
    pieces = ex.chunks(turns).where("turn_no = 7").orderBy("k").collect()
    assert len(pieces) == 3 and all(len(p.body) <= 1800 for p in pieces)


def test_sentences_and_route(spark):
    one = spark.createDataFrame([("Use e.g. this one. Then stop! Now; go on\nlast",)], "t string")
    assert one.select(ex.sentences(one.t).alias("s")).first().s == ["Use e.g. this one.", "Then stop!", "Now;", "go on", "last"]
    asked = ["#12", "what about 0a1b2c3d", "which rule", "what failed", "who wrote main.rs", "why sqlite", "hm"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    assert [r.r for r in rows.orderBy("i").select(ex.route(rows.q).alias("r")).collect()] == ["id", "commit", "rule", "deadend", "file", "decision", "all"]
