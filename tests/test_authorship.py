import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import authorship
from ledgerloom.streaming import authorship as stream
from ledgerloom.streaming import telemetry as st


def say(id, session, hash, key, object, kind="decision", created=None):
    return {"what": "say", "id": id, "session": session, "hash": hash, "kind": kind, "key": key, "object": object, "created": id if created is None else created}


def task(session, hash):
    return {"what": "task", "id": None, "session": session, "hash": hash, "kind": None, "key": None, "object": None, "created": None}


def streamed(spark, tmp_path, batches, name):
    """The ledger after each batch: both stages run over what there is."""
    at, ledgers = tmp_path / name, []
    (at / "in").mkdir(parents=True)
    for i, rows in enumerate(batches):
        (at / f"in/{i:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        st.to_end(stream.authored(st.log(spark, str(at / "in"), stream.INPUT)), str(at / "changes"), str(at / "c1"))
        st.to_end(stream.ledger(spark.readStream.schema(stream.CHANGES).parquet(str(at / "changes"))), str(at / "states"), str(at / "c2"))
        ledgers.append({tuple(r) for r in stream.standing(spark.read.parquet(str(at / "states"))).collect()})
    return ledgers


def settled(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], stream.INPUT)
    said = df.where("what = 'say'").dropDuplicates(["id"]).drop("what")
    return {tuple(r) for r in authorship.settle(said, df.where("what = 'task'").select("session", "hash")).collect()}


def test_late_evidence_takes_back(spark, tmp_path):
    """The worker's statement retires the person's; once its prompt is known to be handed over, the person's stands again."""
    batches = [[say(1, "p", "h1", "db", "postgres"), say(2, "w", "h2", "db", "sqlite"), say(3, "w", "h2", "e", "user: did", "episode")], [task("w", "h2"), task("c", None)], [task("c", "h2")]]
    first, second, third = streamed(spark, tmp_path, batches, "late")
    assert first == {(1, "superseded", 2, "key"), (2, "standing", None, None), (3, "standing", None, None)}
    assert second == first  # a session that quotes its own prompt hands nothing over
    assert third == {(1, "standing", None, None), (2, "revoked", None, "agent_prompt"), (3, "relabelled", -3, "agent_prompt"), (-3, "standing", None, None)}
    assert third == settled(spark, sum(batches, []))


@pytest.mark.parametrize("seed", range(3))
def test_any_order_ends_in_the_same_ledger(spark, tmp_path, seed):
    rnd = random.Random(7)
    rows = [say(i, f"s{rnd.randint(0, 3)}", rnd.choice([None, "h1", "h2", "h3"]), rnd.choice("kl"), rnd.choice("abc"), rnd.choice(["decision", "decision", "invariant", "episode"]), rnd.randint(0, 9)) for i in range(1, 31)]
    rows += [task("s0", "h1"), task("s1", "h1"), task("s2", "h2"), rows[3], rows[8]]
    want = settled(spark, rows)
    random.Random(seed).shuffle(rows)
    cuts = [0, *sorted(random.Random(seed + 10).sample(range(1, len(rows)), 2)), len(rows)]
    assert streamed(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:])], f"o{seed}")[-1] == want


def test_hash_of_texts(spark):
    long = "Please  look at\nALL the files and tell me what they do"
    got = spark.createDataFrame([(long,), (long.lower().replace("\n", " "),), ("short",), (None,)], "t string").select(authorship.text_hash(F.col("t"))).collect()
    assert got[0][0] == got[1][0] is not None and got[2][0] is None and got[3][0] is None
