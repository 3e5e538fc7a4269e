import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import acks

CASES = [
    ("tokio replaces async-std as the async runtime", "use tokio", "async-std"),
    ("Apache-2.0 supersedes GPL-3.0.", "license is Apache-2.0", "gpl-3.0"),
    ("Switching from gzip (the earlier decision, #3) to zstd", "zstd is faster", "gzip"),
    ("moving from calver over to semver", "semver is cleaner", "calver"),
    ("I'll replace moment with luxon everywhere", "luxon for dates", "moment"),
    ("Cambio de mysql a postgres", "usar postgres", "mysql"),
    ('argon2id it is, which supersedes the earlier "We\'re using bcrypt" note', "hash with argon2id", "bcrypt"),
    ("Using argon2id instead of the bcrypt decision", "argon2id for hashes", "bcrypt"),
    ("rustls, which replaces the earlier decision to stick with openssl", "go with rustls", "openssl"),
    ("vitest replaces the earlier jest decision", "vitest from now on", "jest"),
    ("cbor overrides the protobuf wire format choice", "cbor everywhere", "protobuf"),
    ("postgres en lugar de la mysql", "usar postgres", "mysql"),
    ("redis: sustituye la decisión anterior de memcached", "cache en redis", "memcached"),
    # nothing is replaced, or nothing of this decision, or what is named is no value
    ("Saved, thanks.", "use tokio", None),
    ("We moved from gzip to zstd last year", "use tokio", None),
    ("tokio replaces it", "use tokio", None),
    ("instead of jest we could use vitest", "use vitest", None),
    ("tokio, which replaces the earlier note", "use tokio", None),
    ("from tokio to tokio", "use tokio", None),
    ("code made by hand", "by hand", None),
    (None, "use tokio", None),
    ("tokio replaces async-std", "", None),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, a, d) for i, (a, d, _) in enumerate(CASES)], "i int, ack string, decision string")
    return {r.i: r.v for r in df.select("i", acks.replaced_value(F.col("ack"), F.col("decision")).alias("v")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_forms(found, i):
    assert found[i] == CASES[i][2], CASES[i]


def test_the_shortest_holder_goes_once(spark):
    rows = [
        (1, 1, "we store sessions in redis for now", 1, None), (1, 2, "redis it is", 2, None), (1, 3, "use redis ok", 3, None), (2, 4, "redis", 0, None),
        (1, 5, "use valkey", 5, "valkey replaces redis"), (1, 6, "valkey again", 6, "valkey instead of redis"), (1, 7, "redis!", 9, None), (1, 8, "keep valkey", 10, None),
    ]
    df = spark.createDataFrame(rows, "store int, id long, object string, created long, ack string")
    assert [tuple(r) for r in acks.retired_by_reply(df).collect()] == [(2, 5, "redis")]
    assert acks.retired_by_reply(df.limit(0)).collect() == []
