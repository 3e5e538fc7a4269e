import hashlib
import random

import public_tokenizers
import tiktoken

from ledgerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(5)
    alphabet = "ab e'st  \n\t 　.,;!'1234é漢字ñ\U0001f600́"
    out = ["", " ", "\n\n  x", "don't 'sx ''re", "a" * 3000, "z" * 90 + " " * 500 + "q", "   x" * 80, "<|endoftext|>"]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 900))) for _ in range(60)]


def test_encode_matches_and_decodes():
    coder = bpe.Coder.get(PATH, public_tokenizers.PATTERN)
    for t in texts():
        ids = coder.encode(t)
        assert ids == TIK.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_windows_are_stitched(spark):
    rows = [(i % 50, t) for i, t in enumerate(texts())] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, TIK.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    for chunk, overlap in ((40, 7), (64, 64), (100, 30)):
        got = bpe.encode(spark, docs, PATH, chunk_chars=chunk, overlap_chars=overlap).collect()
        assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == want
        assert all(r.n_tokens == len(r.ids) for r in got)


def test_query(spark, tmp_path):
    rows = [(1, "Hello world", 7), (2, None, 7), (2, None, 7), (3, "lang " * 20_000, 7), (4, "x" * 70_000, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_byte_bpe(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(i, len(ids := TIK.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _ in rows}


def test_decode_column_and_empty_table(spark):
    df = spark.createDataFrame([([],), (None,), (TIK.encode_ordinary("añb"),)], "ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe.decode(df, "ids", PATH).collect()] == [b"", None, "añb".encode()]
    assert bpe.encode(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
