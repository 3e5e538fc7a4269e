import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ledgerloom.llm import bpe, common
from ledgerloom.llm import jaccard as jc
from ledgerloom.llm import toxicity as tx


def anonymous_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_a_task_keeps_no_freed_memory():
    """What a task's function frees goes back at its end, though something that lives on lies behind it."""
    before, kept = anonymous_mb(), []
    for b in common.by_bytes(iter([pa.record_batch({"text": ["a"]})])):
        many = [bytearray(b"x" * 100_000) for _ in range(2000)]
        kept.append(many[-1])
        assert anonymous_mb() - before > 150
        del many
    assert anonymous_mb() - before < 60


def test_sets_are_made_a_few_at_a_time(spark, monkeypatch):
    """However large a batch is, sets are made of little text at once, and rows, classes and keys are the same."""
    text = " ".join(f"w{i}" for i in range(3000))
    b = pa.record_batch({"text": [f"{i} {text}" for i in range(60)]})
    sizes = [np.sum([len(t) for t in s.column("text").to_pylist()]) for s in common.by_bytes(iter([b]), most=jc.SETS_BYTES)]
    assert max(sizes) <= jc.SETS_BYTES < common.TEXT_BYTES and sum(sizes) == sum(len(t) for t in b.column("text").to_pylist())
    seen = []
    real = jc.by_bytes
    monkeypatch.setattr(jc, "by_bytes", lambda batches, column="text", most=common.TEXT_BYTES: seen.append(most) or real(batches, column, most))
    docs = spark.createDataFrame([(0, 1, "a b c d e"), (1, 2, "a b c d e")], "row long, doc_id long, text string")
    run = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: run.setdefault("f", f))
    jc.sets(docs)
    out = list(run["f"](iter([pa.record_batch({"row": [0, 1], "doc_id": [1, 2], "text": ["a b c d e"] * 2})])))
    assert seen == [jc.SETS_BYTES] and out[0].column("n").to_pylist() == [2, 2]


@pytest.mark.parametrize("ends", ["at its end", "early"])
def test_caches_end_with_their_task(spark, monkeypatch, ends):
    """Workers are reused by later stages: what a task's caches hold goes with the task, also where that is not read to its end."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(0, 1, "a b c d e f")], "row long, doc_id long, text string")
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: run.append(f) or docs)
    tx.score(spark, docs, {-1: 0.0, 7: 1.0}, ["doc_id"])
    jc.sets(docs)
    jc.bucket_rows(docs, 4, 85, np.zeros(0, np.int64))
    bpe._short(docs, path, pattern, bpe.DIGESTS)
    batches = [pa.record_batch({"row": [i], "doc_id": [i], "text": ["qxz%d of another kind and more" % i]}) for i in range(2)]
    held = []
    for f in run:
        rows = f(iter(batches))
        next(rows)
        held.append(len(tx._hashes) + len(jc._hashes) + len(bpe.Coder.get(path, pattern).ids))
        list(rows) if ends == "at its end" else rows.close()
        coder = bpe.Coder.get(path, pattern)
        assert not tx._hashes and not jc._hashes and not coder.ids and not coder.raw and coder.older == ({}, {})
    assert all(held) and len(run) == 4


def test_a_task_gives_back_what_its_function_held(monkeypatch):
    """Memory is given back after the function's own variables are gone, not before."""
    seen, alive = [], []

    class Table:
        def __init__(self):
            alive.append(1)

        def __del__(self):
            alive.pop()

    def run(batches):
        held = Table()
        for b in batches:
            yield b, held is not None

    monkeypatch.setattr(common, "give_back", lambda: seen.append(len(alive)))
    assert len(list(common.forgetful(run)(iter([1, 2])))) == 2 and seen == [0]
