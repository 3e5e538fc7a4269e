import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    """Each stage keeps whole rows of its input, and the last encodes all that is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.saved(spark, stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert out.exceptAll(docs).isEmpty()
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    want = {r.doc_id: tik.encode_ordinary(r.text) for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.n_tokens == len(r.ids) for r in got)


def test_one_of_each_group_stays(spark):
    from ledgerloom.llm import jaccard

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(7, " ".join(words), "a"), (3, near, "b"), (3, near, "b"), (9, "something else", "c"), (8, None, "d"), (6, "", "e"), (3, "a text of its own here", "f")]
    path = corpus_pipeline.saved(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "docs")
    kept = sorted((r.doc_id, r.source) for r in jaccard.keep_one(spark, path, "").collect())
    assert kept == [(3, "b"), (3, "f"), (6, "e"), (8, "d"), (9, "c")]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_stay(spark, tmp_path):
    """Every stage but the last returns the columns it was given, whatever their names."""
    rows = [(i, f"the water of the river number {i} and more words there", "en", "s", 3, 0.5, True, "x", i, "odd") for i in range(8)]
    names = "doc_id long, text string, lang string, source string, n_chars int, score double, rejected boolean, topic string, row int, `a b` string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
