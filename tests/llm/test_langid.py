import zlib

import pytest

from ledgerloom.llm import langid

WORDS = {
    "en": "the and of that with from there which would their about other these water people",
    "de": "der und die nicht von auch eine werden schon durch zwischen wasser leute über größe",
    "fr": "les des une dans pour avec cette être leurs après beaucoup eau gens où déjà",
}


def docs(n=240):
    import random

    r = random.Random(3)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choices(WORDS[lang].split(), k=r.randrange(8, 60))), lang, "s"))
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("langid")
    rows = docs() + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 34 !?", "de", None), (903, "the water and people", None, "s"), (904, "the of " * 30_000, "en", "s"), (0, docs()[0][1], docs()[0][2], "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return str(d), rows


def test_held_out_accuracy_and_edges(spark, sf):
    d, rows = sf
    got = langid.op4_language_id(spark, d).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in docs()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[903].lang_pred == "en" and by[904].lang_pred == "en"


def test_stage_keeps_clean_documents_and_columns(spark, sf):
    d, rows = sf
    kept = langid.keep_identified(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 2 and set(range(240)) <= set(ids) and not {900, 901, 902} & set(ids)


def test_no_labels_empty_table_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello there", 0.5)], "doc_id long, text string, other double")
    assert langid.predict(spark, df, [], ["doc_id", "other"]).first().lang_pred == "und"
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.dictionaries(none) == []
    assert langid.predict(spark, none, [("en", b"the")], ["doc_id"]).count() == 0


def test_narrow_margins_are_rejected():
    judge = langid.Judge([("a", b"one two three"), ("b", b"one two three")])
    assert judge.judge("quite another text that neither knows " * 4, 0.002)[3]
    assert not judge.judge("short", 0.002)[3]
