import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import stems
from ledgerloom.operators import retrieval

# The examples of Porter's paper, each step's, taken through all steps.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize("word,stem", zip(PUBLISHED[::2], PUBLISHED[1::2]))
def test_published_examples(word, stem):
    assert stems.porter(word) == stem


def test_what_is_no_word_of_english():
    assert [stems.porter(w) for w in ("", "a", "is", "\u00e9tions", "x" * 70, "123s")] == ["", "a", "is", "\u00e9tion", "x" * 70, "123"]


def test_spanish(spark):
    words = ["abierto", "abiertas", "rapida", "rapidos", "carta", "cartera", "sol", "casa", "mente", "decisiones", None]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(stems.spanish_stem(F.col("w"))).collect()]
    assert got == ["abiert", "abiert", "rapid", "rapid", "cart", "carter", None, "casa", "ment", "decision", None]


def test_stemmed_search_and_expansion(spark):
    docs = spark.createDataFrame([(i, "s", "", t) for i, t in enumerate(["testing parsers daily", "the parser tests", "nothing here", "parse", "cuenta abierta"])], "id long, subject string, object string, body string")
    asked = spark.createDataFrame([(1, "parsers tested?")], "prompt_id long, prompt string")
    assert {r.id for r in retrieval.search(spark, docs, asked)[0].collect()} == {0}
    assert {r.id for r in retrieval.search(spark, docs, asked, stem=True)[0].collect()} == {0, 1}
    terms = spark.createDataFrame([(1, "abiertos"), (1, "tests"), (1, "sol"), (1, "cuentas")], "prompt_id long, term string")
    vocabulary = retrieval.token_rows(docs).select("term").distinct()
    assert {tuple(r) for r in retrieval.expanded(terms, vocabulary).collect()} == {(1, "abiertos", "abierta"), (1, "cuentas", "cuenta")}
