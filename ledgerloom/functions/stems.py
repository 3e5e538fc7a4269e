"""Stems: Porter's for English, over distinct words in Arrow batches, and a list of Spanish endings as a column expression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of M. F. Porter, "An algorithm for suffix stripping" (1980), with the author's later -bli and -logi.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# Spanish endings; the first that leaves LEAST letters is taken off.
SPANISH = """aciones amientos imientos amiento imiento adores adoras acion ancias encias mente ables ibles ando iendo adas ados idas idos aron ieron aban aria eria iria ador ante able ible
amos emos imos ada ado ida ido ar er ir es an en as os a o e s""".split()
LEAST, FORMS = 4, 6


def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter(w: str) -> str:
    if len(w) < 3 or len(w) > 64:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (end := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if (end := _longest(w, rules)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    if end := _longest(w, STEP_4):
        stem = w[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
        w = stem if _measure(stem) > 1 else w
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stemmed(words: DataFrame) -> DataFrame:
    """(term, stem) of the distinct words of the column term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array([porter(w) for w in b.column("term").to_pylist()], pa.string())], ["term", "stem"])

    return words.select("term").where("term is not null").distinct().mapInArrow(run, "term string, stem string")


def spanish_stem(term: Column) -> Column:
    """The word without the first ending of SPANISH that leaves LEAST letters, or the whole word; null for a shorter word."""
    n = F.length(term)
    cut = [F.when(term.endswith(s) & (n - len(s) >= LEAST), F.substring(term, F.lit(1), n - len(s))) for s in SPANISH]
    return F.when(n >= LEAST, F.coalesce(*cut, term))


def spanish_stem_sql(term: str) -> str:
    cases = " ".join(f"WHEN ends_with({term}, '{s}') AND length({term}) >= {LEAST + len(s)} THEN left({term}, length({term}) - {len(s)})" for s in SPANISH)
    return f"CASE WHEN length({term}) < {LEAST} THEN NULL {cases} ELSE {term} END"
