"""Text functions as column expressions: folding, terms, tokens, keys and sizes.

Patterns name their classes (letters, digits, underscore) explicitly, so that
they mean the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with diacritics, and their base letters, place by place.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

#: Words that carry no topic.
STOP_WORDS = """a about after all also an and any are as at be because been before but by can could did do does for from get had
has have he her here his how if in into is it its just like make may me more my no not now of on one only or other our out over
please she should so some than that the their them then there these they this those to too up use used using very was we were
what when where which while who why will with would yes you your""".split()


def fold(text: Column) -> Column:
    """Lower case, with Latin diacritics removed."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fts_term(word: Column) -> Column:
    """A word as a query term: folded, letters, digits and underscores only; null if under two bytes or all underscores."""
    kept = F.regexp_replace(fold(word), r"[^\p{L}\p{N}_]", "")
    return F.when((F.octet_length(kept) >= 2) & (F.regexp_replace(kept, "_", "") != ""), kept)


def index_tokens(text: Column) -> Column:
    """The tokens under which a text is indexed: folded runs of letters and digits, in order."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def norm_key(text: Column, most: int) -> Column:
    """Lower case; runs of all but letters and digits become one space; trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), 1, most)


def topic_words(text: Column, most: int = 400) -> Column:
    """The sorted distinct words of three letters or more that are neither stop words nor numbers."""
    parts = F.split(norm_key(F.coalesce(text, F.lit("")), most), " ")
    keep = F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(STOP_WORDS))
    return F.array_sort(F.array_distinct(keep))


def quantity_slots(text: Column) -> Column:
    """array<struct<unit, number>> of a number next to a unit word, in either order."""
    w = F.split(norm_key(F.coalesce(text, F.lit("")), 2000), " ")
    is_number = lambda x: x.rlike("^[0-9]+$")
    is_unit = lambda x: (F.length(x) >= 3) & ~x.rlike("[0-9]") & ~x.isin(STOP_WORDS)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.filter(pairs, lambda p: (is_number(p["a"]) & is_unit(p["b"])) | (is_unit(p["a"]) & is_number(p["b"])))
    slot = lambda p: F.struct(F.when(is_number(p["a"]), p["b"]).otherwise(p["a"]).alias("unit"), F.when(is_number(p["a"]), p["a"]).otherwise(p["b"]).alias("number"))
    return F.array_sort(F.array_distinct(F.transform(found, slot)))


def tokens_estimate(text: Column) -> Column:
    """A third of the characters, rounded up."""
    return F.ceil(F.length(text) / 3).cast("bigint")


def bytes_estimate(text: Column) -> Column:
    """A third of the bytes, rounded down: the catalogue's measure."""
    return F.floor(F.octet_length(text) / 3).cast("bigint")


def clean(text: Column) -> Column:
    """Without control characters, but for tab and newline."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def date_ms(value: Column, now_ms: Column) -> Column:
    """An epoch in milliseconds from one in ms, µs or ns; null outside 2000 to tomorrow."""
    limit = now_ms + 86_400_000
    scaled = value
    for _ in range(3):
        scaled = F.when(scaled > limit, F.call_function("div", scaled, F.lit(1000))).otherwise(scaled)
    scaled = scaled.cast("bigint")
    return F.when((scaled >= 946_684_800_000) & (scaled <= limit), scaled)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (F.size(chars) - F.size(F.array_remove(chars, c))) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


#: Words after which a plain word names what is used.
NAMING = ["use", "using", "with", "to", "adopt", "try", "usar", "usa", "con", "a"]


def name_tokens(text: Column) -> Column:
    """The sorted distinct words, in small letters, that are spelt like names: with a capital, a digit among letters, a dot, dash or underscore within, or after a word of NAMING."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\s,;()\"`!?]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    tokens = F.filter(trimmed, lambda w: w != "")
    before = F.concat(F.array(F.lit("")), F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.lower))
    plain = lambda w: ~F.lower(w).isin(STOP_WORDS)
    spelt = lambda w: w.rlike(r"^.+\p{Lu}") | (w.rlike("[0-9]") & w.rlike(r"\p{L}")) | w.rlike("[._-]") | (w.rlike(r"^\p{Lu}") & plain(w))
    named = lambda w, p: (F.length(w) >= 2) & (spelt(w) | (p.isin(NAMING) & w.rlike("^[A-Za-z0-9_]+$") & plain(w)))
    return F.array_sort(F.array_distinct(F.filter(F.zip_with(tokens, F.slice(before, 1, F.greatest(F.size(tokens), F.lit(0))), lambda w, p: F.when(named(w, p), F.lower(w))), lambda w: w.isNotNull())))
