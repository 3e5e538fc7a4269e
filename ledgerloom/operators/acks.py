"""Acknowledgements: what an assistant's reply says a new decision has replaced, and the one decision that this retires.

A reply names the old value in one of four forms, tried in order: reversed ("B replaces
A"), two-sided ("from A to B", "replace A with B"), quoted ("supersedes the earlier
"we use A" note") and one-sided ("instead of A", "reverses the earlier choice of A").
The first two must name a value of the new decision as well; the last two must come
after one. Every form is a pattern built from the word lists below, and all of it is
column expressions: a reply is cut once where it has named the new value first.

What is found must be a value: no stop word, none of the nouns and references that
stand before values, none of the new decision's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.session import table

# Words of the grammar, in English and Spanish.
VERBS = ["replace", "replaces", "replacing", "supersede", "supersedes", "superseding", "reverse", "reverses", "reversing", "override", "overrides"]
NOW_VERBS = ["replaces", "supersedes", "overrides", "reverses"]
REFERENCES = ["earlier", "previous", "prior", "old", "former", "recorded", "existing", "standing", "current", "original", "stated"]
NOUNS = ["decision", "choice", "plan", "policy", "call", "one", "note", "idea", "record", "entry", "setting", "value"]
VERBOS = ["reemplaza", "sustituye", "revierte", "anula"]
ANTERIOR = ["anterior", "previa", "previo"]

VALUE = r"([\w./@+-]{2,40})"
ASIDE = r"\s*(?:\([^)]{0,60}\))?\s*"
OPEN, CLOSE = "[\"“«`]", "[\"”»`]"


def _any(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


_EARLIER = rf"\b{_any(VERBS)}\s+(?:the\s+)?{_any(REFERENCES)}\s+"
_ANTERIOR = rf"\b{_any(VERBOS)}\s+(?:la\s+|el\s+)?(?:decisi[oó]n\s+)?{_any(ANTERIOR)}\s+(?:de\s+)?"
#: Pattern, the group of the old value and that of the new one.
BOTH = [
    (rf"(?i)\b{VALUE}\s+{_any(NOW_VERBS)}\s+(?:the\s+)?{VALUE}", 2, 1),
    (rf"(?i)\b{VALUE}\s+{_any(VERBOS)}\s+(?:a\s+)?(?:la\s+|el\s+)?{VALUE}", 2, 1),
    (rf"(?i)\bfrom\s+{VALUE}{ASIDE}(?:over\s+|across\s+)?to\s+{VALUE}", 1, 2),
    (rf"(?i)\breplac(?:e|ed|ing)\s+{VALUE}{ASIDE}with\s+{VALUE}", 1, 2),
    (rf"(?i)\bde\s+{VALUE}{ASIDE}a\s+{VALUE}", 1, 2),
]
QUOTED = [rf"(?i){start}{OPEN}([^\"”»`]{{2,60}}){CLOSE}" for start in (_EARLIER, _ANTERIOR)]
ONE = [
    rf"(?i)\binstead\s+of\s+(?:the\s+|our\s+|that\s+)?{VALUE}",
    rf"(?i)\ben\s+(?:vez|lugar)\s+de\s+(?:la\s+|el\s+|nuestro\s+|nuestra\s+)?{VALUE}",
    rf"(?i){_EARLIER}(?:{_any(REFERENCES)}\s+)?{_any(NOUNS)}\b(?:\s*\([^)]{{0,30}}\))?(?:\s+to\s+[\w-]+)?(?:\s+{_any(['with', 'on', 'of', 'for'])})?\s+{VALUE}",
    rf"(?i)\b{_any(VERBS)}\s+the\s+{VALUE}(?:\s+[\w-]+)?\s+{_any(NOUNS)}\b",
    rf"(?i){_EARLIER}{VALUE}",
    rf"(?i){_ANTERIOR}{VALUE}",
]


def _plain(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def replaced_value(ack: Column, decision: Column) -> Column:
    """The old value that a reply says the decision replaces, in small letters, or null."""
    own = text.topic_words(decision)
    never = F.array(*map(F.lit, [*text.STOP_WORDS, *REFERENCES, *NOUNS]))
    is_value = lambda g: (F.length(g) >= 2) & ~F.array_contains(never, g) & ~F.array_contains(own, g)
    is_own = lambda x: F.exists(own, lambda w: F.contains(x, w))
    first = lambda found: F.get(found, F.lit(0))
    tries = []
    for pattern, old, new in BOTH:
        each = lambda i: F.regexp_extract_all(ack, F.lit(pattern), F.lit(i))  # noqa: B023, E731
        pairs = F.zip_with(each(old), each(new), lambda a, b: F.struct(_plain(a).alias("old"), _plain(b).alias("new")))
        tries.append(first(F.transform(F.filter(pairs, lambda p: is_own(p["new"]) & is_value(p["old"])), lambda p: p["old"])))
    low = F.lower(ack)
    ends = F.filter(F.transform(own, lambda w: F.when(F.contains(low, w), F.call_function("locate", w, low) + F.length(w))), lambda e: e.isNotNull())
    after = F.substring(ack, F.array_min(ends), F.length(ack))
    for pattern in QUOTED:
        named = F.transform(F.regexp_extract_all(after, F.lit(pattern), F.lit(1)), lambda x: first(text.name_tokens(x)))
        tries.append(first(F.filter(named, lambda g: g.isNotNull() & is_value(g))))
    for pattern in ONE:
        tries.append(first(F.filter(F.transform(F.regexp_extract_all(after, F.lit(pattern), F.lit(1)), _plain), is_value)))
    return F.coalesce(*tries)


def retired_by_reply(decisions: DataFrame) -> DataFrame:
    """(id, by, value) from decisions store, id, object, created, ack (the reply, or null): of the earlier decisions that hold the replaced value as a word, the shortest, the first among equals, once for each reply. A decision that several replies retire goes by the first of them."""
    found = decisions.where("ack is not null").select("store", F.col("id").alias("by"), F.col("created").alias("at"), replaced_value(F.col("ack"), F.col("object")).alias("value")).where("value is not null")
    whole = F.transform(F.split("object", r"[^\w./@+-]+"), _plain)
    words = F.array_distinct(F.concat(whole, F.flatten(F.transform(whole, lambda w: F.split(w, "[./@+-]+")))))
    held = decisions.select("store", "id", "created", F.length("object").alias("n"), F.explode(words).alias("value")).where("value <> ''")
    met = found.join(held, ["store", "value"]).where((F.col("created") < F.col("at")) & (F.col("id") != F.col("by")))
    one = met.groupBy("store", "by", "at", "value").agg(F.min(F.struct("n", "id"))["id"].alias("id"))
    return one.groupBy("store", "id").agg(F.min(F.struct("at", "by", "value")).alias("x")).select("id", "x.by", "x.value")


# --- a query over orders: each states a part, and some are told to replace the part before ---------------------------------------


def m5_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a store. Replies come in five forms, by the order's key; every sixth order has none."""
    part = lambda k: F.concat(F.lit("part"), k.cast("string"))
    key, of = F.col("o_orderkey"), F.col("o_orderkey") % 7
    now, was = part(of), part((of + 1) % 7)
    said = [F.concat(now, F.lit(" replaces "), was), F.concat(F.lit("Switching from "), was, F.lit(" (see above) to "), now), F.concat(F.lit("Noted: "), now, F.lit(" instead of the "), was), F.concat(now, F.lit(" reverses the earlier choice of "), was), F.concat(F.lit("I kept "), was)]
    ack = F.when(key % 6 == 0, said[0])
    for i, x in enumerate(said[1:], 1):
        ack = ack.when(key % 6 == i, x)
    pad = F.repeat(F.lit("!"), (key % 5).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"), key.alias("id"), F.concat(F.lit("we go with "), now, pad).alias("object"), key.alias("created"), ack.alias("ack"))
    return retired_by_reply(rows)


QUERIES = {"m5_acknowledged": m5_acknowledged}
ORACLES = {
    "m5_acknowledged": """WITH d AS (SELECT o_custkey AS store, o_orderkey AS id, o_orderkey % 7 AS part, (o_orderkey % 7 + 1) % 7 AS was, o_orderkey % 6 < 4 AS says, o_orderkey % 5 AS pad FROM orders),
m AS (SELECT n.store, n.id AS b, n.was, o.id, row_number() OVER (PARTITION BY n.store, n.id ORDER BY o.pad, o.id) AS k FROM d n JOIN d o ON o.store = n.store AND o.part = n.was AND o.id < n.id WHERE n.says)
SELECT id, min(b) AS by, 'part' || min_by(was, b) AS value FROM m WHERE k = 1 GROUP BY store, id"""
}
