"""Redaction of secrets and home directories, as column expressions.

Four kinds, one after the other, so that none sees what an earlier one has masked:
keys as their issuers publish them, private keys, assigned secrets and signed tokens;
opaque tokens, told by their entropy; home directories of Windows, also as other
systems mount them; home directories of Unix. All of it runs in the JVM; texts without
a long token skip the entropy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK, HOME = "[redacted]", "~"

# How issued keys begin, the characters that may follow, and how many of them at least (and at most).
ISSUED = [
    ("sk-ant-", "A-Za-z0-9_-", "20,"),
    ("sk-", "A-Za-z0-9", "20,"),
    ("ghp_", "A-Za-z0-9", "30,"),
    ("github_pat_", "A-Za-z0-9_", "30,"),
    ("AKIA", "A-Z0-9", "16"),
    ("xoxa-", "A-Za-z0-9-", "10,"),
    ("xoxb-", "A-Za-z0-9-", "10,"),
    ("xoxp-", "A-Za-z0-9-", "10,"),
    ("xoxr-", "A-Za-z0-9-", "10,"),
    ("xoxs-", "A-Za-z0-9-", "10,"),
    ("AIza", "A-Za-z0-9_-", "30,"),
]
# Names whose assigned value is a secret, if it has ASSIGNED characters or more.
SECRET_NAMES = ["api_key", "api-key", "apikey", "token", "secret", "password", "passwd", "authorization"]
ASSIGNED, OPAQUE_LENGTH, OPAQUE_BITS = 12, 32, 4.0

TOKEN = "A-Za-z0-9+/=_-"
BASE64URL = "[A-Za-z0-9_-]{10,}"
ISSUED_KEY = "|".join(f"{begin}[{chars}]{{{n}}}" for begin, chars, n in ISSUED)
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"  # RFC 7468
ASSIGNMENT = rf"(?i)\b(?:{'|'.join(SECRET_NAMES)})\b\s*[:=]\s*[\"']?[.{TOKEN}]{{{ASSIGNED},}}"
SIGNED_TOKEN = rf"eyJ{BASE64URL}(?:\.{BASE64URL}){{2}}"  # RFC 7519: a header, which begins with a brace, claims and a signature
NAME = "[A-Za-z0-9._-]+"
WINDOWS_HOME = rf"(?i)(?<![a-z0-9._/\\-])(?:[a-z]:|(?:/mnt)?/[a-z])[/\\]+users[/\\]+{NAME}"
UNIX_HOME = rf"/(?:home|Users)/{NAME}"


def entropy(token: Column) -> Column:
    """Bits for each character, from the counts of its characters."""
    n = F.length(token).cast("double")
    chars = F.array_distinct(F.split(token, ""))
    count = lambda c: n - F.length(F.replace(token, c, F.lit("")))
    return F.round(F.log2(n) - F.aggregate(chars, F.lit(0.0), lambda s, c: s + count(c) * F.log2(count(c))) / n, 9)


def is_opaque(token: Column) -> Column:
    """Letters and digits, no double dash, and more entropy than words have."""
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & ~F.contains(token, F.lit("--")) & (entropy(token) > OPAQUE_BITS)


def without_opaque(text: Column) -> Column:
    run = f"[{TOKEN}]{{{OPAQUE_LENGTH},}}"
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1))), is_opaque)
    whole = lambda x: F.concat(F.lit(rf"(?<![{TOKEN}])\Q"), x, F.lit(rf"\E(?![{TOKEN}])"))
    return F.when(text.rlike(run), F.aggregate(found, text, lambda t, x: F.regexp_replace(t, whole(x), F.lit(MASK)))).otherwise(text)


def redact(text: Column) -> Column:
    """The text with every secret masked and every home directory as ~; null stays null."""
    for secret in (ISSUED_KEY, PRIVATE_KEY, ASSIGNMENT, SIGNED_TOKEN):
        text = F.regexp_replace(text, secret, MASK)
    return F.regexp_replace(F.regexp_replace(without_opaque(text), WINDOWS_HOME, HOME), UNIX_HOME, HOME)


def redact_sql(text: str) -> str:
    """The same for DuckDB, whose patterns look neither ahead nor behind: a group holds what stands before."""
    for secret in (ISSUED_KEY, PRIVATE_KEY, ASSIGNMENT.replace("'", "''"), SIGNED_TOKEN):
        text = f"regexp_replace({text}, '{secret}', '{MASK}', 'g')"
    bits = "log2(length(x)) - list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: (length(x) - length(replace(x, c, ''))) * log2(length(x) - length(replace(x, c, ''))))) / length(x)"
    opaque = f"regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND NOT contains(x, '--') AND round({bits}, 9) > {OPAQUE_BITS}"
    runs = f"list_filter(list_distinct(regexp_extract_all(t, '[{TOKEN}]{{{OPAQUE_LENGTH},}}')), lambda x: {opaque})"
    text = f"(SELECT list_reduce(list_prepend(t, {runs}), lambda a, x: regexp_replace(a, '(^|[^{TOKEN}])' || regexp_escape(x) || '($|[^{TOKEN}])', '\\1{MASK}\\2', 'g')) FROM (SELECT {text} AS t))"
    windows = WINDOWS_HOME.replace(r"(?<![a-z0-9._/\\-])", r"(^|[^a-z0-9._/\\-])")
    return f"regexp_replace(regexp_replace({text}, '{windows}', '\\1{HOME}', 'g'), '{UNIX_HOME}', '{HOME}', 'g')"
