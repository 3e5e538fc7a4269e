"""The SQL fragments that say in DuckDB what functions.text says in columns; used by the oracles only."""

from ledgerloom.functions.text import ACCENTED, PLAIN, STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def index_tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({fold(f'coalesce({x}, {chr(39) * 2})')}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def fts_term(x: str) -> str:
    kept = rf"regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}_]', '', 'g')"
    return f"CASE WHEN octet_length(encode({kept})) >= 2 AND replace({kept}, '_', '') <> '' THEN {kept} END"


def norm_key(x: str, most: int) -> str:
    return rf"substr(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), 1, {most})"


def topic_words(x: str, most: int = 400) -> str:
    parts = f"string_split({norm_key(f'coalesce({x}, {chr(39) * 2})', most)}, ' ')"
    return f"list_sort(list_distinct(list_filter({parts}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({STOP}, w))))"
