"""Chat formatting: a compiler of sandboxed templates, and the conversations that it renders.

A template is text with ``{{ expression }}``, ``{% if %}``/``{% elif %}``/``{% else %}``/
``{% endif %}``, ``{% for x in xs %}``/``{% endfor %}``, ``{% set x = expression %}``,
``{% generation %}``/``{% endgeneration %}`` (what a model is to learn) and ``{# notes #}``;
a dash inside a tag, as in ``{%-``, strips white space on its side. Expressions have
literals, names, ``a.b`` and ``a[b]``, ``+ - * // % ~``, comparisons, ``in``, ``not``,
``and``, ``or``, ``x if c else y`` and filters. It is parsed into a syntax tree, whose
constant parts are folded (a test that is constant leaves one branch, texts in a row
become one), and turned into Python closures once for each worker.

Nothing of Python can be reached: names are those of the context and of ``set``,
``a.b`` looks into mappings only, filters are the functions of ``FILTERS``, there are no
calls, and a loop runs over a list that it is given. What an operator or ``replace`` makes
is bounded by ``MOST_CHARS``.

``format_conversations`` returns pieces of formatted text with the spans of the learnt
parts, about ``PIECE_CHARS`` each, in order; ``read_back`` reads such pieces. Rows of a
conversation are sorted in one partition and stream through the closures, one turn at a
time: a conversation of any length is held nowhere, unless its template asks for
``messages`` outside of one loop over them. The digests go in order by nature.

Defined cases: rows go by turn, nulls first, then by role and text; null roles and
texts are empty; repeated rows are turns of their own; a text may hold any control
string, also the marks of this format; very long texts are a piece of their own; an
empty table has no conversation but -1; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, table

MOST_CHARS, PIECE_CHARS = 1 << 28, 1 << 20
TEMPLATE = """{# turns between marks; only what the assistant says is learnt -#}
{% for m in messages -%}
<|im_start|>{{ m.role|escape_line }}
{% if m.role == 'assistant' %}{% generation %}{{ m.content|escape }}{% endgeneration %}{% else %}{{ m.content|escape }}{% endif %}<|im_end|>
{% endfor %}"""


class TemplateError(ValueError):
    """A template that isn't valid, or asks for what it may not have."""


# ---------------------------------------------------------------- control strings


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes into each, and one more where some stand there already."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """As escape, and in one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


# ---------------------------------------------------------------- syntax

TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|<=|>=|//|[-+*%~<>=.,|()\[\]]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


def pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a template: text, {{ or {%."""
    at, strip = 0, False
    while True:
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        kind = m[0][:2]
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[kind]
        end = _end(source, m.end(), close)
        inner = source[m.end() : end]
        strip = inner.endswith("-")
        if kind != "{#":
            yield kind, inner[:-1] if strip else inner
        at = end + 2


def _end(source: str, at: int, close: str) -> int:
    """Where the tag ends; a mark within quotes doesn't end it."""
    quote = None
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = None if c == quote else quote
        elif source.startswith(close, at):
            return at
        elif c in "'\"" and close != "#}":
            quote = c
        at += 1
    raise TemplateError(f"{close} is missing")


class Expression:
    """A parser of one expression, by precedence; nodes are tuples whose first part is their kind."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        """The next token, if it is a word or an operator."""
        kind, text = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)
        return text if kind in ("op", "name") else None

    def take(self, *expected: str) -> str:
        if self.at >= len(self.tokens) or expected and self.peek() not in expected:
            raise TemplateError(f"expected {' or '.join(expected) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")
        return node

    def choice(self) -> tuple:
        node = self.level(0)
        if self.peek() == "if":
            self.take()
            test = self.level(0)
            other = ("const", "")
            if self.peek() == "else":
                self.take()
                other = self.choice()
            return ("choice", test, node, other)
        return node

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[n] == ("not",):
            if self.peek() == "not":
                self.take()
                return ("not", self.level(n))
            return self.level(n + 1)
        node = self.level(n + 1)
        while True:
            op = "not in" if self.peek() == "not" and self.peek(1) == "in" else self.peek()
            if op not in self.LEVELS[n]:
                return node
            for _ in op.split():
                self.take()
            node = ("op", op, node, self.level(n + 1))

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek() in (".", "[", "|"):
            mark = self.take()
            if mark == "[":
                node = ("item", node, self.choice())
                self.take("]")
            elif mark == ".":
                node = ("item", node, ("const", self.name()))
            else:
                name, given = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name}")
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        given.append(self.choice())
                        if self.peek() != ")":
                            self.take(",")
                    self.take(")")
                node = ("filter", name, node, *given)
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.peek() in WORDS:
            raise TemplateError("expected a name")
        return self.take()

    def atom(self) -> tuple:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "number":
            return ("const", int(self.take()))
        if kind == "text":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if text == "(":
            self.take()
            node = self.choice()
            self.take(")")
            return node
        if text == "-":
            self.take()
            return ("op", "-", ("const", 0), self.atom())
        if text in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[self.take()])
        return ("name", self.name())


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", node, ...) of text, show, if, for, set and generation."""
    todo = list(pieces(source))[::-1]

    def block(*ends: str) -> tuple[tuple, str]:
        nodes = []
        while todo:
            kind, inner = todo.pop()
            if kind == "text":
                nodes.append(("text", inner))
            elif kind == "{{":
                nodes.append(("show", Expression(inner).whole()))
            else:
                word, _, rest = inner.strip().partition(" ")
                if word in ends:
                    return ("block", *nodes), inner.strip()
                nodes.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", *nodes), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "if":
            body, end = block("elif", "else", "endif")
            if end == "endif":
                other = ("block",)
            elif end == "else":
                other, _ = block("endif")
            else:
                other = ("block", statement("if", end.partition(" ")[2]))
            return ("if", Expression(rest).whole(), body, other)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m or m[1] in WORDS or m[1] == "loop":
                raise TemplateError(f"for {rest}")
            body, _ = block("endfor")
            return ("for", m[1], Expression(m[2]).whole(), body)
        if word == "set":
            m = re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)\s*=(?!=)\s*(.+)", rest, re.DOTALL)
            if not m or m[1] in WORDS:
                raise TemplateError(f"set {rest}")
            return ("set", m[1], Expression(m[2]).whole())
        if word == "generation" and not rest:
            body, _ = block("endgeneration")
            return ("generation", body)
        raise TemplateError(f"there is no statement {word}")

    return block()[0]


# ---------------------------------------------------------------- meaning


def text_of(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x) if isinstance(x, (bool, int)) else _refuse(f"{type(x).__name__} isn't text")


def _refuse(why: str) -> Any:
    raise TemplateError(why)


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _joined(a: str, b: str) -> str:
    return a + b if len(a) + len(b) <= MOST_CHARS else _refuse("the result is too long")


def _replaced(text: str, a: str, b: str) -> str:
    return text.replace(a, b) if a and len(text) + text.count(a) * len(b) <= MOST_CHARS else _refuse("nothing to replace, or too much")


def _times(a: Any, b: Any) -> Any:
    size = len(a) * b if isinstance(a, str) and isinstance(b, int) else len(b) * a if isinstance(b, str) and isinstance(a, int) else a.bit_length() + b.bit_length()
    return a * b if size <= MOST_CHARS else _refuse("the result is too long")


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(text_of(x)),
    "escape_line": lambda x: escape_line(text_of(x)),
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, a, b: _replaced(text_of(x), text_of(a), text_of(b)),
}
OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: _joined(a, b) if isinstance(a, str) else a + b, "-": lambda a, b: a - b, "*": _times, "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if isinstance(a, int) else _refuse("% is for numbers"), "~": lambda a, b: _joined(text_of(a), text_of(b)),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}


def fold(node: tuple) -> tuple:
    """The tree with its constant parts worked out; what would fail stays, and fails where it is rendered."""
    kind, *parts = node
    parts = [fold(p) if isinstance(p, tuple) else p for p in parts]
    if kind == "block":
        out: list[tuple] = []
        for p in parts:
            for q in p[1:] if p[0] == "block" else [p]:
                if q[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + q[1])
                elif q != ("text", ""):
                    out.append(q)
        return ("block", *out)
    if kind == "if" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind == "choice" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind == "show" and parts[0][0] == "const":
        return ("text", text_of(parts[0][1]))
    if kind == "op" and parts[0] in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (parts[0] == "and") else parts[1]
    if kind in ("op", "not", "filter", "item") and all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        try:
            return ("const", expression((kind, *parts))({}))
        except (TypeError, ZeroDivisionError, TemplateError):
            pass
    return (kind, *parts)


def expression(node: tuple) -> Callable[[dict], Any]:
    kind, *parts = node
    if kind == "const":
        return lambda names, x=parts[0]: x
    if kind == "name":
        return lambda names, n=parts[0]: names.get(n)
    if kind == "not":
        inner = expression(parts[0])
        return lambda names: not inner(names)
    if kind == "choice":
        test, yes, no = map(expression, parts)
        return lambda names: yes(names) if test(names) else no(names)
    if kind == "item":
        of, key = map(expression, parts)
        return lambda names: _item(of(names), key(names))
    if kind == "filter":
        f, given = FILTERS[parts[0]], [expression(p) for p in parts[1:]]
        return lambda names: f(*(g(names) for g in given))
    a, b = expression(parts[1]), expression(parts[2])
    if parts[0] == "and":
        return lambda names: a(names) and b(names)
    if parts[0] == "or":
        return lambda names: a(names) or b(names)
    return lambda names, f=OPERATORS[parts[0]]: f(a(names), b(names))


Rendered = Iterator[tuple[str, bool]]


def closure(node: tuple, learnt: bool = False) -> Callable[[dict], Rendered]:
    """A function of the names that yields (text, whether it is learnt)."""
    kind, *parts = node
    if kind == "text":
        out = (parts[0], learnt)
        return lambda names: iter((out,))
    if kind == "show":
        value = expression(parts[0])
        return lambda names: iter(((text_of(value(names)), learnt),))
    if kind == "generation":
        return closure(parts[0], True)
    if kind == "set":
        value = expression(parts[1])

        def assign(names: dict) -> Rendered:
            names[parts[0]] = value(names)
            return iter(())

        return assign
    if kind == "if":
        test, yes, no = expression(parts[0]), closure(parts[1], learnt), closure(parts[2], learnt)
        return lambda names: yes(names) if test(names) else no(names)
    if kind == "for":
        items, body = expression(parts[1]), closure(parts[2], learnt)

        def loop(names: dict) -> Rendered:
            found = items(names)
            if isinstance(found, (str, dict)):
                raise TemplateError("a loop runs over a list")
            found, n, none = iter(found or ()), 0, object()
            ahead = next(found, none)
            while ahead is not none:
                now, ahead, n = ahead, next(found, none), n + 1
                yield from body(names | {parts[0]: now, "loop": {"index": n, "index0": n - 1, "first": n == 1, "last": ahead is none}})

        return loop
    each = [closure(p, learnt) for p in parts]
    if len(each) == 1:
        return each[0]

    def block(names: dict) -> Rendered:
        for f in each:
            yield from f(names)

    return block


def mentions(node: Any, name: str) -> int:
    return (node == ("name", name)) + sum(mentions(p, name) for p in node if isinstance(p, tuple)) if isinstance(node, tuple) else 0


class Template:
    """A compiled template; ``streams`` tells that it reads ``messages`` in one loop at the top, so that they may come one by one."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        loops = [p for p in self.tree[1:] if p[0] == "for" and p[2] == ("name", "messages")] if self.tree[0] == "block" else []
        self.streams = len(loops) == 1 and mentions(self.tree, "messages") == 1
        self.run = closure(self.tree)

    def render(self, messages: Iterator[dict] | list[dict], **names: Any) -> Rendered:
        return self.run({**names, "messages": iter(messages) if self.streams else list(messages)})

    def text(self, messages: list[dict], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and where what is learnt begins and ends."""
        out, spans, at = [], [], 0
        for part, learnt in self.render(messages, **names):
            if learnt and part:
                spans.append((at, at + len(part)))
            out.append(part)
            at += len(part)
        return "".join(out), spans


# ---------------------------------------------------------------- on Spark

FORMATTED = "conv_id bigint, piece bigint, formatted string, spans array<struct<begin: bigint, end: bigint>>"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def grouped(stream: Iterator[tuple]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """(key, its rows) of rows that come sorted by their first part, read as they are asked for."""
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]

        def rows():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:  # noqa: B023
                row, ahead = ahead, next(stream, None)
                yield row[1:]

        mine = rows()
        yield key, mine
        for _ in mine:
            pass


def formatter(source: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, out, size = Template(source), [], 0
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        for conv, turns in grouped(rows):
            texts, spans, at, n = [], [], 0, 0
            for part, learnt in template.render({"role": role, "content": text} for role, text in turns):
                if learnt and part:
                    spans.append((at, at + len(part)))
                texts.append(part)
                at, size = at + len(part), size + len(part)
                if at >= PIECE_CHARS:
                    out.append((conv, n, "".join(texts), spans))
                    texts, spans, at, n = [], [], 0, n + 1
                if size >= PIECE_CHARS and out:
                    yield _formatted(out)
                    out, size = [], at
            if texts or not n:
                out.append((conv, n, "".join(texts), spans))
        if out:
            yield _formatted(out)

    return run


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    conv, n, text, spans = zip(*rows, strict=True)
    named = [[{"begin": a, "end": b} for a, b in s] for s in spans]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(named, SPANS)], ["conv_id", "piece", "formatted", "spans"])


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def turns_of(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of formatted text that comes in parts; what isn't a turn is an error."""
    held: list[str] = []
    for text in texts:
        held.append(text)
        if "<|im_end|>\n" not in (held[-2][-11:] if len(held) > 1 else "") + text:
            continue
        whole, at = "".join(held), 0
        while m := TURN.match(whole, at):
            yield unescape_line(m[1]), unescape(m[2])
            at = m.end()
        held = [whole[at:]] if at < len(whole) else []
    if held:
        raise ValueError(f"not a turn: {held[0][:40]!r}")


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its pieces in order."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True))
    out = []
    for conv, parts in grouped(rows):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = learnt = 0

        def texts():
            nonlocal chars, learnt
            for text, spans in parts:  # noqa: B023
                chars += len(text)
                for s in spans:
                    part = unescape(text[s["begin"] : s["end"]])
                    learnt += len(part)
                    loss.update(part.encode())  # noqa: B023
                yield text

        for role, text in turns_of(texts()):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        out.append((conv, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
        if len(out) == 1000:
            yield _read(out)
            out = []
    if out:
        yield _read(out)


def _read(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, {"bigint": pa.int64(), "string": pa.string()}[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def format_conversations(spark: SparkSession, rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, piece, formatted, spans of conversations (conv_id, turn, role, text): the pieces of a conversation stand in order in one partition."""
    Template(template)  # errors of the template are told here
    bounded_batches(spark)
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(formatter(template), FORMATTED)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what format_conversations has formatted by the default template; saved pieces must be sorted again."""
    return pieces.mapInArrow(read, READ)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    control = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(format_conversations(spark, rows.unionByName(control)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS x(i)),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_chars, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + role_chars + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op11_chat_format": op11_chat_format}
ORACLES = {"op11_chat_format": ORACLE}
