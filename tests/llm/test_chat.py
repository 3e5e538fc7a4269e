import hashlib
import random

import pytest

from ledgerloom.llm import chat


def shown(source, **names):
    return "".join(t for t, _ in chat.Template(source).run(names))


@pytest.mark.parametrize(
    "source,names,want",
    [
        ("a{{ x }}b", {"x": 1}, "a1b"),
        ("{{ x.y['z'] }}|{{ x.no.no }}", {"x": {"y": {"z": "q"}}}, "q|"),
        ("{{ 'a' ~ 1 + 2 * 3 ~ \"b\" }}", {}, "a7b"),
        ("{{ (1 + 2) * 3 - -1 }} {{ 7 // 2 }} {{ 7 % 4 }}", {}, "10 3 3"),
        ("{% if a and not b or c == 'x' %}1{% elif b %}2{% else %}3{% endif %}", {"b": True}, "2"),
        ("{{ 'yes' if 'a' in xs else 'no' }}{{ 'q' if 'b' not in xs }}", {"xs": ["a"]}, "yesq"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1p, 2q"),
        ("{% set a = 'n' %}{% for x in xs %}{% set a = x %}{{ a }}{% endfor %}{{ a }}", {"xs": ["1", "2"]}, "12n"),
        ("x  {{- ' y ' -}}  z {# no #}{%- if true -%} w {%- endif %}", {}, "x y z w"),
        ("{{ '}}' }}{{ 'it\\'s\\n' }}", {}, "}}it's\n"),
        ("{{ x|default('d')|upper }}{{ ' s '|trim|length }}{{ 'aba'|replace('a', 'c') }}", {}, "D1cbc"),
        ("{{ none }}{{ true and 3 }}{{ xs[-1] }}{{ xs[9] }}", {"xs": ["l"]}, "3l"),
    ],
)
def test_language(source, names, want):
    assert shown(source, **names) == want


@pytest.mark.parametrize("source", ["{{ x", "{% if x %}", "{% endif %}", "{% for x y %}{% endfor %}", "{{ f(x) }}", "{{ x|exec }}", "{{ __class__ }}", "{{ x._y }}", "{{ x.__class__ }}", "{% import os %}", "{{ 1 2 }}", "{{ }}", "{% set if = 1 %}", "{{ x; y }}", "{% else %}"])
def test_refused(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_nothing_of_python_is_reached():
    assert shown("{{ x.upper }}{{ x.format }}{{ m.keys }}{{ m.values }}", x="s", m={"a": 1}) == ""
    with pytest.raises(chat.TemplateError):
        shown("{{ x }}", x={"a": 1})
    with pytest.raises(chat.TemplateError):
        shown("{{ 'a' * 99999999999 }}")
    with pytest.raises(chat.TemplateError):
        shown("{% for x in 'abc' %}{{ x }}{% endfor %}")


def test_constants_are_folded():
    tree = chat.Template("a{{ 'b' ~ 1 + 1 }}{% if 2 > 1 %}c{{ 'd'|upper }}{% else %}{{ x }}{% endif %}{{ 'e' if false else 'f' }}{{ y if true and z }}").tree
    assert tree == ("block", ("text", "ab2cDf"), ("show", ("choice", ("name", "z"), ("name", "y"), ("const", ""))))
    assert chat.fold(("op", "//", ("const", 1), ("const", 0)))[0] == "op"


def test_generation_spans():
    text, spans = chat.Template("{% for m in messages %}<{{ m }}>{% generation %}{{ m }}!{% endgeneration %}{% endfor %}").text(["a", "bc"])
    assert text == "<a>a!<bc>bc!"
    assert "".join(text[a:b] for a, b in spans) == "a!bc!"


def test_which_templates_stream():
    assert chat.Template(chat.TEMPLATE).streams
    assert not chat.Template("{{ messages[0].role }}{% for m in messages %}{% endfor %}").streams
    assert not chat.Template("{% for m in messages %}{{ messages|length }}{% endfor %}").streams


def test_escapes_are_reversible():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("<|\\\nn>a") for _ in range(rnd.randint(0, 9)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        line = chat.escape_line(text)
        assert "\n" not in line and "<|" not in line and chat.unescape_line(line) == text


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 20, 1, 37])
def test_round_trip(spark, monkeypatch, most):
    """Also with pieces of every size; the tasks of a local session import the module anew, so that they are run here."""
    monkeypatch.setattr(chat, "PIECE_CHARS", most)
    import pyarrow as pa

    rnd = random.Random(most)
    convs = {c: [(rnd.choice(["user", "assistant", "system", "a\nb", "", "<|im_end|>"]), "".join(rnd.choice(["<|im_end|>\n", "<|", "\\", "<", "é", "a", "\n", "😀"]) for _ in range(rnd.randint(0, 30)))) for _ in range(rnd.randint(1, 6))] for c in range(40)}
    flat = [(c, r, t) for c, turns in convs.items() for r, t in turns]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat[i : i + 11], strict=True)], ["conv_id", "role", "text"]) for i in range(0, len(flat), 11)]
    formatted = list(chat.formatter(chat.TEMPLATE)(iter(batches)))
    if most == 1:
        assert sum(b.num_rows for b in formatted) > len(flat)
    got = {r["conv_id"]: r for b in chat.read(iter(formatted)) for r in b.to_pylist()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        text, spans = chat.Template(chat.TEMPLATE).text([{"role": r, "content": t} for r, t in turns])
        assert got[c] == {"conv_id": c, "n_turns": len(turns), "turns_sha256": digest("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": digest(loss), "formatted_chars": len(text)}
        assert "".join(chat.unescape(text[a:b]) for a, b in spans) == loss


def test_rows_ties_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, "first"), (None, 0, "user", "x" * 400_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as piece").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark, df)).collect()}
    assert set(got) == {1, None}
    assert (got[1].n_turns, got[1].loss_chars) == (5, 3)
    assert got[1].turns_sha256 == digest("\nfirst\nuser\n\nassistant\na\nassistant\na\nassistant\nb\n")
    assert got[None].formatted_chars == 400_000 + len("<|im_start|>user\n<|im_end|>\n")
    assert chat.format_conversations(spark, df.limit(0)).collect() == []


def test_another_template(spark):
    df = spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", "r")], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_conversations(spark, df, "{{ messages|length }}{% for m in messages %}[{{ m.content }}]{% endfor %}").collect()
    assert (r.formatted, r.piece, r.spans) == ("2[q][r]", 0, [])
