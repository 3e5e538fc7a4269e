import random

import pytest

from ledgerloom.llm import htmltext as h

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href='/'>one</a></li>"
    "<li><a href='/'>two</a></li></ul></nav><!-- <p>no</p> --><div class='cookie-banner'>We use cookies.</div><article><h1>A title &lt;here&gt;</h1><p><b>First\n  words<br>of it &eacute;&nbsp;x.<p>Second one, which is long enough."
    "<div class='ad'>Buy this thing now.</div><p>Third.</p></article><aside>More to read</aside><form><label>Name</label><textarea>typed</textarea></form>"
    "<section id='comments'><p>I liked this article very much indeed.</p></section><footer>&copy; site</footer></body></html>"
)


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    pool = [" ".join(r.choices(h.OWN_WORDS.split(), k=r.randrange(3, 40))).capitalize() + "." for _ in range(200)]
    return h.fit(h.layouts([], pool, 400)), pool


def test_blocks_of_a_page():
    got = [b.text for b in h.blocks(PAGE)]
    assert got == ["Site", "one", "two", "We use cookies.", "A title <here>", "First words of it é x.", "Second one, which is long enough.", "Buy this thing now.", "Third.", "More to read", "Name", "I liked this article very much indeed.", "© site"]
    assert h.blocks(None) == h.blocks("") == h.blocks("<p> <br> </p>") == [] and h.blocks("bare")[0].text == "bare"
    assert [b.text for b in h.blocks("<p>a<b>b</p></i><ul><li>c<li>d<p>e</ul><x-y>f</x-y><a href=\"q>g")] == ["ab", "c", "d", "e", "f", "g"]
    assert h.blocks("<script>never ended") == []


def test_held_out_layouts(model):
    crf, pool = model
    r = random.Random(2)
    pages = [h.relaid(r.sample(pool, r.randrange(1, 9)), pool, r) for _ in range(100)]
    right = sum(x == b.label for p in pages for x, b in zip(crf.decode(p), p))
    assert right >= 0.97 * sum(map(len, pages))
    found = h.blocks(PAGE)
    assert "\n".join(b.text for b, y in zip(found, crf.decode(found)) if y) == "A title <here>\nFirst words of it é x.\nSecond one, which is long enough.\nThird."


def test_viterbi_is_the_best_of_all_labellings(model):
    import itertools

    crf, pool = model
    page = h.relaid(pool[:2], pool, random.Random(3))[:9]
    e = crf.scores(page)
    worth = lambda y: crf.start[y[0]] + sum(e[i][k] for i, k in enumerate(y)) + sum(crf.pair[a, b] for a, b in zip(y, y[1:]))
    assert tuple(crf.decode(page)) == max(itertools.product((0, 1), repeat=len(page)), key=worth)


def test_query(spark, tmp_path):
    pages = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "", "y"), (4, "w", "<article>" + "<p>A sentence that says a thing.</p>" * 5000 + "</article>", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = h.op7_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(len(r.text) == r.n_chars for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[2] == by[3] == "" and by[4].count("\n") == 4999 and "First words of it é x." in by[1] and "cookies" not in by[1]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert h.extract(spark, empty, h.train(empty), ["page_id"]).count() == 0


def test_nothing_but_scripts_and_forms_is_lost():
    text = lambda page: [b.text for b in h.blocks(page)]
    assert text("<head><title>x</title><article><p>Body text here.</p></article>") == ["Body text here."]
    assert text("<head><meta a=b><p>one<p>two") == ["one", "two"]
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>") == ["Let x=2 hold"]
    assert text("<p>a &am<b>p;</b> b &lt; c</p><noscript>plain</noscript>") == ["a &amp; b < c", "plain"]


def test_sample_is_fitted_in_a_task(spark):
    rows = [(i, f"<html><body><nav><a href='/'>menu {i}</a></nav><article><p>{'the water of the river ' * 4}{i}.</p></article></body></html>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    got = {r.page_id: r.text for r in h.extract(spark, pages, h.train(pages, 20), ["page_id"]).collect()}
    assert all(got[i] == ("the water of the river " * 4 + f"{i}.") for i in range(60))
    assert h.train(pages.limit(0)).emission.shape == (1 << h.BITS, 2)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>A<!--> B</p><p>C</p>", ["A B", "C"]),
        ("<p>A<!---> B</p><p>C</p>", ["A B", "C"]),
        ("<p>A<!-- x --!> B</p>", ["A B"]),
        ("<p>A<!-- x > y --> B<!-- open", ["A B"]),
        ("<article><button>ok<p>a</p><p>b</p></article>", ["a", "b"]),
        ("<article><button><div>ok</div></button><p>a</p></article>", ["a"]),
        ("<article><select><option>x<option>y<p>a</p></article>", ["a"]),
        ("<article><select><option>x<option>y</select> t<p>a</p></article>", ["t", "a"]),
        ("<article><button>1<button>2</button><p>a</p><iframe>i<p>b</p></article>", ["a", "b"]),
        ("<body><title>t<p>a</p>", ["a"]),
        ("<article><template><p>x</p></article><p>a</p>", ["a"]),
    ],
)
def test_unclosed_elements_and_comments(page, want):
    assert [b.text for b in h.blocks(page)] == want
