import numpy as np
import pytest

from ledgerloom.llm import urlfilter as uf

URLS = [
    None, "", "no scheme", "http://a.com", "http://A.Com/x", "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://m.example.com/en/9?q=1#f", "http://example.com/en",
    "http://example.com/fr/1", "http://notexample.com/en/1", "http://b.net/es/1", "http://net/fr/", "http://b.net/en/", "http://b.inet/es/1", "ftp://h?x://y/z", "http://c.org/es/1#/fr/", "x://://q.net/es/", "http://h.net/es/\n?a",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_rules_against_plain(spark, tmp_path):
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = uf.op2_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert {r.verdict for r in got if r.page_id in (0, 1, 2)} == {"allow"}


def test_trees_learn_held_out_urls(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        bad = r.random() < 0.3
        host = f"{'casino' if i % 2 else 'x'}-{r.integers(1e6)}-win" if bad else "".join(r.choice(list("abcdefgh"), 6))
        rows.append((f"http://{host}.example.org/{r.integers(1000)}" + ("?a=1&b=2" if bad else ""), int(bad), i % 4 == 0))
    df = spark.createDataFrame(rows, "url string, label int, held boolean")
    model = uf.train(df.where("not held"))
    got = uf.judge(spark, df.where("held"), model, ["label"]).collect()
    assert np.mean([(x.verdict == "block") == bool(x.label) for x in got]) > 0.97


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1], [None, 7]])
def test_degenerate_labels(spark, labels):
    df = spark.createDataFrame([(f"http://h{i}.org/", y) for i, y in enumerate(labels)], "url string, label int")
    model = uf.train(df)
    one = spark.createDataFrame([(1, "http://q.org/a", "keep")], "page_id long, url string, host string")
    got = uf.judge(spark, one, model, ["page_id"]).first()
    assert got.verdict == ("block" if labels == [1, 1] else "allow")
    assert uf.judge(spark, one.limit(0), model, ["page_id"]).count() == 0


def test_features(spark):
    df = uf.lexical(spark.createDataFrame([("https://aab.c-1.org/x/y1?p=1&q=2",), ("http://" + "h" * 50_000 + "/",), (None,)], "url string"))
    a, b, c = (dict(zip(uf.LEXICAL, r.features)) for r in df.collect())
    assert (a["depth"], a["parameters"], a["hyphens"], a["dots"], a["secure"], a["host_digits"]) == (2, 2, 1, 2, 1, 1)
    assert b["entropy"] == 0 and b["host_length"] == 50_000 and c["url_length"] == 0
