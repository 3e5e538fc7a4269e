"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags, with
references decoded and white space made single. Each block is main text or not.
Features are the tags and the class and id words of its ancestors, and its text
(length, link share, punctuation, digits, capitals). Emission weights and the
weights of label pairs are learnt by maximum likelihood (forward-backward,
AdaGrad) from labelled pages, and the labels of a page are decoded by Viterbi.

``pages`` carries no labels. Training pages are therefore labelled by their
semantic tags (inside ``article`` or ``main``, outside navigation, asides, forms
and the like), and each is also written anew into other layouts, whose blocks'
labels are known: wrappers named by class or id, menus, notices, adverts, forms
and reader comments around and inside the article. The sample is bounded:
``MAX_TRAIN`` pages, by a hash of the page's id; only pages that have such a tag
are learnt from. The model is ``2**BITS`` weights for each label, broadcast.

Defined cases: null, empty or text-free pages give an empty text; unclosed,
crossed or unknown tags are tolerated (a paragraph ends where the next block
begins, and a head where an element opens that can't stand in one); a page without any tags is one block, judged like others; the text of
scripts, styles, templates, form controls and the head is never a block; one of these
elements that nothing closes ends where the next block opens (but a script, a style or a
template, which end with the page or their ancestor); a comment ends as HTML says, also
``<!-->`` and ``--!>``, or with the page; very long pages are read whole, a few at a time;
columns that are kept may have any names; ``br``
is white space; repeated rows stay repeated. Without a page to learn from, the
layouts are made from built-in words.
"""

from __future__ import annotations

import html
import operator
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, by_bytes, picked, table

BITS, MAX_TRAIN, EPOCHS, RATE, L2 = 14, 300, 6, 0.5, 1e-4

TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"[0-9]")
#: Elements within a line; all others end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics svg g text tspan object canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style".split())
#: Elements whose text is never shown as running text.
HIDDEN = set("head title template select option optgroup textarea button iframe datalist".split())
#: Of these, those that end where a block opens, if nothing closes them.
LOOSE = HIDDEN - {"head", "template"}
LISTS = {"select", "datalist", "optgroup"}
#: Elements that can stand in a head; any other ends it.
IN_HEAD = set("base link meta noscript script style template title".split())
#: Elements that an opening block ends.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "aside", "nav", "form", "blockquote", "header", "footer"}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0
    label: int = 0


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _named(tag: str, attributes: str) -> str:
    """A path step: the tag and its class, id and role words."""
    if "=" not in attributes:
        return tag
    words = [w.lower() for m in NAMED.finditer(attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or "")]
    return " ".join([tag, *words]) if words else tag


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in its order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    now, hidden, links = _Open(), 0, 0
    loose: list[int] = []  # places in the stack

    def flush() -> None:
        nonlocal now
        if now.parts:
            text = " ".join("".join(now.parts).split())
            if text:
                out.append(Block(tuple(step for tag, step in stack if tag not in INLINE), text, now.linked))
            now = _Open()

    def close(at: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[at:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[at:]
        while loose and loose[-1] >= at:
            loose.pop()

    def closed(tag: str, at: int) -> bool:
        """Whether an end tag comes before the next such element begins."""
        found = re.compile(rf"<(/?){tag}\b", re.I).search(page, at)
        return found is not None and bool(found[1])

    page, pos = page or "", 0
    while pos <= len(page):
        m = TAG.search(page, pos)
        text = page[pos : m.start() if m else len(page)]
        if text and not hidden:
            now.parts.append(html.unescape(text) if "&" in text else text)
            now.linked += len(text) if links else 0
        if not m:
            break
        pos = m.end()
        end, tag, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if end:
            end = end.lower()
            if end not in INLINE:
                flush()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == end:
                    close(at)
                    break
                if end in INLINE and stack[at][0] not in INLINE:
                    break
        elif tag:
            tag = tag.lower()
            if tag in RAW:
                found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                pos = found.end() if found else len(page)
                continue
            if tag == "br":
                now.parts.append(" ")
                continue
            if stack and tag not in IN_HEAD and (at := next((k for k, (open_tag, _) in enumerate(stack) if open_tag == "head"), -1)) >= 0:
                close(at)
            if tag not in INLINE:
                flush()
                over = [k for k in loose if tag not in ("option", "optgroup") or stack[k][0] not in LISTS]
                if over:
                    close(over[0])
                if tag == "body":
                    close(0)
                ends = ENDS.get(tag, {"p"})
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] in ends:
                        close(at)
                        if "p" not in ends or len(ends) == 1:
                            break
                    elif at < len(stack) and stack[at][0] in SCOPES:
                        break
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                if tag in LOOSE and not closed(tag, pos):
                    loose.append(len(stack))
                stack.append((tag, _named(tag, attributes)))
                hidden += tag in HIDDEN
                links += tag == "a"
    flush()
    return out


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def path_features(path: tuple[str, ...]) -> list[int]:
    found = {"bias"}
    for step in path:
        tag, *words = step.split()
        found.add(f"t:{tag}")
        for w in words:
            found |= {f"w:{w}", f"s:{w[:4]}", f"s:{w[:7]}"}
    if path:
        tag, *words = path[-1].split()
        found |= {f"own:{tag}"} | {f"ow:{w}" for w in words}
    return [_place(x) for x in sorted(found)]


def text_shape(b: Block) -> tuple:
    """What the features of a block's text are made from."""
    t, n = b.text, len(b.text)
    upper, digits = sum(map(operator.ne, t, t.lower())), len(DIGITS.findall(t))
    return min(12, n.bit_length()), min(4, 5 * b.linked // n), t[-1] in ".!?:;…”»", min(4, 20 * digits // n), min(4, 10 * upper // n), min(6, t.count(" ").bit_length()), "".join(c for c in "©|»·@" if c in t)


def text_features(shape: tuple) -> list[int]:
    size, linked, ended, digits, upper, words, has = shape
    found = [f"len:{size}", f"link:{linked}", f"end:{ended}", f"digits:{digits}", f"upper:{upper}", f"words:{words}", *(f"has:{c}" for c in has)]
    return [_place(x) for x in found]


@dataclass
class Crf:
    """Weights: emission[feature, label], pair[label before, label], start[label]."""

    emission: np.ndarray
    pair: np.ndarray
    start: np.ndarray
    known: dict[tuple, np.ndarray] = field(default_factory=dict)

    def scores(self, page: list[Block]) -> np.ndarray:
        if len(self.known) > 100_000:
            self.known.clear()
        out = np.empty((len(page), 2))
        for k, b in enumerate(page):
            if (by_path := self.known.get(b.path)) is None:
                by_path = self.known[b.path] = self.emission[path_features(b.path)].sum(0)
            if (by_text := self.known.get(shape := text_shape(b))) is None:
                by_text = self.known[shape] = self.emission[text_features(shape)].sum(0)
            out[k] = by_path + by_text
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi; ties to label 0."""
        if not page:
            return []
        scores, back = self.scores(page).tolist(), []
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        for e0, e1 in scores[1:]:
            to0, to1 = b + p10 > a + p00, b + p11 > a + p01
            a, b = e0 + (b + p10 if to0 else a + p00), e1 + (b + p11 if to1 else a + p01)
            back.append((to0, to1))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[list[Block]], epochs: int = EPOCHS) -> Crf:
    """Maximum likelihood by AdaGrad, one page at a time."""
    model = Crf(np.zeros((1 << BITS, 2)), np.zeros((2, 2)), np.zeros(2))
    squares = [np.full_like(w, 1e-6) for w in (model.emission, model.pair, model.start)]
    ready = [(np.array([len(f) for f in fs]), np.concatenate(fs), np.array([b.label for b in page])) for page in pages if page for fs in [[path_features(b.path) + text_features(text_shape(b)) for b in page]]]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(ready)):
            sizes, flat, y = ready[k]
            flat = flat.astype(np.int64)
            rows = np.repeat(np.arange(len(y)), sizes)
            e = np.add.reduceat(model.emission[flat], np.append(0, sizes.cumsum()[:-1]), 0)
            n = len(y)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = model.start + e[0]
            for i in range(1, n):
                x = alpha[i - 1][:, None] + model.pair
                alpha[i] = np.logaddexp(x[0], x[1]) + e[i]
            for i in range(n - 2, -1, -1):
                x = model.pair + (e[i + 1] + beta[i + 1])[None, :]
                beta[i] = np.logaddexp(x[:, 0], x[:, 1])
            z = np.logaddexp(*alpha[-1])
            p = np.exp(alpha + beta - z)
            g = p
            g[np.arange(n), y] -= 1
            joint = np.exp(alpha[:-1, :, None] + model.pair[None] + (e[1:] + beta[1:])[:, None, :] - z).sum(0)
            np.add.at(joint, (y[:-1], y[1:]), -1.0)
            spots, where = np.unique(flat, return_inverse=True)
            ge = np.zeros((len(spots), 2))
            np.add.at(ge, where, g[rows])
            ge += L2 * model.emission[spots]
            squares[0][spots] += ge * ge
            model.emission[spots] -= RATE * ge / np.sqrt(squares[0][spots])
            for w, grad, s in ((model.pair, joint, squares[1]), (model.start, g[0], squares[2])):
                s += grad * grad
                w -= RATE * grad / np.sqrt(s)
    return model


# Names that mark the parts of a page, for the layouts that labelled pages are written into.
MAIN = ["<article>", "<main>", '<div class="content">', '<div class="post-body">', '<section class="entry-content">', '<div id="main-text">', '<div class="article-body">', '<div class="story">', '<article class="post">', '<main id="content">']
ASIDE = {
    "menu": ["<nav>", '<ul class="menu">', '<div class="navbar">', '<div id="navigation">', '<div class="breadcrumbs">', '<ul class="toc">', '<div class="pagination">'],
    "header": ["<header>", '<div class="site-header">', '<div id="header">', '<div class="masthead">', '<div class="topbar">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="page-footer">', '<div class="copyright">', '<div class="legal">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<div id="side-column">', '<div class="widget">', '<div class="related">', '<div class="recommended">', '<div class="share-social">', '<div class="author-bio">'],
    "notice": ['<div class="notice">', '<div class="cookie-banner">', '<div id="gdpr-consent">', '<div class="newsletter-subscribe">', '<div role="alert">', '<div class="alert">', '<div class="popup modal">', '<div class="paywall">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div class="banner-ad">', '<p class="ad">', '<aside class="ad">'],
    "form": ["<form>", '<form class="search">', '<form id="login-form">', '<div class="contact-form">', "<form><label>", "<form><fieldset>"],
    "comments": ['<div class="comments">', '<section id="comments">', '<ul class="comment-list">', '<div class="reader-comments">', '<div id="disqus-thread">', '<div class="comment">', '<section class="discussion responses">', '<div class="replies">'],
}
NOT_MAIN = {"nav", "aside", "footer", "header", "form", "fieldset", "menu", "dialog", "label", "legend"}
NOT_WORDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "sidebar", "menu", "nav", "footer", "cookie", "banner", "newsletter", "promo", "related", "share", "notice", "alert", "form"}
OWN_WORDS = "the of a river house wind stone light water road open small every between morning"


def semantic_labels(page: list[Block]) -> bool:
    """Labels the blocks by their semantic tags; false if the page has none."""
    found = False
    for b in page:
        steps = [s.split() for s in b.path]
        inside = [i for i, s in enumerate(steps) if s[0] in ("article", "main")]
        found |= bool(inside)
        b.label = int(bool(inside) and not any(s[0] in NOT_MAIN or NOT_WORDS & set(s[1:]) for s in steps))
    return found


def relaid(texts: list[str], pool: list[str], r: random.Random) -> list[Block]:
    """Main texts in a layout of its own: the blocks of a page that is written out and cut again, with their labels."""
    mark = "\x02"

    def ends(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))

    def some(kind: str) -> str:
        opening, n = r.choice(ASIDE[kind]), r.randrange(1, 6)
        long = kind in ("comments", "notice", "sidebar", "advert")
        lines = [html.escape(r.choice(pool) if long and r.random() < 0.6 else " ".join(r.choice(pool).split()[: r.randrange(1, 7)])) for _ in range(n)]
        if "<ul" in opening:
            inner = "".join(f"<li><a href='/'>{x}</a></li>" if kind == "menu" else f"<li><p>{x}</p></li>" for x in lines)
        elif kind == "menu":
            inner = "".join(f"<a href='/'>{x}</a> " for x in lines) if r.random() < 0.5 else "<ul>" + "".join(f"<li><a href='/'>{x}</a></li>" for x in lines) + "</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{x}</label><input><p>{x}</p>" for x in lines[:2])
        else:
            inner = "".join(f"<{t}>{'&copy; ' if kind == 'footer' and r.random() < 0.5 else ''}{x}</{t}>" for x in lines for t in [r.choice(["p", "p", "div", "span", "h3"])])
        return opening + inner + ends(opening)

    opening = r.choice(MAIN)
    parts = []
    for i, t in enumerate(texts):
        tag = r.choice(["h1", "h2"]) if i == 0 and r.random() < 0.7 else r.choice(["p", "p", "p", "p", "li", "blockquote", "h2", "h3", "td", "pre"])
        body = mark + html.escape(t)
        parts.append(f"<ul><li>{body}</li></ul>" if tag == "li" else f"<table><tr><td>{body}</td></tr></table>" if tag == "td" else f"<{tag}>{body}</{tag}>")
        if r.random() < 0.12:
            parts.append(some(r.choice(["advert", "notice", "sidebar", "form", "comments"])))
    if r.random() < 0.3:
        parts.append(some("comments"))
    before = [some(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.5]
    after = [some(k) for k in ("comments", "sidebar", "advert", "form", "menu", "footer") if r.random() < 0.5]
    outer = r.choice(["", '<div class="wrapper">', '<div id="page"><div class="container">'])
    page = blocks("<html><body>" + outer + "".join(before) + opening + "".join(parts) + ends(opening) + "".join(after) + ends(outer) + "</body></html>")
    for b in page:
        b.label = int(mark in b.text)
        b.text = b.text.replace(mark, "")
    return page


def layouts(seen: list[list[Block]], pool: list[str], n: int, seed: int = 7) -> list[list[Block]]:
    """n labelled pages: main texts of seen pages, or drawn from pool, in layouts of their own."""
    r, made = random.Random(seed), []
    for i in range(n):
        main = [b.text for b in seen[i % len(seen)] if b.label] if seen and i % 2 else []
        main = main[:40] or [r.choice(pool) for _ in range(r.randrange(1, 12))]
        if i % 4 == 0:  # short lines can be main text as well, in any case and number
            main = [(t.upper() if i % 8 else t)[: r.randrange(4, 40)].strip() or t for t in main for _ in range(r.choice([1, 1, 8]))]
        made.append(relaid(main, pool, r))
    return made


WEIGHTS = "emission binary, pair binary, start binary"


def train(pages: DataFrame, max_train: int = MAX_TRAIN) -> Crf:
    """From the columns page_id and html: about max_train pages, by a threshold on a hash of the id, and the fit in one task over them."""
    rows = pages.where("html is not null").select("page_id", "html", F.xxhash64("page_id").alias("h"))
    total = max(1, rows.count())
    sample = rows if total <= max_train else rows.where(picked(F.col("h"), max_train, total))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = sorted((h, i, x) for b in batches for h, i, x in zip(*(b.column(c).to_pylist() for c in ("h", "page_id", "html"))))
        seen = [b for _, _, x in picked if (b := blocks(x)) and semantic_labels(b)]
        pool = [b.text[:600] for page in seen for b in page] or [OWN_WORDS]
        model = fit(seen + layouts(seen, pool, 2 * max(len(seen), 100)))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()) for w in (model.emission, model.pair, model.start)], ["emission", "pair", "start"])

    weights = sample.select("h", F.col("page_id").cast("string").alias("page_id"), "html").repartition(1).mapInArrow(learn, WEIGHTS).collect()
    if not weights:  # no page at all
        return fit(layouts([], [OWN_WORDS], 200))
    return Crf(*(np.frombuffer(w).reshape(shape).copy() for w, shape in zip(weights[0], ((1 << BITS, 2), (2, 2), (2,)))))


def extract(spark: SparkSession, pages: DataFrame, model: Crf, keep: list[str]) -> DataFrame:
    """keep (columns of pages), with the main text of the column html and its length in code points."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.emission, model.pair, model.start))

    def main_text(crf: Crf, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, crf.decode(found)) if y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shared.value)
        for b in by_bytes(batches, "html"):
            texts = [main_text(crf, x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    schema = ", ".join([*(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "text string, n_chars bigint"])
    out = pages.select(*dict.fromkeys([*keep, "html"])).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(spark, pages, train(pages), ["page_id", "url"])


QUERIES = {"op7_html_extraction": op7_html_extraction}
