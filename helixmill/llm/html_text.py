"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into its block elements. Each gets features (kind of tag,
attribute tokens, depth, sibling statistics, text, tag and link density of its
subtree); boosted trees give the log-odds of being main text. The choice is then
decoded over the whole tree: a node lies above the main text, in it or is
dropped; below a dropped node all is dropped and below a main node nothing is
"above" again, so that no choice contradicts an ancestor's.

The trees are fitted on the driver from labelled nodes: pages composed by a seeded generator
(layouts with menus, adverts, notices, forms, comments, with and without an element that
contains the article, down to loose and plain text) and at most SAMPLE given
pages of under SHORT characters that mark their article, chosen by hash.

Blocks are joined by one newline in page order; references are decoded and white
space within a block becomes one space.

Cases: null or empty html, or a page without main text, gives an empty text; text outside of all
elements, or straight in the body, can be main text as any other;
broken markup is closed where its parent ends, only script, style and textarea run to the page's end; a tag cut off at the page's end is markup; repeated
rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hash_sample, table

#: Given pages that are learned from, at most, and their length in characters.
SAMPLE, SHORT = 150, 40_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])[^>]*/>|<(script|style|noscript|template|svg|iframe|textarea|select)(?=[\s/>])[^>]*>.*?</\1\s*>"
    r"|<(?:script|style|textarea)(?=[\s/>])[^>]*>.*\Z"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKENS = re.compile(r"[a-z]+")
#: The elements of HTML that start a block of text, and those without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label", "legend", "option"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"div", "section", "center"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"head", "title"}, {"html", "body"},
]
WORDS = [
    {"article", "content", "main", "post", "entry", "story", "body", "text", "articlebody", "prose"}, {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"}, {"nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "tabs", "links", "toc"},
    {"footer", "foot", "copyright", "legal"}, {"header", "masthead", "top", "logo", "branding"}, {"sidebar", "aside", "related", "widget", "recommended", "popular", "complementary"}, {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond"},
    {"cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "signup"}, {"share", "social", "tags", "meta", "byline", "search", "login", "form"},
]


class Page:
    """Block elements in page order (tag, attribute tokens, parent, depth) and the text blocks with their owners."""

    def __init__(self, html: str):
        self.tags, self.tokens, self.parents, self.depths = ["#page"], [frozenset()], [-1], [0]
        self.chars, self.links, self.inner = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        open_: list[tuple[str, int]] = []  # element and the block element that it is or lies in
        held: list[str] = []
        owner, linked = 0, 0

        def flush() -> None:
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((owner, text))
                    self.chars[owner] += len(text)
                held.clear()

        def leave(k: int) -> None:
            nonlocal owner, linked
            if any(t in BLOCKS for t, _ in open_[k:]):
                flush()
            linked -= sum(t == "a" for t, _ in open_[k:])
            del open_[k:]
            owner = open_[-1][1] if open_ else 0

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                said = unescape(html[at : m.start()])
                held.append(said)
                if linked:
                    self.links[owner] += len(said)
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag = tag.lower()
            if m[2] or m[5]:
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), -1)
                if k >= 0:
                    leave(k)
                elif tag in BLOCKS:
                    flush()
                continue
            if tag == "br":
                held.append("\n")
                continue
            if tag in BLOCKS:
                flush()
                closes = {"p"} if tag != "li" else {"p", "li"}
                if tag in ("td", "th", "tr", "dd", "dt", "option"):
                    closes |= {"td", "th", "dd", "dt", "option"} | ({"tr"} if tag == "tr" else set())
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] in closes:
                        leave(k)
                        break
                    if open_[k][0] in BLOCKS:
                        break
            self.inner[owner] += 1
            if tag in VOID:
                continue
            if tag in BLOCKS:
                attrs = m[4] if m[3] else m[7]
                self.tags.append(tag)
                self.tokens.append(frozenset(t for a in _ATTR.findall(attrs) for t in _TOKENS.findall(a.lower())) if "=" in (attrs or "") else frozenset())
                self.parents.append(owner)
                self.depths.append(self.depths[owner] + 1)
                for of in (self.chars, self.links, self.inner):
                    of.append(0)
                owner = len(self.tags) - 1
            linked += tag == "a"
            open_.append((tag, owner))
        if at < len(html):
            held.append(unescape(html[at:]))
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parents = np.array(self.parents)
        chars, links, inner = (np.array(x, float) for x in (self.chars, self.links, self.inner))
        below = [chars.copy(), links.copy(), inner.copy()]
        for of in below:
            for k in range(n - 1, 0, -1):
                of[parents[k]] += of[k]
        sub, sub_links, sub_tags = below
        siblings = np.bincount(parents[1:], minlength=n) if n > 1 else np.zeros(n)
        many = np.where(parents >= 0, siblings[np.maximum(parents, 0)], 1)
        place, like, seen = np.zeros(n), np.zeros(n), {}
        for k in range(1, n):
            place[k] = seen[parents[k]] = seen.get(parents[k], -1) + 1
            like[k] = seen[(parents[k], self.tags[k])] = seen.get((parents[k], self.tags[k]), 0) + 1
        total = max(1.0, sub[0])
        kinds = np.array([[t in g for g in GROUPS] for t in self.tags], float)
        named = np.array([[bool(t & w) for w in WORDS] for t in self.tokens], float)
        above = named.copy()
        for k in range(1, n):
            above[k] = np.maximum(above[k], above[parents[k]])
        up = np.maximum(parents, 0)
        stats = np.stack(
            [np.log1p(chars), np.log1p(sub), sub / (1 + sub_tags), sub_links / (1 + sub), sub / total, np.array(self.depths, float), place, many, like, sub / (1 + sub[up]), sub_links[up] / (1 + sub[up]), np.log1p(inner)], 1
        )
        return np.concatenate([kinds, named, above, kinds[up], stats], 1)

    def text(self, odds: np.ndarray) -> str:
        main = decoded(self.parents, odds)
        return "\n".join(t for owner, t in self.blocks if main[owner])


def decoded(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text in the best consistent choice. States: 0 above, 1 main, 2 dropped."""
    n = len(parents)
    score = np.stack([-odds, odds, -odds], 1)
    best = score.copy()
    for k in range(n - 1, 0, -1):
        up = best[parents[k]]
        up[0] += best[k].max()
        up[1] += max(best[k, 1], best[k, 2])
        up[2] += best[k, 2]
    state = np.zeros(n, int)
    state[0] = int(best[0].argmax())
    for k in range(1, n):
        p = state[parents[k]]
        state[k] = p + int(best[k, p:].argmax()) if p < 2 else 2
    return state == 1


class Trees:
    """Boosted regression trees of logistic loss on binned features."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.3, bins: int = 24):
        self.rounds, self.depth, self.rate, self.n_bins = rounds, depth, rate, bins
        self.trees: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        f = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-6
            node, tree = np.zeros(len(y), int), []
            for level in range(self.depth):
                splits = []
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    splits.append(self._split(b[rows], g[rows], h[rows]))
                tree.append(splits)
                which, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
                node = 2 * node + (b[np.arange(len(b)), which[node]] > cut[node])
            sums, weights = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaves = self.rate * sums / (weights + 1)
            # Cuts as values: right is what is greater than the bin's upper cut.
            levels = [(np.array([s[0] for s in sp]), np.array([self.cuts[s[0]][s[1]] if s[1] < len(self.cuts[s[0]]) else np.inf for s in sp])) for sp in tree]
            self.trees.append((levels, leaves))
            f += leaves[node]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best = (0.0, 0, 10**6)
        if len(b) > 1:
            for k in range(b.shape[1]):
                gs, hs = np.cumsum(np.bincount(b[:, k], g)), np.cumsum(np.bincount(b[:, k], h))
                if len(gs) < 2:
                    continue
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), k, at)
        return best[1], best[2]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for levels, leaves in self.trees:
            node = np.zeros(len(x), int)
            for which, cut in levels:
                node = 2 * node + (x[rows, which[node]] > cut[node])
            out += leaves[node]
        return out


# ---- labelled nodes to learn from


def composed(r: np.random.Generator) -> str:
    """A page whose main text's blocks are marked with the attribute data-main."""
    pick = lambda *a: a[int(r.integers(0, len(a)))]
    say = lambda a, b: " ".join("lorem" if r.random() < 0.1 else "w" * int(r.integers(2, 9)) for _ in range(int(r.integers(a, b))))
    links = lambda a, b: "".join(pick(f"<li><a href='/x'>{say(1, 3)}</a></li>", f"<a href='/x'>{say(1, 3)}</a> ") for _ in range(int(r.integers(a, b))))
    junk = [
        lambda: f"<nav class='{pick('', 'menu', 'navbar main-nav')}'><ul>{links(3, 9)}</ul></nav>",
        lambda: f"<div class='{pick('ad', 'ads banner', 'sponsored', 'advert')}'>{pick('', '<p>')}{say(3, 30)}</div>",
        lambda: f"<header{pick('', ' class=masthead')}><div>{say(1, 8)}</div></header>",
        lambda: f"<aside class='{pick('', 'sidebar', 'related', 'widget')}'><h3>{say(1, 4)}</h3>{pick(f'<ul>{links(2, 7)}</ul>', f'<p>{say(5, 40)}</p>')}</aside>",
        lambda: f"<div {pick('class', 'id')}='{pick('sidebar', 'related-posts', 'menu', 'cookie-notice', 'newsletter', 'notice', 'breadcrumbs', 'share')}'><p>{say(3, 30)}</p>{links(0, 4)}</div>",
        lambda: f"<form class='{pick('', 'search', 'subscribe')}'><p>{say(2, 12)}</p><label>{say(1, 3)}</label><button>{say(1, 2)}</button></form>",
        lambda: f"<{(t := pick('section', 'div'))} {pick('class', 'id')}='{pick('comments', 'comment-list', 'discussion', 'replies')}'><h3>{say(1, 3)}</h3>" + "".join(f"<div class='{pick('comment', 'reply', '')}'><p>{say(4, 60)}</p></div>" for _ in range(int(r.integers(1, 5)))) + f"</{t}>",
        lambda: f"<footer{pick('', ' class=foot')}>{pick(say(3, 25), f'<p>{say(3, 25)}</p><ul>{links(1, 5)}</ul>')}</footer>",
    ]
    block = [
        lambda: f"<p data-main>{say(1, 120)}</p>",
        lambda: f"<p data-main><b>{say(1, 60)}<br>",
        lambda: f"<h2 data-main>{say(1, 9)}</h2>",
        lambda: f"<p data-main>{say(3, 60)} <a href='/y'>{say(1, 4)}</a> {say(1, 40)}</p>",
        lambda: "<ul data-main>" + "".join(f"<li data-main>{say(2, 25)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>",
        lambda: f"<blockquote data-main><p data-main>{say(4, 50)}</p></blockquote>",
        lambda: f"<table data-main><tr data-main><td data-main>{say(1, 6)}</td><td data-main>{say(1, 6)}</td></tr></table>",
    ]
    many = lambda of, a, b: "".join(pick(*of)() for _ in range(int(r.integers(a, b))))
    inside = f"<h1 data-main>{say(1, 12)}</h1>" * int(r.integers(0, 4) > 0)
    for _ in range(int(r.integers(1, 14))):
        inside += pick(*(block[:2] * 4 + block))() + (pick(*junk[1:2], *junk[3:7])() if r.random() < 0.08 else "")
    shell = pick("<article data-main>{}</article>", "<article data-main class='post'>{}</article>", "<main data-main>{}</main>", "<div data-main class='content'>{}</div>", "<div data-main id='article-body'>{}</div>", "<main><article data-main>{}</article></main>", "<div class='wrap'><div data-main class='entry-content'>{}</div></div>")
    kind = r.random()
    if kind < 0.08:  # plain text, with or without some elements around words
        return " ".join(pick("{}", "{}", "<b>{}</b>", "{}\n").format(say(3, 60)) for _ in range(int(r.integers(1, 6))))
    if kind < 0.2:  # text straight in the body, in lines
        loose = "".join(say(4, 60) + pick("<br>", "<br><br>", "\n", "<hr>") for _ in range(int(r.integers(1, 9))))
        return f"<html><head><title>{say(1, 9)}</title></head><body data-main>{many(junk, 0, 3)}{loose}{many(junk, 0, 2)}</body></html>"
    if kind < 0.4:  # blocks of the article between the others, with no element around them
        body = many(junk, 0, 4) + inside + many(junk, 0, 4)
        return pick("{}", "<body>{}</body>", "<!DOCTYPE html><html><head><title>" + say(1, 9) + "</title></head><body>{}</body></html>", "<html><body><div>{}</div></body></html>").format(body)
    body = many(junk, 1, 5) + shell.format(inside) + many(junk, 0, 5)
    body = pick("{}", "<div id='page'>{}</div>", "<div class='container'><div>{}</div></div>").format(body)
    return f"<!DOCTYPE html><html><head><title>{say(1, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(pages: list[str], seed: int = 11, made: int = 580) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of composed pages, where text outside of all elements is main text, and of given pages with one article: nodes in it are main text."""
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(made):
        html = composed(r)
        page = Page(re.sub(r" data-main", "", html))
        # The same page with the mark as a class shows which nodes are main.
        marked = Page(re.sub(r"data-main(?: (?:class|id)='[^']*')?", "class='mainmark'", html))
        xs.append(page.features())
        main = np.array(["mainmark" in t for t in marked.tokens], float)
        main[0] = page.chars[0] > 0
        ys.append(main)
    for html in pages:
        page = Page(html)
        if page.tags.count("article") != 1:
            continue
        inside = np.zeros(len(page.tags), bool)
        for k in range(1, len(inside)):
            inside[k] = page.tags[k] == "article" or inside[page.parents[k]]
        xs.append(page.features())
        ys.append(inside.astype(float))
    return np.concatenate(xs), np.concatenate(ys)


def learned(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on composed pages and at most `sample` given pages under SHORT characters."""
    some = pages.where(F.length("html") < SHORT)
    return Trees().fit(*labelled(hash_sample(some, "html", sample)))


TEXTS = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            parsed = [Page(h or "") for h in batch.column("html").to_pylist()]
            features = [p.features() for p in parsed]
            odds = np.split(trees.odds(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
            texts = [p.text(o) for p, o in zip(parsed, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, TEXTS)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learned(pages))
