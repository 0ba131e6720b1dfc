"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and text run is a node with a hidden label, content or not.  Its own features
(tag, names, length, link share, punctuation) give a local potential; parent and child share a
potential that says how often a child of its kind has its parent's label.  Sum-product messages
pass from the leaves up and from the root down; their product at a node is the marginal of its
label.  Runs whose marginal is at least a half are the text.

Both potentials are trained on labelled pages: pairs are counted, local potentials come from a
logistic fit.  The labelled pages are written by ``labelled_pages`` from a seed: many page layouts
with the label of each part known.  Their number is a parameter.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.llm.html_tree import Node, parse

TRAINING_PAGES = 500
_FLUSH = 4 << 20

# Features.
_TAGS = "p h1 h2 h3 h4 h5 h6 li td th div section article main aside nav header footer form ul ol dl table blockquote pre figure figcaption address fieldset details dialog body".split()
_AGAINST = frozenset(
    "nav navbar navigation menu header masthead topbar footer foot bottom sidebar side aside rail ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notification alert warning popup modal overlay newsletter subscribe subscription signup login signin register search form comment comments "
    "commentlist reply replies respond disqus discussion share sharing social follow related recommended recommendations more popular trending tags tag breadcrumb breadcrumbs "
    "pagination pager widget widgets legal copyright disclaimer skip hidden meta byline toolbar tools utility".split()
)
_FOR = frozenset("article content contents main post entry story body text page hentry articlebody maincontent document".split())
_HEADS = frozenset(("header", "head", "title"))
#: Names that say how a page looks or what an article is filed under, not what an element is.
_STATES = frozenset("has no not with without is are can show hide sticky fixed js single logged enable enabled supports".split())
_FILED = frozenset("tag tags category cat format type status author topic term post postid page".split())
_WRAPS = frozenset("wrap wrapper wrapping container layout grid holder inner outer row cols columns area".split())
_WORDS_AGAINST = re.compile(
    r"^(?:©|\(c\)|copyright\b|all rights reserved|advertisement|sponsored|subscribe|sign up|log ?in|share|related|read more|comments?\b|leave a (?:reply|comment)|"
    r"\d+ comments?|reply\b|we use cookies|this (?:site|website) uses cookies|privacy|terms|skip to|menu|search|posted by|follow us|cookies?\b)|(?:cookies|newsletter|all rights reserved)",
    re.I,
)
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_ON_COMMENTS = re.compile(r"^(?:\d+\s+|no\s+|reader\s+|user\s+|your\s+)*(?:comments?|responses?|replies|reply|discussion|leave a (?:reply|comment)|join the (?:discussion|conversation)|what do you think\??)(?:\s*\(?\d+\)?)?:?$", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = re.compile(r"[.!?…:;,](?:\s|$)")
_KINDS = ("run", "p", "heading", "list", "table", "box", "frame")
_KIND_OF = {"": 0, "p": 1, **{f"h{i}": 2 for i in range(1, 7)}, "ul": 3, "ol": 3, "li": 3, "dl": 3, "dt": 3, "dd": 3, "table": 4, "tr": 4, "td": 4, "th": 4, "tbody": 4, "nav": 6, "header": 6, "footer": 6, "aside": 6, "form": 6}
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
N_FEATURES = len(_TAGS) + 23


def stance(names: str, in_article: bool = False) -> tuple[bool, bool]:
    """Whether class, id and role speak against content, and whether for it; each name is judged as a whole.

    In a name of several words one that speaks against decides (comment-body, main-nav), but not
    in a wrapper of both kinds (content-sidebar-wrap), after a word of state (has-sidebar,
    page-with-header) or where the first word only files an article (tag-budget, post-42).
    """
    against = favour = False
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if len(words) > 1 and _STATES & set(words):
            continue
        bad = [w for w in words if w in _AGAINST and not (in_article and w in _HEADS)]
        good = any(w in _FOR for w in words)
        if len(words) > 1 and words[0] in _FILED and words[-1] not in _AGAINST:
            bad = [w for w in bad if w != words[0]]
        if bad and good and words[-1] in _WRAPS:
            continue
        against, favour = against or bool(bad), favour or good and not bad
    return against, favour


def _features(nodes: list[Node]) -> np.ndarray:
    """One row per node; a run's element supplies tag and names, an element's runs its text."""
    size, links, ends, runs = ([0] * len(nodes) for _ in range(4))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if not n.tag:
            size[i], links[i], ends[i], runs[i] = len(n.text), n.linked, len(_ENDS.findall(n.text)), 1
        if n.parent >= 0:
            for a in (size, links, ends, runs):
                a[n.parent] += a[i]
    out = np.zeros((len(nodes), N_FEATURES))
    base = len(_TAGS)
    # Holds most of the page's text and an article: a frame around the page, whatever its name or tag.
    core = [n.tag in ("main", "h1") or n.tag == "article" and not stance(n.names)[0] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        core[nodes[i].parent] |= core[i]
    whole = [n.tag in ("html", "body") or core[i] and size[i] >= 0.5 * size[0] for i, n in enumerate(nodes)]
    against, within = [False] * len(nodes), [False] * len(nodes)  # some ancestor or self speaks against, or for, content
    opened, talk = [False] * len(nodes), [False] * len(nodes)  # a heading of comments stood in this element; stands below one
    for i, n in enumerate(nodes):
        own, own_at = (n, i) if n.tag else (nodes[n.parent], n.parent)
        row = out[i]
        if own.tag in _TAG_AT:
            row[_TAG_AT[own.tag]] = 1
        if own.names.strip() and own.tag not in ("html", "body"):
            bad, good = stance(own.names, own.parent >= 0 and within[own.parent])  # the head of an article belongs to it
            row[base], row[base + 1] = bad and not whole[own_at], good
        long = math.log1p(size[i])
        share = links[i] / size[i] if size[i] else 0.0
        row[base + 2] = share
        row[base + 3] = share > 0.5
        row[base + 4] = long / 5
        row[base + 5] = min(ends[i], 10) / 5
        row[base + 6] = size[i] > 0 and ends[i] == 0
        row[base + 7] = n.hidden
        row[base + 8] = not n.tag
        row[base + 9] = math.log1p(runs[i]) / 3
        row[base + 10] = size[i] / max(1, runs[i]) > 80
        row[base + 11] = size[i] / max(1, runs[i]) < 25
        row[base + 12] = not n.tag and bool(_WORDS_AGAINST.search(n.text))
        row[base + 13] = size[i] / max(1, size[0])
        row[base + 14] = size[i] == 0
        row[base + 15] = own.tag in ("nav", "header", "footer", "aside", "form", "dialog") and not whole[own_at]
        row[base + 16] = 1
        if n.parent >= 0:
            up = n.parent
            frame = n.tag in ("nav", "footer", "aside", "form", "dialog") or n.tag == "header" and not within[up]
            # An article or main is judged by its own features; what is below it is not condemned by its name alone.
            told = bool(row[base]) and not (n.tag in ("article", "main") and row[base + 1])
            against[i] = against[up] or bool(n.tag) and not whole[i] and (frame or told)
            within[i] = within[up] or n.tag in ("article", "main") or bool(n.tag) and bool(row[base + 1])
            talk[i] = talk[up] or opened[up]
            if not n.tag and not against[i] and len(n.text) < 60 and _ON_COMMENTS.match(n.text):
                talk[i] = True
                opened[nodes[up].parent if nodes[up].parent >= 0 and len(nodes[up].children) == 1 else up] = True
        row[base + 17] = against[i]
        row[base + 18] = within[i] and not against[i]
        row[base + 19] = not within[i] and not against[i]
        row[base + 20] = within[i] and against[i]
        row[base + 21] = talk[i]
        row[base + 22] = not n.tag and len(n.text) < 200 and bool(_RIGHTS.search(n.text))
    return out


@dataclass
class Model:
    weights: np.ndarray  # log odds of content given the features
    prior: np.ndarray  # of a node's label
    pair: np.ndarray  # kind of the child x label of the parent x label of the child: P(child | parent)
    root: np.ndarray

    def marginals(self, nodes: list[Node], odds: np.ndarray) -> np.ndarray:
        """P(content) of every node by sum-product messages, upward and then downward."""
        p1 = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        local = [(a / self.prior[0], b / self.prior[1]) for a, b in zip((1 - p1).tolist(), p1.tolist(), strict=True)]
        pair = self.pair.tolist()
        n = len(nodes)
        up0, up1 = [x for x, _ in local], [x for _, x in local]  # local potential times messages from children
        to0, to1 = [1.0] * n, [1.0] * n  # message of a node to its parent
        kind = [_KIND_OF.get(x.tag, 5) for x in nodes]
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = pair[kind[i]]
            m0, m1 = a * up0[i] + b * up1[i], c * up0[i] + d * up1[i]
            s = m0 + m1
            to0[i], to1[i] = m0 / s, m1 / s
            j = nodes[i].parent
            up0[j], up1[j] = up0[j] * to0[i], up1[j] * to1[i]
            s = up0[j] + up1[j]
            up0[j], up1[j] = up0[j] / s, up1[j] / s
        down0, down1 = [0.0] * n, [0.0] * n  # message of the parent to a node
        down0[0], down1[0] = self.root.tolist()
        for i in range(1, n):
            j = nodes[i].parent
            r0, r1 = down0[j] * up0[j] / max(to0[i], 1e-300), down1[j] * up1[j] / max(to1[i], 1e-300)
            (a, b), (c, d) = pair[kind[i]]
            m0, m1 = r0 * a + r1 * c, r0 * b + r1 * d
            s = m0 + m1
            down0[i], down1[i] = m0 / s, m1 / s
        return np.array([u1 * d1 / (u0 * d0 + u1 * d1) for u0, u1, d0, d1 in zip(up0, up1, down0, down1, strict=True)])


def train(pages: list[str], penalty: float = 1.0) -> Model:
    """Fit on pages whose elements carry data-label="1" (content) or "0"; children inherit labels."""
    rows, labels = [], []
    pair = np.ones((len(_KINDS), 2, 2))
    root = np.ones(2)
    for html in pages:
        nodes = parse(html)
        x = _features(nodes)
        truth = [max(0, n.label) for n in nodes]
        root[truth[0]] += 1
        for i, n in enumerate(nodes):
            if i:
                pair[_KIND_OF.get(n.tag, 5), truth[n.parent], truth[i]] += 1
        rows.append(x)
        labels += truth
    design, y = np.concatenate(rows), np.array(labels, dtype=float)
    w = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty * np.eye(len(w)), design.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = float(y.mean())
    return Model(w, np.array([1 - share, share]), pair / pair.sum(axis=2, keepdims=True), root / root.sum())


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page; '' for null and empty pages and pages without content."""
    trees = [parse(h or "") for h in pages]
    odds = np.concatenate([_features(t) for t in trees]) @ model.weights if trees else np.zeros(0)
    out, at = [], 0
    for t in trees:
        p = model.marginals(t, odds[at : at + len(t)])
        at += len(t)
        out.append("\n".join(n.text for n, x in zip(t, p.tolist(), strict=True) if not n.tag and x >= 0.5))
    return out


def extract_text(pages: DataFrame, model: Model) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text), one row per input row.

    Whole pages: only code and controls of forms are left out unseen, hidden parts too are judged by
    the model.  Character references are decoded, white space inside a block (line breaks too) is
    one space, blocks are joined in page order by a line feed.  A null or empty page, or one without
    content, gives ''.  Null ids and urls and repeated rows pass through; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            html = []
            for i in range(batch.num_rows):
                html.append(batch.column(2)[i].as_py())
                size += len(html[-1] or "")
                if size > _FLUSH or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(extract(html, sent.value), pa.string())], names=["page_id", "url", "text"])
                    start, size, html = i + 1, 0, []

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


# --- labelled pages --------------------------------------------------------------------------

_PARTS = "an be co de el fi ga hu in jo ka li mo ne or pa qui re so ta un ve wi xa yo za the and ing ion ment ous té ción ung keit".split()


_NEUTRAL = "wrap wrapper container row col col-8 col-main inner layout block region box l-grid section-1 clearfix left center".split()


class _Writer:
    """Writes one page: each part is HTML with its label."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(_PARTS) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        r = self.r
        return " ".join((w := self.words(1, r.choice((4, 10, 20))))[:1].upper() + w[1:] + r.choice((".", ".", ".", "!", "?", ",")) for _ in range(r.randint(low, high)))

    def plain(self) -> str:
        """Text without punctuation: notes, lists in a row, one word over and over."""
        r = self.r
        return self.words(2, r.choice((6, 40, 120))) if r.random() < 0.6 else " ".join(" ".join([self.words(1, 1)] * r.randint(3, 60)) for _ in range(r.randint(1, 5)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def named(self, tag: str, names: str, inner: str, label: int, bare: float = 0.25) -> str:
        """An element with one of the names as class or id; now and then a plain one."""
        r = self.r
        if not names or r.random() < bare:
            name = "" if r.random() < 0.6 else f' class="{r.choice(_NEUTRAL)}"'
        else:
            pick = r.choice(names.split())
            name = f' {r.choice(("class", "id"))}="{r.choice(("", "", "site-", "main-", "the-", "c-")) + pick if r.random() < 0.5 else pick}"'
        return f'<{tag}{name} data-label="{label}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        r = self.r
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return r.choice((" | ", " ", " &middot; ")).join(self.link() for _ in range(n))

    def head(self) -> str:
        r = self.r
        inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", self.link(), "", f"<div>{self.sentences(1, 2)}</div>"))
        parts = [r.choice((self.named("header", "header masthead", inner, 0, 0.5), self.named("div", "header masthead topbar banner", inner, 0, 0.05), ""))]
        parts.append(r.choice((self.named("nav", "nav menu navigation", self.links(r.randint(2, 9)), 0, 0.6), self.named("div", "nav menu navbar top", self.links(r.randint(2, 9)), 0, 0.5), f'<ul data-label="0">{"".join(f"<li>{self.link()}</li>" for _ in range(5))}</ul>', "")))
        if r.random() < 0.2:
            parts.append(self.named("div", "breadcrumb breadcrumbs", " &gt; ".join(self.link() for _ in range(3)), 0, 0.1))
        return "".join(parts)

    def noise(self) -> str:
        """A part that is not content and can stand anywhere."""
        r = self.r
        kind = r.randint(0, 6)
        if kind == 0:
            return self.named(r.choice(("div", "aside", "section")), "ad ads advert advertisement sponsor promo banner", r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 4)}</p>", self.link(3, 8), f"Advertisement <p>{self.words(3, 12)}</p>")), 0, 0.0)
        if kind == 1:
            return self.named(r.choice(("aside", "aside", "div")), "sidebar side rail related widget popular", r.choice(("<h3>" + self.words(1, 3) + "</h3>" + self.links(r.randint(2, 8)), f"<p>{self.sentences(1, 5)}</p>", "".join(f"<p>{self.link(2, 6)}</p>" for _ in range(4)))), 0, 0.05)
        if kind == 2:
            return self.named("div", "cookie cookies consent notice alert notification popup newsletter", r.choice((f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 3), f"<p>We use cookies. {self.sentences(1, 2)}</p><button>OK</button>")), 0, 0.02)
        if kind == 3:
            return self.named("form", "search login subscribe newsletter", f'<label>{self.words(1, 3)}</label><input name="q">' + r.choice(("", f"<p>{self.sentences(1, 3)}</p>", f"<div>{self.words(2, 9)}</div>")) + "<button>Go</button>", 0, 0.6)
        if kind == 4:
            return self.named(r.choice(("div", "ul", "p")), "share social follow tags meta byline", " ".join(self.link(1, 1) for _ in range(r.randint(2, 5))), 0, 0.1)
        if kind == 5:
            return self.named("nav", "pagination pager", self.links(r.randint(2, 4)), 0, 0.5)
        return self.named("section" if r.random() < 0.5 else "div", "related recommended trending popular", f"<h2>{self.words(1, 3)}</h2>" + "".join(f"<p>{self.link(3, 9)}</p>" for _ in range(r.randint(2, 5))), 0, 0.05)

    def comments(self) -> str:
        r = self.r
        one = [self.named(r.choice(("div", "li", "article")), "comment reply", f"<p>{r.choice((self.words(1, 2), self.link(1, 2)))}</p><p>{self.sentences(1, 6)}</p>", 0, 0.2) for _ in range(r.randint(1, 6))]
        tag = r.choice(("section", "div", "ol"))
        title = f"<h3>{r.choice(('Comments', str(r.randint(2, 90)) + ' comments', self.words(1, 3)))}</h3>" if tag != "ol" else ""
        return self.named(tag, "comments commentlist discussion replies disqus", title + "".join(one), 0, 0.03)

    def content(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(2, 9)}</h1>"] if r.random() < 0.75 else []
        if parts and r.random() < 0.2:
            name = r.choice(("entry-header", "post-header", "article-header", "title-block", "head"))
            parts = [f'<{(t := r.choice(("header", "div")))} class="{name}" data-label="1">{parts[0]}' + (self.named("div", "meta byline", f"{self.words(1, 3)} {self.link(1, 2)}", 0, 0.0) if r.random() < 0.5 else "") + f"</{t}>"]
        prose = r.choice((1.0, 1.0, 0.95, 0.8, 0.0))
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            k = r.random()
            text = self.sentences(1, r.choice((1, 3, 8, 20))) if r.random() < prose else self.plain()
            if r.random() < 0.2:
                text = text.replace(" ", f" {self.link(1, 3)} ", 1)
            if k < 0.72:
                parts.append(r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}<br>{self.sentences(1, 3)}</p>")))
            elif k < 0.80:
                parts.append(f"<h{(h := r.randint(2, 4))}>{self.words(1, 7)}</h{h}>")
            elif k < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.90:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif k < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.95:
                parts.append(f"<pre>{self.words(3, 30)}</pre>")
            else:
                parts.append(f"<div>{text}</div>")
            if r.random() < 0.06:
                parts.append("</p>" + self.noise())
        inner = "".join(parts)
        if r.random() < 0.12:
            inner += self.comments()
        wrap = r.choice((("article", "article post entry"), ("article", ""), ("article", ""), ("main", "content main"), ("div", "content article post entry story text articlebody"), ("div", "content post entry"), ("section", "content story"), ("div", "")))
        if r.random() < 0.08:  # no wrapper: the parts stand in the body
            return "".join(part if part.startswith("</p>") else re.sub(r"<(p|h[1-6]|ul|blockquote|table|pre|div)>", r'<\1 data-label="1">', part) for part in parts)
        if r.random() < 0.25:  # names as publishing systems write them, some of which look like parts of the page
            names = " ".join(r.sample(("post-42", "post", "hentry", "category-news", "tag-budget", "tag-menu", "format-standard", "has-post-thumbnail", "status-publish", "entry", "type-page"), r.randint(2, 6)))
            out = f'<{(t := r.choice(("article", "article", "div")))} class="{names}" data-label="1">{inner}</{t}>'
        else:
            out = self.named(*wrap, inner, 1, 0.3)
        for _ in range(r.choice((0, 0, 1, 2))):
            out = f'<{(t := r.choice(("div", "main", "section")))} data-label="1">{out}</{t}>'
        return out

    def foot(self) -> str:
        r = self.r
        inner = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}", f"<p>&copy; 20{r.randint(10, 26)} {self.words(1, 4)}</p>" + self.links(3), self.links(r.randint(2, 8)), f"<p>{self.sentences(1, 4)}</p>"))
        return r.choice((self.named("footer", "footer bottom", inner, 0, 0.6), self.named("footer", "", inner, 0), self.named("div", "footer foot bottom copyright legal", inner, 0, 0.02)))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.06:  # a page of text alone
            return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body data-label="0">{self.content()}</body></html>'
        rights = lambda: f'<{(t := r.choice(("div", "p")))} data-label="0">{r.choice(("All rights reserved.", "&copy; " + self.words(1, 3), "Copyright 20" + str(r.randint(10, 26)) + " " + self.words(1, 4)))}</{t}>'
        bare = lambda: f'<div data-label="0"><{(t := r.choice(("h2", "h3", "p")))}>{r.choice(("Comments", str(r.randint(1, 90)) + " comments", "Comments (" + str(r.randint(1, 30)) + ")", "Discussion", "Leave a reply"))}</{t}>' + "".join(f"<div><b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p></div>" if r.random() < 0.7 else f"<p>{self.sentences(1, 4)}</p>" for _ in range(r.randint(1, 5))) + "</div>"
        body = [self.head(), *(self.noise() for _ in range(r.choice((0, 1, 1, 2, 3)))), self.content(), *(self.noise() for _ in range(r.choice((0, 0, 1, 2))))]
        if r.random() < 0.35:
            body.append(self.comments())
        elif r.random() < 0.25:
            body.append(bare())
        if r.random() < 0.15:
            body.append(rights())
        if r.random() < 0.9:
            body.append(self.foot())
        inner = "".join(body)
        if r.random() < 0.2:
            name = r.choice(("content-sidebar-wrap", "page-with-header", "site-container", "has-sidebar", "layout-sidebar-right", "no-footer", "sticky-header"))
            inner = f'<div class="{name}" data-label="0">{inner}</div>'
        if r.random() < 0.08:
            inner = f'<form id="aspnetForm" data-label="0">{inner}</form>'
        state = f' class="{r.choice(("single has-sidebar", "no-sidebar", "sticky-header", "page-template menu-open", "logged-in single-post postid-42", "home blog"))}"' if r.random() < 0.3 else ""
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body{state} data-label="0">{inner}</body></html>'


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    pages = [_Writer(seed * 100_003 + i).page() for i in range(n)]
    for i in range(0, n, 7):  # some parts are hidden, mostly such as are not content
        label = 'data-label="1">' if i % 5 == 0 else 'data-label="0">'
        before, mark, after = pages[i].rpartition(label)
        pages[i] = f"{before}{mark[:-1]} hidden>{after}" if mark else pages[i]
    return pages


@functools.lru_cache(maxsize=4)
def default_model(n: int = TRAINING_PAGES) -> Model:
    """Fitted once in a process."""
    return train(labelled_pages(n))
