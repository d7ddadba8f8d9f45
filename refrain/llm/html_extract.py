"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of elements. Each element has features: its tag's kind, words of its and its
ancestors' attributes that tell menus, notices or comments from content, depth, place among its siblings,
and the subtree's text, link and tag densities. Boosted trees give each element the odds that its subtree
holds main text. Decoding picks the set of kept elements of the greatest total log-odds among those in which
no element is kept below a dropped one: leaves to root adds up what keeping is worth, root to leaves keeps
what is worth more than nothing. What never is text (scripts, styles, forms, markup) is left out before.

The trees are fitted once on generated pages (PAGES of them, fixed seed, bounded), whose labels are known.

Defined cases: null, empty and textless pages give an empty text; unclosed and stray tags are tolerated (text-only
elements as scripts end as HTML has it); names of states (has-sidebar, comments-open) and names on html and body tell
nothing of an element; a header inside an article and a list of links alone are taken for boilerplate; bare text goes with the body, also where the page leaves the body's tags out;
repeated rows come back each; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import only

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template title form button select textarea svg iframe object canvas".split())
HEADED = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CONTROLS = frozenset("option optgroup fieldset legend datalist output meter progress".split()) | UNSEEN
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What does not end a word: void elements but line breaks and rules, and what is not shown where it stands.
SEAMLESS = INLINE | VOID - {"br", "hr"} | {"script", "style", "template"}
KINDS = ("html body", "main article", "section div", "p", "h1 h2 h3 h4 h5 h6", "nav menu", "aside", "header", "footer", "ul ol dl", "li dt dd", "table thead tbody tr td th", "blockquote pre figure figcaption", "a", "form dialog")
CLOSED_BY = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer main blockquote pre form figure hr".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "option": frozenset(["option"])}
# Attribute words that tell what an element is for.
TOKENS = (
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner",
    "footer foot copyright colophon",
    "header masthead topbar logo",
    "sidebar aside related recommended widget rail trending",
    "comment comments reply replies discussion disqus respond",
    "cookie cookies consent notice notification alert popup modal overlay gdpr newsletter subscribe",
    "share social follow login signup search",
    "article post story entry content main body text prose",
)
_TOKEN = {w: i for i, ws in enumerate(TOKENS) for w in ws.split()}
_KIND = {t: i for i, ts in enumerate(KINDS) for t in ts.split()}
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Words that make a name one of a state (has-sidebar, comments-open), which says nothing about what the element is.
_STATE = re.compile(
    r"(?:^|[-_])(?:has|with|without|no|not|is|show|hide)[-_]|[-_](?:open|opened|closed|enabled|disabled|on|off|active|inactive|visible|hidden|shown)$", re.I
)

PAGES = 500
TREES, DEPTH, BINS, RATE = 50, 3, 24, 0.3
#: Elements that the trees look at at once, about.
ELEMENTS = 1 << 12


@lru_cache(maxsize=1 << 14)
def _meanings(value: str) -> frozenset[int]:
    """Which of TOKENS an attribute's names stand for; names of states stand for none."""
    words = (w.lower() for n in value.split() if not _STATE.search(n) for w in _WORDS.findall(n))
    return frozenset(_TOKEN[w] for w in words if w in _TOKEN)


class Dom(HTMLParser):
    """The elements in page order: parent, tag, attribute words; and the text pieces with their element.

    A piece is (element, text); a block's edge is a piece of None. html and body are there even if the page leaves
    their tags out, as HTML has it, and stay open to its end; so all text stands in body.

    unseen: what is open from an unseen element on. A head ends before the first tag or text that may not stand in it,
    other unseen elements end with their nearest open ancestor at the latest. Those that their own end tag does not
    end are in ``unclosed`` (numbers of unseen elements); if those are given as ``loose``, they end before the first block too.
    """

    def __init__(self, loose: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens, self.label = [-1], ["#"], [frozenset()], [False]
        self.open = [0]
        self.unseen: list[tuple[str, int]] = []
        self.loose, self.unclosed, self.met = loose, set(), 0
        self.has: set[str] = set()
        self.implied: set[int] = set()
        self.pieces: list[tuple[int, str | None]] = []

    def _reveal(self, k: int) -> None:
        """What is open from the kth unseen on ends, by another tag than its own."""
        self.unclosed.update(i for _, i in self.unseen[k:] if i)
        del self.unseen[k:]

    def _end_loose(self) -> None:
        while k := next((k for k in range(len(self.unseen), 0, -1) if self.unseen[k - 1][1]), 0):
            if self.unseen[k - 1][1] not in self.loose:
                break
            self._reveal(k - 1)

    def _push(self, tag, attrs) -> None:
        # What stands on html and body names the page, not a part of it.
        named = [v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop")] if attrs and tag not in ("html", "body") else ()
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.tokens.append(frozenset().union(*map(_meanings, named)))
        self.label.append(any(k == "data-main" for k, _ in attrs))
        self.open.append(len(self.tag) - 1)

    def _imply(self, *tags: str) -> None:
        for tag in tags:
            if tag not in self.has:
                self.has.add(tag)
                self._push(tag, ())
                self.implied.add(self.open[-1])

    def handle_starttag(self, tag, attrs):
        number = 0
        if tag in UNSEEN:
            self.met += 1
            number = self.met
        if self.unseen:
            if self.unseen[0][0] == "head" and (tag == "body" or len(self.unseen) == 1 and tag not in HEADED):
                self._reveal(0)
            elif self.loose and tag not in INLINE and tag not in VOID and tag not in CONTROLS:
                self._end_loose()
        if self.unseen:
            if tag not in VOID:
                self.unseen.append((tag, number))
            return
        if tag in self.has:
            return
        if tag == "body":
            self._imply("html")
        elif tag not in HEADED and tag not in ("html", "head"):
            self._imply("html", "body")
        if tag in ("html", "body"):
            self.has.add(tag)
        while len(self.open) > 1:
            # An open element ends here if the new one closes it, with the inline ones inside it.
            k = len(self.open) - 1
            while k and self.tag[self.open[k]] in INLINE:
                k -= 1
            if tag not in CLOSED_BY.get(self.tag[self.open[k]], ()):
                break
            del self.open[k:]
        if tag not in SEAMLESS:
            self.pieces.append((self.open[-1], None))
        if tag in UNSEEN:
            self.unseen.append((tag, number))
            return
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.unseen:
            if self.unseen[-1][0] == tag:
                self.unseen.pop()
        elif tag not in VOID and not self.unseen and self.tag[self.open[-1]] == tag and tag not in INLINE and tag not in _KIND:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.unseen:
            k = next((k for k in range(len(self.unseen) - 1, -1, -1) if self.unseen[k][0] == tag), None)
            if k is not None:
                self._reveal(k + 1)
                self.unseen.pop()
                return
            if not self._opened(tag):
                return
            self._reveal(0)
        if tag not in SEAMLESS:
            self.pieces.append((self.open[-1], None))
        if k := self._opened(tag):
            del self.open[k + (tag in ("html", "body")) :]
            self._reopen()

    def _opened(self, tag) -> int:
        """The place of the open element that the end tag ends; 0 if there is none."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                return k
            if tag in INLINE and self.tag[self.open[k]] not in INLINE:
                break
        return 0

    def _reopen(self) -> None:
        """Behind the end of html, body goes on."""
        if self.tag[self.open[-1]] == "html" and "body" in self.has:
            self.open.append(self.tag.index("body"))

    def handle_data(self, data):
        if [x[0] for x in self.unseen] == ["head"] and data.strip():
            self._reveal(0)
        if not self.unseen:
            if "body" not in self.has and data.strip():
                self._imply("html", "body")
            self.pieces.append((self.open[-1], data))

    def close(self):
        super().close()
        self._reveal(0)


def parse(html: str) -> Dom:
    loose: frozenset[int] = frozenset()
    while True:
        dom = Dom(loose)
        dom.feed(html)
        dom.close()
        if dom.unclosed <= loose:
            return dom
        loose |= dom.unclosed


def features(dom: Dom) -> np.ndarray:
    """One row per element; children have larger numbers than their parents."""
    n = len(dom.tag)
    text, link, marks, tags = (np.zeros(n) for _ in range(4))
    for e, piece in dom.pieces:
        if piece and (size := len(piece.strip())):
            text[e] += size
            marks[e] += sum(map(piece.count, ".,;:!?"))
    own = text.copy()
    inside_a = np.zeros(n, bool)
    depth, place, below = np.zeros(n), np.zeros(n), np.zeros(n)
    above = np.zeros((n, len(TOKENS)))
    kind_above = np.zeros((n, len(KINDS)))
    for i in range(1, n):
        p = dom.parent[i]
        depth[i], place[i] = depth[p] + 1, below[p]
        below[p] += 1
        inside_a[i] = inside_a[p] or dom.tag[i] == "a"
        above[i] = above[p]
        above[i, list(dom.tokens[p])] = 1
        kind_above[i] = kind_above[p]
        if dom.tag[p] in _KIND:
            kind_above[i, _KIND[dom.tag[p]]] = 1
    link[inside_a] = text[inside_a]
    tags += 1
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        for a in (text, link, marks, tags):
            a[p] += a[i]
    total = max(text[0], 1.0)
    parent = np.maximum(np.array(dom.parent), 0)
    kind, token = np.zeros((n, len(KINDS))), np.zeros((n, len(TOKENS)))
    for i in range(n):
        if dom.tag[i] in _KIND:
            kind[i, _KIND[dom.tag[i]]] = 1
        token[i, list(dom.tokens[i])] = 1
    dense = text / tags
    columns = [depth, place, below[parent] - place, below, np.log1p(text), np.log1p(own), text / total, link / np.maximum(text, 1), marks / np.maximum(text, 1), np.log1p(dense), np.log1p(dense[parent]), (link / np.maximum(text, 1))[parent], tags]
    return np.column_stack([np.array(columns).T, kind, token, above, kind_above])


class Boosted:
    """Boosted regression trees on the logistic loss, of fixed depth over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]).astype(np.int16)

    def _tree(self, b, g, h):
        inner = 2**DEPTH - 1
        column, cut, value = np.zeros(inner, int), np.full(inner, BINS), np.zeros(2**DEPTH)
        node = np.zeros(len(g), int)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            spot = node - first
            for c in range(b.shape[1]):
                place = spot * BINS + b[:, c]
                sg = np.bincount(place, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                sh = np.bincount(place, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                ag, ah = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (ag - sg) ** 2 / (ah - sh + 1) - ag**2 / (ah + 1)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i], column[first + i], cut[first + i] = top[i], c, k[i]
            node = 2 * node + 1 + (b[np.arange(len(b)), column[node]] > cut[node])
        leaf = node - inner
        sg, sh = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        value = RATE * sg / (sh + 1)
        return (column, cut, value), leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, column[node]] > cut[node])
            f += value[node - (2**DEPTH - 1)]
        return f


def _page(r: random.Random) -> str:
    """A generated page; elements of main text have the attribute data-main, which no feature sees."""

    def words(a, b):
        out = ["".join(r.choice("abcdeghilmnoprstuvé") for _ in range(r.randint(1, 10))) for _ in range(r.randint(a, b))]
        return " ".join(w + (r.choice(".,;") if r.random() < 0.12 else "") for w in out)

    def links(a, b):
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(r.randint(a, b)))

    def paragraphs(a, b, main=True):
        m = " data-main" if main else ""
        out = []
        for _ in range(r.randint(a, b)):
            t = words(1, 90)
            if r.random() < 0.2:
                t = f"<{(g := r.choice(['b', 'em', 'i', 'strong', 'span']))}{m}>{t}</{g}>"
            if r.random() < 0.1:
                t = f'{t} <a href="#"{m}>{words(1, 4)}</a> {words(1, 20)}'
            out.append(f"<p{m}>{t}" + ("</p>" if r.random() < 0.9 else ""))
            if r.random() < 0.12:
                out.append(f"<h2{m}>{words(1, 6)}</h2>")
            if r.random() < 0.08:
                out.append(f"<ul{m}>" + "".join(f"<li{m}>{words(1, 15)}</li>" for _ in range(4)) + "</ul>")
            if r.random() < 0.05:
                out.append(f"<blockquote{m}><p{m}>{words(5, 40)}</p></blockquote>")
            if r.random() < 0.04:
                out.append(f"<table{m}><tr{m}><td{m}>{words(1, 4)}</td><td{m}>{words(1, 4)}</td></tr></table>")
            if r.random() < 0.06:
                out.append(aside("div"))
        return "".join(out)

    def aside(tag=None):
        kind = r.choice(["ad", "ads", "advert", "sponsored", "promo", "related", "sidebar", "widget", "cookie-notice", "notice", "newsletter", "share", "social", "popup"])
        tag = tag or r.choice(["div", "div", "aside", "section"])
        how = r.choice(["class", "class", "id"])
        inner = r.choice([words(2, 40), f"<p>{words(3, 40)}</p>", f"<ul>{links(2, 6)}</ul>", f"<h3>{words(1, 3)}</h3><p>{words(2, 20)}</p>"])
        return f'<{tag} {how}="{kind}">{inner}</{tag}>'

    def comments():
        one = r.choice(['<li class="comment">', '<div class="comment">', "<div>"])
        body = "".join(f"{one}<p>{words(3, 40)}</p></{'li' if one.startswith('<li') else 'div'}>" for _ in range(r.randint(1, 5)))
        return f'<{(g := r.choice(["section", "div"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "discussion", "reader-comments", "replies"])}"><h3>{words(1, 3)}</h3>{body}</{g}>'

    parts = [r.choice([f"<nav><ul>{links(3, 9)}</ul></nav>", f'<div class="{r.choice(["nav", "menu", "navbar"])}"><ul>{links(3, 9)}</ul></div>', f"<header><a href='/'>{words(1, 3)}</a><nav>{links(2, 5)}</nav></header>", f'<header><h2>{words(1, 4)}</h2><p>{words(1, 8)}</p></header>'])]
    parts += [aside() for _ in range(r.randint(0, 3))]
    lead = f"<h1 data-main>{words(1, 12)}</h1>" + (f"<p data-main><b data-main>{words(1, 40)}<br>" if r.random() < 0.5 else "")
    main = lead + paragraphs(1, 12)
    tail = comments() if r.random() < 0.35 else ""
    inner = main + (tail if r.random() < 0.4 else "")
    shell = r.choice(["article", "article", "article", "main", "div class='content'", "div id='main'", "div class='post'", "section", "div"])
    body = f"<{shell} data-main>{inner}</{shell.split()[0]}>"
    if r.random() < 0.25:
        body = f"<{(g := r.choice(['main', 'div']))} data-main>{body}{aside()}</{g}>"
    parts.append(body)
    if tail and tail not in inner:
        parts.append(tail)
    parts += [aside() for _ in range(r.randint(0, 2))]
    if r.random() < 0.85:
        parts.append(r.choice([f"<footer>&copy; {words(1, 12)}</footer>", f"<footer><p>{words(1, 20)}</p><ul>{links(1, 5)}</ul></footer>", f'<div class="footer">{words(1, 20)}</div>']))
    return f"<html><head><title>{words(1, 5)}</title></head><body>" + "".join(parts) + "</body></html>"


@lru_cache(maxsize=1)
def model() -> Boosted:
    r = random.Random(11)
    xs, ys = [], []
    for _ in range(PAGES):
        dom = parse(_page(r))
        y = np.array(dom.label)
        for i in range(len(y) - 1, 0, -1):
            y[dom.parent[i]] |= y[i]
        xs.append(features(dom))
        ys.append(y)
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


def kept_elements(dom: Dom, log_odds: np.ndarray) -> np.ndarray:
    """The best set of elements that is closed upwards."""
    n = len(dom.parent)
    worth = log_odds.copy()
    # The root over all elements says nothing, nor do a body that the page does not name and what is over it.
    worth[[0, *dom.implied, *(dom.parent[i] for i in dom.implied)]] = 1e-6
    for i in range(n - 1, 0, -1):
        worth[dom.parent[i]] += max(worth[i], 0.0)
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[dom.parent[i]] and worth[i] > 0
    return kept


def main_text(html: str | None, trees: Boosted) -> str:
    return next(main_texts([html], trees))


def main_texts(pages: Iterable[str | None], trees: Boosted) -> Iterator[str]:
    """The pages' texts in order; the trees look at about ELEMENTS elements of several pages at once."""
    held: list[tuple[Dom, np.ndarray] | None] = []
    size = 0
    for html in pages:
        if html:
            dom = parse(html)
            held.append((dom, features(dom)))
            size += len(dom.tag)
        else:
            held.append(None)
        if size >= ELEMENTS:
            yield from _texts(held, trees)
            held, size = [], 0
    yield from _texts(held, trees)


def _texts(held: list[tuple[Dom, np.ndarray] | None], trees: Boosted) -> Iterator[str]:
    rows = [x[1] for x in held if x]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    at = 0
    for x in held:
        if not x:
            yield ""
            continue
        dom = x[0]
        yield _joined(dom, kept_elements(dom, odds[at : at + len(dom.tag)]))
        at += len(dom.tag)


def _joined(dom: Dom, kept: np.ndarray) -> str:
    """The kept elements' text, block by block."""
    kept |= all(t in ("#", "html", "body") or t in INLINE and t != "a" for t in dom.tag)  # a page of text alone is whole
    blocks, cur = [], []
    for e, piece in [*dom.pieces, (0, None)]:
        if piece is None:
            if words := "".join(cur).split():
                blocks.append(" ".join(words))
            cur = []
        elif kept[e]:
            cur.append(piece)
    return " ".join(blocks)


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    trees = model()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["page_id", "url"]].copy()
            out["text"] = list(main_texts(b["html"], trees))
            yield out

    p = only(pages, page_id="string", url="string", html="string")
    out = p.mapInPandas(each, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
