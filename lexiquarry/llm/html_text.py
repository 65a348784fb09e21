"""Main text of HTML pages: boosted trees over DOM nodes and hierarchical decoding.

Every element is a node with features: its tag and its parent's, words of class, id and
role (its own and its ancestors') by topic, depth, text, links and tags of its subtree,
and its place among its siblings. Boosted trees give each node's log-odds of holding
main text. Names are one sign among others: in over half of the invented pages the main
text stands in a container without any, and what tells it is its share of the page's prose,
its links against its siblings' and its place. Decoding takes the best choice of all nodes at once under one rule: below a
dropped node all is dropped. So no descendant contradicts its ancestor. Text is kept
if its element and all ancestors are.

The trees are fitted on the driver, always alike, on invented pages whose parts are
known. Scripts, styles and the like hold no text at all. Pages are read in one pass, in
time that grows with their length whatever their markup.

Defined results: null html is an empty page; a page without main text gives an empty
string; broken markup is read as far as it goes (tags may be missing or unclosed);
repeated rows are read alike; other columns are ignored; an empty table gives an empty
table. Within a block white space, also from references and <br>, becomes one space.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.boosting import Trees, fit_trees
from lexiquarry.llm.common import bounded_batches

SEED = 77
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: What stands in a tag after its name, with whole quoted values.
_QUOTED = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
#: So many tags of a page may have quotes that never close; then quotes no longer count.
_OPEN_QUOTES = 8
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and those that hold no text.
_OPAQUE = frozenset("script style textarea title xmp iframe".split())
_SILENT = frozenset("script style textarea title noscript template iframe svg select option button head".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split()
)
#: An opening tag ends an open element of these kinds, up to a barrier.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_P_BARRIER = ("button", "table", "td", "th", "caption", "body", "html")
#: Only the end tags of these reach beyond a table.
_FAR_ENDS = frozenset("table body html article main div section".split())
_KEEP_P = frozenset("body html option select tbody td tfoot th thead tr caption".split())

#: Words of class, id and role by topic (fixed values of the features).
TOPICS = {
    "nav": "nav menu navbar navigation navigate breadcrumb breadcrumbs toc pagination pager skip tabs topnav submenu",
    "ads": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner dfp adslot adbox",
    "foot": "footer foot copyright colophon imprint legal bottom",
    "head": "header head masthead topbar logo brand top site-header branding",
    "side": "sidebar aside side related widget widgets recommend recommended recommendations trending popular more rail complementary secondary",
    "talk": "comment comments commentlist disqus reply replies discussion respond responses feedback thread",
    "note": "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup gdpr privacy paywall dialog warning message toast",
    "share": "share sharing social tweet follow",
    "form": "form search login searchbox contact input",
    "main": "article content main post entry story body text page maincontent articlebody post-content hentry",
}
_TOPIC_OF = {w: i for i, words in enumerate(TOPICS.values()) for w in words.split()}
_N_TOPICS = len(TOPICS)
TAGS = ["html", "body", "div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "h1", "h2", "h3", "table", "tr", "td", "blockquote", "pre", "figure", "span", "b", "dl", "ins", "details", "label", "dialog"]
_TAG_NO = {t: i + 1 for i, t in enumerate(TAGS)}


class Page:
    """The elements of a page in order, and its text pieces.

    parent, tag, topics: one entry for each element. pieces: (element, text, new block)
    in order; a piece starts a block or goes on with the one before."""

    __slots__ = ("parent", "pieces", "tag", "topics")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.topics: list[int] = [0]
        self.pieces: list[tuple[int, str, bool]] = []


def _topics(attributes: str) -> int:
    bits = 0
    for m in _ATTR.finditer(attributes):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("hidden", "aria-hidden") and value.lower() != "false":
            bits |= 1 << _N_TOPICS
        elif name in ("class", "id", "role", "itemprop"):
            for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                t = _TOPIC_OF.get(w)
                if t is not None:
                    bits |= 1 << t
    return bits


def _tags(source: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, closing) of the tags; comments and declarations have
    no name. Every character is looked at a bounded number of times: a tag that never ends
    is text, and quotes that never close stop to count after ``_OPEN_QUOTES`` of them. The
    caller may send the position to go on from."""
    at, bad = 0, 0
    last = source.rfind(">")
    while (i := source.find("<", at)) >= 0:
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = len(source) if end < 0 else end + 3
            yield i, at, "", "", False
            continue
        if i > last:
            return
        m = _NAME.match(source, i)
        if m is None:
            if source[i + 1 : i + 2] not in ("!", "?"):
                at = i + 1
                continue
            at = source.find(">", i) + 1
            yield i, at, "", "", False
            continue
        quoted = _QUOTED.match(source, m.end()) if bad < _OPEN_QUOTES else None
        if quoted is None:
            bad += 1
            at = source.find(">", m.end()) + 1
            if not at:
                return
        else:
            at = quoted.end()
        further = yield i, at, m.group(2).lower(), source[m.end() : at - 1], m.group(1) == "/"
        if further is not None:
            at = further
            yield i, at, "", "", False


def parse(source: str) -> Page:
    """Elements and text of a page; never fails, and takes time in proportion to its length."""
    page = Page()
    stack = [0]
    places: dict[str, list[int]] = {"html": [0]}  # where in the stack open elements stand, by name
    parent, tag, topics, pieces = page.parent, page.tag, page.topics, page.pieces
    at, fresh, n = 0, True, len(source)
    ends: dict[str, re.Pattern] = {}

    def say(text: str) -> None:
        nonlocal fresh
        if text and (fresh is False or not text.isspace()):
            pieces.append((stack[-1], text, fresh))
            fresh = False

    def nearest(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close_to(depth: int) -> None:
        nonlocal fresh
        while len(stack) > depth:
            name = tag[stack.pop()]
            places[name].pop()
            fresh = fresh or name in _BLOCK

    def opened(name: str, attributes: str) -> None:
        parent.append(stack[-1])
        tag.append(name)
        topics.append(_topics(attributes) if attributes else 0)
        places.setdefault(name, []).append(len(stack))
        stack.append(len(tag) - 1)

    found = _tags(source)
    for start, end, name, attributes, closing in found:
        if start > at:
            say(source[at:start])
        at = max(at, end)
        if not name:
            continue
        if closing:
            k = nearest((name,))
            if k and (name in _FAR_ENDS or k >= nearest(("table", "body"))):
                close_to(k)
            continue
        if name == "br":
            say(" ")
            continue
        if name in _VOID:
            fresh = fresh or name == "hr"
            continue
        if name == "html" or (name == "body" and places.get("body")):
            continue
        if name in _ENDS:
            kinds, barriers = _ENDS[name]
            wall = nearest(barriers)
            inner = [p for x in kinds for p in places.get(x, ())[-1:] if p > wall]
            if inner and name != "tr":
                close_to(max(inner))
            elif inner:  # a row ends cells and rows back to its table
                close_to(min(places[x][bisect_right(places[x], wall)] for x in kinds if places.get(x) and places[x][-1] > wall))
        elif name in _BLOCK and name not in _KEEP_P and places.get("p") and (k := nearest(("p",))) > nearest(_P_BARRIER):
            close_to(k)
        if name in _OPAQUE:
            pattern = ends.setdefault(name, re.compile(f"</{name}(?![A-Za-z0-9:-])", re.I))
            close = pattern.search(source, at)
            stop = close.start() if close else n
            if name == "xmp":  # text as it stands, though not markup
                fresh = True
                say(source[at:stop].replace("&", "&amp;"))
                fresh = True
            after = source.find(">", stop)
            at = n if after < 0 else after + 1
            found.send(at)
            continue
        if name in _BLOCK:
            fresh = True
        if not (attributes.endswith("/") and name not in _BLOCK):
            opened(name, attributes)
    if at < n:
        say(source[at:])
    return page


def _level(x: float) -> int:
    """Magnitudes in a few levels."""
    return min(63, int(x).bit_length() * 3 + (0 if x < 4 else (int(x) >> (int(x).bit_length() - 2)) & 1))


#: Words of a piece from which it counts as prose.
_PROSE = 8


def node_features(page: Page) -> np.ndarray:
    """Levels of all nodes' features."""
    n = len(page.tag)
    text, linked, points, pieces = [0] * n, [0] * n, [0] * n, [0] * n
    depth, above, in_link = [0] * n, [0] * n, [False] * n
    children, index, paras, links, tags = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    in_article, heads = [0] * n, [0] * n
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | page.topics[p]
        in_link[i] = in_link[p] or page.tag[i] == "a"
        in_article[i] = in_article[p] or page.tag[p] in ("article", "main")
        index[i] = children[p]
        children[p] += 1
        paras[i] = page.tag[i] == "p"
        links[i] = page.tag[i] == "a"
        heads[i] = page.tag[i] in ("h1", "h2")
    longest, prose = [0] * n, [0] * n
    before, prose_before, after_title, titled = [-1] * n, [0] * n, [0] * n, False
    said, told, at = 0, 0, 0
    for node, s, _ in page.pieces:
        # Elements are numbered as they open, so those up to this one have begun.
        for i in range(at, node + 1):
            before[i], prose_before[i], after_title[i] = said, told, titled
        at = max(at, node + 1)
        titled = titled or page.tag[node] == "h1"
        k = len(s.split())
        said += k
        if k >= _PROSE and not in_link[node]:
            prose[node] += k
            told += k
        text[node] += k
        longest[node] = max(longest[node], k)
        pieces[node] += 1
        points[node] += s.count(".") + s.count(",")
        if in_link[node]:
            linked[node] += k
    for i in range(at, n):
        before[i], prose_before[i], after_title[i] = said, told, titled
    own = list(text)
    widest, long_ones = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        text[p] += text[i]
        prose[p] += prose[i]
        widest[p] = max(widest[p], text[i])
        long_ones[p] += prose[i] > 0
        linked[p] += linked[i]
        points[p] += points[i]
        paras[p] += paras[i]
        links[p] += links[i]
        heads[p] += heads[i]
        tags[p] += tags[i]
        longest[p] = max(longest[p], longest[i])
    total, whole = max(1, text[0]), max(1, prose[0])
    rows = []
    for i in range(n):
        p = max(page.parent[i], 0)
        row = [
            _TAG_NO.get(page.tag[i], 0),
            _TAG_NO.get(page.tag[p], 0) if i else 0,
            min(63, depth[i]),
            _level(text[i]),
            _level(own[i]),
            int(20 * linked[i] / max(1, text[i])),
            _level(10 * text[i] / tags[i]),
            int(20 * points[i] / max(1, text[i])) if points[i] <= text[i] * 3 else 60,
            min(63, paras[i]),
            min(63, links[i]),
            _level(longest[i]),
            int(20 * text[i] / total),
            min(63, index[i]),
            min(63, children[p] if i else 0),
            min(63, children[i]),
            int(20 * text[i] / max(1, text[p])),
        ]
        # Against the page and the siblings.
        row += [
            _level(prose[i]),
            int(20 * prose[i] / whole),
            int(20 * prose[p] / whole),
            int(20 * (linked[p] - linked[i]) / max(1, text[p] - text[i])) if i else 0,
            int(20 * text[i] / max(1, widest[p])) if i else 20,
            int(20 * before[i] / total),
            int(20 * prose_before[i] / whole),
            int(after_title[i]),
            min(63, long_ones[p]),
            min(63, long_ones[i]),
            _level(own[p]),
        ]
        row += [(page.topics[i] >> k) & 1 for k in range(_N_TOPICS + 1)]
        row += [(above[i] >> k) & 1 for k in range(_N_TOPICS + 1)]
        row += [int(in_article[i]), min(heads[i], 3)]
        row += [int(page.tag[i] == t) for t in ("nav", "footer", "aside", "form", "header", "p")]
        rows.append(row)
    return np.clip(np.array(rows, np.int64), 0, 63)


def decode(page: Page, scores: np.ndarray) -> list[bool]:
    """The best keep or drop of all nodes, where all below a dropped node is dropped."""
    n = len(page.tag)
    kept, dropped = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        s = float(scores[i])
        kept[i] += s
        dropped[i] -= s
        if i:
            p = page.parent[i]
            kept[p] += max(kept[i], dropped[i])
            dropped[p] += dropped[i]
    out = [False] * n
    for i in range(n):
        out[i] = page.tag[i] not in _SILENT and (i == 0 or (out[page.parent[i]] and kept[i] > dropped[i]))
    return out


def kept_text(page: Page, keep: list[bool]) -> str:
    """Blocks of the kept text, joined by one line feed. Pieces of one block join if
    nothing but dropped text was between them."""
    blocks: list[list[str]] = []
    for node, text, fresh in page.pieces:
        if fresh:
            blocks.append([])
        if keep[node]:
            blocks[-1].append(text)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


class _Maker:
    """Invented pages with known main text."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.tokens = [w for words in TOPICS.values() for w in words.split()]

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        out = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéü", k=r.randint(1, 9))) + r.choice(["", "", "", "", ",", ".", "&amp;", "***", "###"]) for _ in range(r.randint(lo, hi))]
        return " ".join(out) + r.choice([".", ".", ".", "", "!"])

    def attr(self, topic: str, chance: float = 0.8) -> str:
        r = self.rng
        if r.random() > chance:
            return r.choice(["", f' class="x{r.randint(1, 99)}"', ' class="row wrap"'])
        w = r.choice(TOPICS[topic].split())
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "js ", "box-", "site "])}{w}{r.choice(["", "-inner", " clearfix", "-1"])}"'

    def links(self) -> str:
        item = lambda: f'<a href="/{self.rng.randint(1, 999)}">{self.words(1, 3)}</a>'
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(self.rng.randint(1, 9))) + "</ul>"
        return self.rng.choice([" | ", " ", "<br>"]).join(item() for _ in range(self.rng.randint(1, 8)))

    def junk(self, inner: bool = False) -> str:
        r, w = self.rng, self.words
        some = [
            lambda: f"<nav{self.attr('nav', 0.4)}>{self.links()}</nav>",
            lambda: f"<div{self.attr('nav', 1)}>{self.links()}</div>",
            lambda: f"<div{self.attr('ads', 1)}>{r.choice([w(3, 40), '<p>' + w(3, 40) + '</p>', '<a href=x>' + w(2, 12) + '</a>'])}</div>",
            lambda: f"<ins{self.attr('ads', 1)}>{w(2, 20)}</ins>",
            lambda: f"<aside{self.attr('side', 0.5)}><h3>{w(1, 4)}</h3>{r.choice([self.links(), '<p>' + w(5, 50) + '</p>'])}</aside>",
            lambda: f"<div{self.attr('side', 1)}><h2>{w(1, 4)}</h2>{r.choice([self.links(), '<p>' + w(5, 50) + '</p>'])}</div>",
            lambda: f"<div{self.attr('note', 1)}>{r.choice([w(4, 40), '<p>' + w(4, 50) + '</p><button>ok</button>'])}</div>",
            lambda: f"<p{self.attr('note', 1)}>{w(3, 25)}</p>",
            lambda: f"<div{self.attr('share', 1)}>{self.links()}</div>",
            lambda: f"<form{self.attr('form', 0.5)}><label>{w(1, 3)}</label><input name=q>{r.choice(['', '<p>' + w(3, 15) + '</p>', w(1, 8)])}<button>{w(1, 2)}</button></form>",
            lambda: f"<{(t := r.choice(['section', 'div', 'ul', 'ol']))}{self.attr('talk', 1)}>" + (f"<h3>{w(1, 3)}</h3>" if t in ("section", "div") else "") + "".join(r.choice([f"<div{self.attr('talk', 0.7)}><p>{w(3, 60)}</p></div>", f"<p>{w(3, 60)}</p>", f"<article{self.attr('talk', 1)}><p>{w(3, 50)}</p></article>"]) if t in ("section", "div") else f"<li><p>{w(3, 60)}</p></li>" for _ in range(r.randint(1, 5))) + f"</{t}>",
        ]
        outer = [
            lambda: f"<header{self.attr('head', 0.5)}>{r.choice(['<h1>' + w(1, 4) + '</h1>', '<p>' + w(2, 12) + '</p>', '<a href=/>' + w(1, 3) + '</a>', w(1, 9)])}{r.choice(['', '<nav>' + self.links() + '</nav>'])}</header>",
            lambda: f"<div{self.attr('head', 1)}>{r.choice(['<p>' + w(2, 12) + '</p>', w(1, 9), self.links()])}</div>",
            lambda: f"<footer{self.attr('foot', 0.4)}>{r.choice(['&copy; ' + w(2, 60), '<p>' + w(2, 30) + '</p>', self.links()])}</footer>",
            lambda: f"<div{self.attr('foot', 1)}>{r.choice(['&copy; ' + w(2, 25), '<p>' + w(2, 30) + '</p>', self.links()])}</div>",
        ]
        return r.choice(some if inner else some + outer + outer)()

    def block(self) -> str:
        r, w = self.rng, self.words
        k = r.random()
        if k < 0.62:
            s = w(1, r.choice([4, 20, 120]))
            if r.random() < 0.3:
                s = r.choice(["<b>{}</b> {}", "<a href=/x>{}</a> {}", "<span>{}</span> {}", "<b>{}<br>{}"]).format(w(1, 6), s)
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class=lead>{}</p>"]).format(s)
        if k < 0.72:
            return f"<h{(n := r.randint(2, 4))}>{w(1, 8)}</h{n}>"
        if k < 0.82:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{w(1, 25)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if k < 0.88:
            return f"<blockquote><p>{w(3, 50)}</p></blockquote>"
        if k < 0.92:
            return f"<pre><code>{w(3, 30)}</code></pre>"
        if k < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{w(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{w(2, 12)}</figcaption></figure>"

    def name(self) -> str:
        """An attribute that says nothing."""
        r = self.rng
        part = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(1, 7)))
        plain = r.choice([part(), f"{part()}-{part()}", f"{part()}-{r.randint(1, 12)}", f"{part()}__{part()}", r.choice(["blog", "single", "col", "row", "grid", "wrap", "inner", "box", "site", "cell"]) + r.choice(["", "-single", "-2", "-lg", "-wide"])])
        return r.choice(["", "", f' class="{plain}"', f' class="{plain}"', f' id="{plain}"', ' align="center"'])

    def shell(self, body: str) -> str:
        """The container of the main text. In over half of the pages nothing names it."""
        r = self.rng
        k = r.random()
        if k < 0.25:
            return r.choice(["<article{}>{}</article>", "<article{}>{}</article>", "<main{}>{}</main>", "<main><article{}>{}</article></main>"]).format(self.attr("main", 0.3), body)
        if k < 0.42:
            return r.choice(["<div{}>{}</div>", "<section{}>{}</section>", "<div id=page><div{}>{}</div></div>"]).format(self.attr("main", 0.95), body)
        side = r.choice([self.links(), self.junk(), self.words(1, 6)])
        plain = r.choice(["<div{0}>{1}</div>", "<div{0}>{1}</div>", "<div{0}>{1}</div>", "{1}", "{1}", "<section{0}>{1}</section>", "<center>{1}</center>", "<table{0}><tr><td>{2}</td><td>{1}</td></tr></table>", "<table><tr><td{0}>{1}</td></tr></table>", "<div><div{0}>{1}</div></div>", "<div><div><div{0}>{1}</div></div></div>", "<font>{1}</font>"])
        return plain.format(self.name(), body, side)

    def page(self) -> str:
        """The page; main text stands between the marks \x01 and \x02."""
        r = self.rng
        inner = []
        if r.random() < 0.8:
            inner.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(f"\x01{self.words(1, 12)}\x02"))
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 14])):
            block = re.sub(r"(>|^)([^<>]*[^<>\s][^<>]*)(<|$)", "\\1\x01\\2\x02\\3", self.block())
            if r.random() < 0.1:  # a part of the text whose name also means something else
                block += re.sub(r"(>|^)([^<>]*[^<>\s][^<>]*)(<|$)", "\\1\x01\\2\x02\\3", f"<p>{self.words(8, 60)}</p>")
                odd = f"{r.choice(['more', 'top', 'bottom', 'header', 'related', 'widget', 'page', 'share', 'contact', 'rail'])}-{r.choice(['text', 'body', 'content', 'story', 'entry'])}"
                block = r.choice([f'<div class="{odd}">{block}</div>', f"<div{self.name()}>{block}</div>", f"<section{self.name()}>{block}</section>"])
            inner.append(block)
            if r.random() < 0.12:
                inner.append(self.junk(True))
        if r.random() < 0.3:
            inner.append(self.junk(True))
        body = "".join(inner)
        body = self.shell(body)
        parts = [self.junk() for _ in range(r.randint(0, 4))] + [body] + [self.junk() for _ in range(r.randint(0, 4))]
        out = "".join(parts)
        for _ in range(r.randint(0, 2)):
            out = f"<div{r.choice(['', ' class=wrap', ' id=root', self.name()])}>{out}</div>"
        return f"<html><head><title>{self.words(1, 5)}</title><style>p{{x:y}}</style></head><body>{out}</body></html>"


def training_nodes(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: whether an element holds main text."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        marked = _Maker(rng).page()
        page = parse(marked)
        good = [False] * len(page.tag)
        for node, text, _ in page.pieces:
            if "\x01" in text:
                while node >= 0 and not good[node]:
                    good[node] = True
                    node = page.parent[node]
        page.pieces = [(n, t.replace("\x01", "").replace("\x02", ""), f) for n, t, f in page.pieces]
        xs.append(node_features(page))
        ys += good
    return np.concatenate(xs), np.array(ys, float)


def fit_extractor(pages: int = 1500, seed: int = SEED) -> Trees:
    """The trees; always the same for the same arguments."""
    return fit_trees(*training_nodes(pages, seed), trees=60)


def extract(source: str, trees: Trees) -> str:
    page = parse(source)
    return kept_text(page, decode(page, trees.score(node_features(page))))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html)."""
    trees = trees or fit_extractor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            held: list[Page] = []
            feats: list[np.ndarray] = []
            size = 0

            def settle() -> None:
                if held:
                    scores = trees.score(np.concatenate(feats))
                    at = 0
                    for page, f in zip(held, feats, strict=True):
                        texts.append(kept_text(page, decode(page, scores[at : at + len(f)])))
                        at += len(f)
                    held.clear()
                    feats.clear()

            for x in b.column(2):
                source = x.as_py() or ""
                page = parse(source)
                held.append(page)
                feats.append(node_features(page))
                size += len(page.tag)
                if size > 5000:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
