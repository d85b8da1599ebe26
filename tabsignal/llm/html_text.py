"""Main text of web pages: boosted trees over DOM nodes, decoded as a hierarchy.

A tolerant parser builds the tree of block elements (inline markup belongs to
the block around it).  Each block is described by its tag, attribute tokens,
depth, the density of text, links and blocks in its subtree, sibling
statistics, and the same for what it stands in.  Gradient-boosted trees give
the chance that a block holds main text.  The choice is then made for the whole
tree at once: the assignment of greatest likelihood among those in which a
block is kept only if all its ancestors are, so no choice contradicts another.

The trees are trained on pages written from random templates (bounded, fixed
seed), whose labels are known by construction.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import in_slices, pick, text_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page: code, metadata, controls of forms, what stands in for media.
RAW = frozenset("script style noscript template title textarea svg iframe select button canvas audio video head annotation annotation-xml datalist rp".split())
#: Raw elements whose end is sought in the source, since markup inside does not count.
OPAQUE = frozenset("script style title textarea iframe noscript".split())
#: All other elements, unknown ones with them, belong to the line they stand in, as in browsers.
BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: A start tag ends an open element of these, up to the scope given.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_CELLS = frozenset("tr td th tbody thead tfoot caption".split())
GROUPS = ("p", "heading", "list", "li", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "quote", "body")
_GROUP = {f"h{i}": "heading" for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), "list") | dict.fromkeys(("li", "dt", "dd"), "li")
_GROUP |= dict.fromkeys(("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"), "table") | dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), "quote")
_GROUP |= {g: g for g in GROUPS if g not in ("heading", "list", "table", "quote")} | {"html": "body", "fieldset": "form", "center": "div"}
#: Attribute tokens by what they say about a block.
TOKENS = {
    "good": "article content post entry main story body text articlebody page blog news prose hentry document paragraph",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs sitemap skip links toc dropdown",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp commercial affiliate",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reviews feedback guestbook",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast message disclaimer privacy announcement",
    "social": "share sharing social related recommended recommend popular trending tags tag author byline meta more follow newsletter subscribe signup widget",
    "frame": "header footer sidebar side aside masthead copyright colophon legal rail topbar bottom logo branding hero",
    "form": "form login search signin register contact input field poll survey",
}
_TOKEN = {word: k for k, words in enumerate(TOKENS.values()) for word in words.split()}
#: An attribute as browsers read it: quotes count only right after the equals sign, an unquoted value ends at white space or >.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|<", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+|'[^']*+|[^\s>"'][^\s>]*+))?+["']?""")
_TELLING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARK = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "kids", "depth", "tokens", "parts", "own", "links", "controls", "order")

    def __init__(self, tag: str, parent: "Node | None", tokens: tuple[int, ...]):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.depth = parent.depth + 1 if parent else 0
        self.kids: list[Node] = []
        self.parts: list[int] = []  # numbers of the text blocks that are its own
        self.own = self.links = self.controls = self.order = 0


@functools.lru_cache(4096)
def _tokens(attributes: str) -> tuple[int, ...]:
    found = set()
    for name, value in _ATTR.findall(attributes):
        for word in _WORD.findall(value) if name.lower() in _TELLING else ():
            k = _TOKEN.get(word.lower())
            if k is not None:
                found.add(k)
    return tuple(sorted(found))


def parse(source: str) -> tuple[list[Node], list[str]]:
    """Blocks in page order and their texts; a block may have several texts, between its inner blocks."""
    root = Node("html", None, ())
    nodes, texts = [root], []
    stack: list[tuple[str, Node | None]] = [("html", root)]  # inline elements have no node
    blocks = [root]  # the open ones
    opened: Counter = Counter()  # open elements by tag
    run: list[str] = []
    linked = hidden = 0  # open links and open raw elements

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join("".join(run).split())
            run = []
            if text:
                node = blocks[-1]
                node.parts.append(len(texts))
                node.own += len(text)
                texts.append(text)

    def push(tag: str, node: Node | None) -> None:
        nonlocal linked, hidden
        stack.append((tag, node))
        opened[tag] += 1
        linked += tag == "a"
        hidden += tag in RAW
        if node is not None:
            blocks.append(node)

    def pop(to: int) -> None:
        nonlocal linked, hidden
        if any(n is not None for _, n in stack[to:]):
            flush()
        for tag, node in stack[to:]:
            opened[tag] -= 1
            linked -= tag == "a"
            hidden -= tag in RAW
            if node is not None:
                blocks.pop()
        del stack[to:]

    def close(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """End the nearest open element of these, up to the scope."""
        if any(opened[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    return
                if stack[k][0] in tags:
                    return pop(k)

    def end_inline(tag: str, scope: tuple[str, ...]) -> None:
        """Only the element itself ends; blocks opened inside stay open."""
        nonlocal linked
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in scope:
                return
            if stack[k][0] == tag:
                opened[tag] -= 1
                linked -= tag == "a"
                del stack[k]
                return

    def add(text: str) -> None:
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text  # references do not reach over tags
            run.append(text)
            if linked:
                blocks[-1].links += len(text)

    at, size = 0, len(source)
    for m in _MARKUP.finditer(source):
        if m.start() < at:
            continue
        add(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<":
                add("<")
            continue
        tag = name.lower()
        if m[1]:
            if opened[tag]:
                scope = () if tag == "table" else ("table",) if tag in _CELLS else ("td", "th", "caption")
                if tag in BLOCK or tag in RAW:
                    close((tag,), scope)
                else:
                    end_inline(tag, scope)
            elif tag == "br":
                add(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body":
                flush()
                if len(stack) > 1 and stack[1][0] == "head":
                    pop(1)
                root.tokens = tuple(sorted({*root.tokens, *_tokens(m[3])}))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "input":
                blocks[-1].controls += 1
            continue
        if tag in OPAQUE:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*", re.I).search(source, at)
            at = min(size, end.end() + 1) if end else size
            continue
        if tag in RAW:
            if tag in ("button", "select"):
                blocks[-1].controls += 1
            if not m[3].endswith("/"):
                push(tag, None)
            continue
        if tag not in BLOCK:
            if not m[3].endswith("/") or tag == "a":
                push(tag, None)
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if opened["p"]:  # any block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][1] is not None:
                    break
        flush()
        node = Node(tag, blocks[-1], _tokens(m[3]) if m[3] else ())
        node.order = len(nodes)
        blocks[-1].kids.append(node)
        nodes.append(node)
        push(tag, node)
    add(source[at:])
    flush()
    return nodes, texts


def features(nodes: list[Node], texts: list[str]) -> np.ndarray:
    n = len(nodes)
    total, link, blocks, paras, items, marks, controls = (np.zeros(n) for _ in range(7))
    up, family = np.full(n, -1, np.int64), np.ones(n)
    group = np.zeros((n, len(GROUPS)))
    tokens = np.zeros((n, len(TOKENS)))
    copyright_ = np.zeros(n)
    for i, v in enumerate(nodes):
        total[i], link[i], controls[i] = v.own, min(v.links, v.own), v.controls
        for p in v.parts:
            marks[i] += len(_MARK.findall(texts[p]))
            copyright_[i] += "©" in texts[p]
        g = _GROUP.get(v.tag, "div")
        group[i, GROUPS.index(g)] = 1
        paras[i], items[i] = g == "p", g == "li"
        for k in v.tokens:
            tokens[i, k] = 1
        if v.parent is not None:
            up[i] = v.parent.order
    own = total.copy()
    own_link = link.copy()
    for i, v in enumerate(nodes):
        for kid in v.kids:
            family[kid.order] = len(v.kids)
    for i in range(n - 1, 0, -1):
        p = up[i]
        for a in (total, link, paras, items, marks, controls):
            a[p] += a[i]
        blocks[p] += blocks[i] + 1
    previous, following = np.zeros(n), np.zeros(n)
    for v in nodes:
        for a, b in zip(v.kids, v.kids[1:]):
            following[a.order], previous[b.order] = total[b.order], total[a.order]
    inside_tokens, inside_group = tokens.copy(), group.copy()
    for i in range(1, n):
        inside_tokens[i] = np.maximum(inside_tokens[up[i]], tokens[i])
        inside_group[i] = np.maximum(inside_group[up[i]], group[i])
    whole = max(1.0, total[0])
    parent_total = np.where(up >= 0, total[up], whole)
    some = np.maximum(total, 1)
    dense = np.stack(
        [
            np.minimum([v.depth for v in nodes], 20),
            np.log1p(own),
            np.log1p(total),
            link / some,
            own_link / np.maximum(own, 1),
            np.log1p(blocks),
            100 * marks / some,
            np.log1p(paras),
            np.log1p(items),
            np.log1p(family),
            total / np.maximum(parent_total, 1),
            total / whole,
            np.log1p(previous),
            np.log1p(following),
            np.log1p(controls),
            copyright_ > 0,
            total / (1 + blocks),
        ],
        axis=1,
    )
    return np.concatenate([dense, group, tokens, inside_tokens, inside_group[:, 6:13]], axis=1)


class Trees:
    """Gradient-boosted binary trees with logistic loss, grown level by level over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, f = x.shape
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], qs)) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        flat = binned + np.arange(f) * self.bins
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.base)
        self.feature = np.zeros((self.count, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.count, 2**self.depth - 1), np.inf)
        self.leaf = np.zeros((self.count, 2**self.depth))
        for t in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    rows = np.flatnonzero(at == k)
                    if len(rows) < 8:
                        continue
                    index = flat[rows].ravel()
                    gs, hs = (np.bincount(index, np.repeat(a[rows], f), f * self.bins).reshape(f, self.bins).cumsum(1) for a in (g, h))
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    j, b = divmod(int(gain.argmax()), self.bins - 1)
                    if gain[j, b] > 1e-6 and b < len(self.edges[j]):
                        self.feature[t, 2**level - 1 + k], self.cut[t, 2**level - 1 + k] = j, self.edges[j][b]
                node = 2**level - 1 + at
                at = 2 * at + (x[np.arange(n), self.feature[t][node]] > self.cut[t][node])
            self.leaf[t] = self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.ridge)
            score += self.leaf[t][at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.count):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, self.feature[t][node]] > self.cut[t][node])
            out += self.leaf[t][at]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which blocks to keep: the likeliest choice in which a kept block's ancestors are all kept."""
    n = len(nodes)
    weight = np.array([1 + np.log1p(v.own) for v in nodes])
    keep = (-weight * np.logaddexp(0, -odds)).tolist()
    drop = (-weight * np.logaddexp(0, odds)).tolist()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent.order
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = np.zeros(n, bool)
    for i, v in enumerate(nodes):
        out[i] = keep[i] > drop[i] and (v.parent is None or out[v.parent.order])
    return out


def _template_page(r: np.random.Generator) -> str:
    """A random page; texts of main content carry the mark that the labels are read from."""
    words = "alo beri cento dura ema fasto gilo hanu iro jata kelo lumo mari nepo oru pata quin ralo sino tavo".split()
    pick_one = lambda *a: a[r.integers(len(a))]
    chance = lambda p: r.random() < p

    def prose(low: int, high: int, mark: str = "") -> str:
        out = []
        for _ in range(r.integers(low, high + 1)):
            s = " ".join(words[k] for k in r.integers(0, len(words), r.integers(4, 14)))
            out.append(s.capitalize() + pick_one(".", ".", ",", "?", "!"))
        return mark + " ".join(out)

    def few() -> str:
        return " ".join(words[k] for k in r.integers(0, len(words), r.integers(1, 4)))

    def attr(*names: str) -> str:
        name = pick_one(*names)
        return f' {pick_one("class", "class", "id")}="{name}{pick_one("", "", "-box", " col-" + str(r.integers(9)), "_wrap")}"'

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{few()}</a></li>' for _ in range(r.integers(low, high + 1))) + "</ul>"

    def boiler() -> str:
        kind = r.integers(12)
        if kind == 0:
            return f"<nav{attr('nav', 'menu', 'x')}>{links(3, 10)}</nav>" if chance(0.6) else f"<div{attr('nav', 'menu', 'navbar', 'breadcrumbs', 'pagination')}>{links(2, 8)}</div>"
        if kind == 1:
            return f"<div{attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{pick_one(prose(1, 3), '<p>' + prose(1, 3) + '</p>', prose(1, 9))}</div>"
        if kind == 2:
            return f"<aside{pick_one('', attr('sidebar', 'related'))}><h3>{few()}</h3>{pick_one(links(2, 6), '<p>' + prose(1, 5) + '</p>')}</aside>"
        if kind == 3:
            return f"<div{attr('sidebar', 'side', 'related', 'popular', 'widget')}><h3>{few()}</h3>{pick_one(links(2, 6), '<p>' + prose(1, 4) + '</p>')}</div>"
        if kind == 4:
            return f"<div{attr('cookie', 'cookies', 'notice', 'consent', 'alert', 'popup', 'gdpr')}>{pick_one('<p>' + prose(1, 3) + '</p>', prose(1, 3))}{pick_one('', '<button>ok</button>')}</div>"
        if kind == 5:
            return f"<form{pick_one('', attr('search', 'login', 'newsletter'))}><label>{few()}</label><input name=q><p>{prose(1, 2)}</p><button>{few()}</button></form>"
        if kind in (6, 7):
            one = lambda: f"<{pick_one('div', 'li')}{attr('comment', 'reply')}><p>{prose(1, 5)}</p></div>"
            tag = pick_one("div", "section", "ol")
            return f"<{tag}{attr('comments', 'comment-list', 'discussion', 'replies')}><h3>{few()}</h3>{''.join(one() for _ in range(r.integers(1, 6)))}</{tag}>"
        if kind == 8:
            return f"<div{attr('share', 'social', 'tags', 'byline', 'newsletter', 'subscribe')}>{pick_one(links(2, 5), prose(1, 1))}</div>"
        if kind == 9:
            return f"<section{attr('related', 'recommended', 'popular', 'trending')}><h2>{few()}</h2>{links(2, 6)}</section>"
        if kind == 10:
            return f"<div{attr('footer', 'copyright', 'legal', 'disclaimer')}><p>&copy; {few()} {prose(1, 2)}</p></div>"
        return f"<p>{links(2, 5)}</p>"

    def content() -> str:
        out = [f"<h1>@@{few()}</h1>"] if chance(0.8) else []
        for _ in range(pick_one(0, 1, 1, 1, 2, 3, 5, 8, 14, 30, 60)):
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p>{prose(1, 9, '@@')}{pick_one('</p>', '</p>', '')}")
            elif kind < 0.74:
                out.append(f"<p><b>@@{prose(1, 3)}<br>")
            elif kind < 0.81:
                out.append(f"<h{r.integers(2, 4)}>@@{few()}</h2>".replace("</h2>", "") + f"<p>{prose(1, 6, '@@')}</p>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>@@{prose(1, 2)}</li>" for _ in range(r.integers(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote>{pick_one('<p>', '')}{prose(1, 3, '@@')}</blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>@@{few()}</td><td>@@{few()}</td></tr>" for _ in range(r.integers(2, 5))) + "</table>")
            elif kind < 0.95:
                out.append(f"<div>{prose(1, 5, '@@')}</div>")
            elif kind < 0.96:
                out.append(f"<figure><img src=a.png><figcaption>{prose(1, 1, '@@')}</figcaption></figure>")
            elif kind < 0.97:
                out.append(f"<dl><dt>@@{few()}</dt><dd>{prose(1, 2, '@@')}</dd></dl>")
            elif kind < 0.98:
                out.append(f"<section{pick_one('', attr('section', 'body', 'text'))}><h2>@@{few()}</h2>" + "".join(f"<p>{prose(1, 6, '@@')}</p>" for _ in range(r.integers(1, 4))) + "</section>")
            else:
                out.append(boiler())
        return "".join(out)

    inner = content()
    if chance(0.2):
        inner = f"<header{pick_one('', attr('header', 'entry-header', 'post-header', 'article-head'))}><h1{pick_one('', attr('title', 'entry-title', 'headline'))}>@@{few()}</h1></header>" + inner
    if chance(0.12):
        inner += f"<footer{pick_one('', attr('meta', 'post', 'entry', 'tags'))}>{pick_one('<p>' + prose(1, 2) + '</p>', few() + ' <a href=/x>' + few() + '</a>', links(1, 4), prose(1, 2))}</footer>"
    shape = r.integers(6)
    if shape <= 2:
        inner = f"<article{pick_one('', attr('post', 'hentry', 'story'))}>{inner}</article>"
    elif shape == 3:
        inner = f"<main>{inner}</main>"
    elif shape == 4:
        inner = f"<div{attr('content', 'article', 'post', 'entry', 'story', 'main')}>{inner}</div>"
    else:
        inner = f"<div{attr('a', 'b', 'wrapper')}>{inner}</div>"
    if chance(0.4):
        inner = f"<div{attr('page', 'wrapper', 'container', 'main')}>{''.join(boiler() for _ in range(r.integers(0, 2)))}{inner}{''.join(boiler() for _ in range(r.integers(0, 3)))}</div>"
    top = "".join(boiler() for _ in range(r.integers(0, 4)))
    if chance(0.4):
        top = f"<header{pick_one('', attr('header', 'masthead', 'top'))}>{pick_one('<h1>' + few() + '</h1>', few(), '')}{links(1, 5)}</header>" + top
    bottom = "".join(boiler() for _ in range(r.integers(0, 4)))
    if chance(0.6):
        bottom += f"<footer>{pick_one('<p>', '', '')}&copy; {few()} {prose(0, pick_one(2, 2, 9))}{pick_one('', links(1, 4))}</footer>"
    body = top + inner + bottom
    if chance(0.08):  # pages of some servers are one form
        body = f'<form{pick_one("", attr("form", "main", "page"))} action="/">{"<input type=hidden name=s>" * int(r.integers(0, 4))}{body}</form>'
    return f"<html><head><title>{few()}</title></head><body>{body}{pick_one('</body></html>', '')}"


@functools.lru_cache(1)
def trained(pages: int = 600, seed: int = 7) -> Trees:
    """Trees trained on ``pages`` random pages."""
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, texts = parse(_template_page(r))
        good = np.zeros(len(nodes), bool)
        for i in range(len(nodes) - 1, -1, -1):
            v = nodes[i]
            good[i] |= any("@@" in texts[p] for p in v.parts)
            if v.parent is not None:
                good[v.parent.order] |= good[i]
        for v in nodes:
            v.own -= 2 * sum("@@" in texts[p] for p in v.parts)
        xs.append(features(nodes, [t.replace("@@", "") for t in texts]))
        ys.append(good)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """Main text of each page."""
    parsed = [parse(s) for s in sources]
    if not parsed:
        return []
    odds = trees.score(np.concatenate([features(n, t) for n, t in parsed]))
    out, at = [], 0
    for nodes, texts in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(texts[p] for p in sorted(p for v in nodes if kept[v.order] for p in v.parts)))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars: the main text of every page.

    Blocks are joined by new lines in page order, white space inside a block is
    one space.  Null and empty pages, and pages without main text, give the
    empty text.  Every row gets a row.  Tags, attributes and character
    references are read by the rules of browsers; paragraphs, list items and
    cells end where theirs do, an inline end tag ends that element alone, and a
    block's end tag ends all that is open inside it.  Text that browsers do not
    show (controls of forms, media fallbacks, annotations) is not extracted.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    text_batches(spark)
    source = pick(pages, id_col, url_col, html_col)
    held = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in in_slices(batches, 2, 1_000_000):
            texts = main_texts([s or "" for s in batch.column(2).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return source.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
