"""Main text of web pages by a graphical model on the DOM tree.

Nodes are the block elements of a page and its text runs (what stands between two
block borders; inline tags are part of their run).  Each node is content or not.  A
log-linear potential of its features (tag, words of class, id and role, length,
links) pulls a node, and a table for each kind of edge couples parent and child.
Sum-product messages up and then down the tree give every run's marginal;
the runs of at least one half are the text, in page order.

The weights maximise the likelihood of labelled pages, with the gradient from the same
messages.  Labelled pages are of two kinds: pages that ``labelled_layouts`` makes in
many layouts, and, if given, pages of the corpus that mark their article
themselves (a bounded sample of ``max_train``), once as they are and once with their
telling tags turned into plain ones, so that the model learns from lengths and links too.

A page is parsed in one pass with an explicit stack; unclosed ``p``, ``li``, cells and rows
are closed as browsers do.  Text of scripts, styles and form controls is no run; a form control
or other hidden element without its end tag hides no more than the text up to the next block tag.

Defined cases: a null or empty html gives an empty text; a page without content runs
gives an empty text; broken markup is read as far as it goes; repeated rows
give repeated results.  Nothing is cut: a text may be as long as its page.
"""

from __future__ import annotations

import html as entities
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Tags by group; the place in the list is the feature.
TAGS = [
    ["html", "body"], ["div", "center", "hgroup"], ["article"], ["main"], ["section"], ["nav", "menu"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "search"],
    ["ul", "ol", "dir"], ["li"], ["p"], ["h1"], ["h2"], ["h3", "h4", "h5", "h6"], ["table", "thead", "tbody", "tfoot", "tr", "caption"], ["td", "th"], ["figure", "figcaption"],
    ["blockquote", "pre"], ["dl", "dt", "dd"], ["address"], ["dialog"], ["details", "summary", "hr", "legend"],
]
GROUP = {t: i for i, ts in enumerate(TAGS) for t in ts}
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "xmp"}  # hold no tags but their own end
#: Their text is no run.  They close at their end tag or with their parent; without an end tag, at the next block tag.
HIDDEN = {"noscript", "template", "svg", "select", "button", "object", "canvas", "option", "datalist", "audio", "video"}
FLAT = {"select", "button", "option", "datalist"}  # closed by an opening tag of the same name
MARKUP = re.compile(rf"<!--(?:.*?-->|.*)|<({'|'.join(sorted(RAW - {'title'}))})\b[^>]*+>(?:.*?</\1\b|.*)|<(/?)({'|'.join(sorted(HIDDEN))})\b([^>]*+)>", re.S | re.I)
#: Words of class, id and role by group.
WORDS = [
    ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc"],
    ["header", "masthead", "topbar", "branding", "logo", "site", "top", "contentinfo"],
    ["footer", "foot", "copyright", "colophon", "legal", "bottom", "credits"],
    ["sidebar", "aside", "widget", "widgets", "rail", "complementary", "side"],
    ["related", "recommended", "recommendations", "more", "trending", "popular", "teaser", "links", "archive", "latest"],
    ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "dfp"],
    ["cookie", "cookies", "consent", "notice", "notices", "notification", "alert", "gdpr", "popup", "modal", "overlay", "warning", "privacy", "disclaimer", "announcement", "paywall"],
    ["comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "reader", "readers", "feedback", "thread", "review", "reviews"],
    ["share", "sharing", "social", "follow", "like", "print"],
    ["form", "login", "signup", "signin", "register", "subscribe", "subscription", "newsletter", "search", "contact", "poll", "survey"],
    ["content", "article", "post", "entry", "story", "text", "body", "main", "page", "prose", "column", "hentry", "blog", "document", "read"],
]
WORD_GROUP = {w: i for i, ws in enumerate(WORDS) for w in ws}
N_TAGS, N_WORDS = len(TAGS), len(WORDS)
LEAF = N_TAGS + N_WORDS  # features from here on belong to runs
ABOVE = LEAF + 11  # and from here on tell what stands above a node
N_FEATURES = ABOVE + N_TAGS + N_WORDS
CLOSES = {  # an opening tag closes an open one of these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_END: dict[str, re.Pattern] = {}


def closed(source: str) -> set[int]:
    """Where the hidden elements begin that have an end tag."""
    begun: dict[str, list[int]] = {n: [] for n in HIDDEN}
    found = set()
    for m in MARKUP.finditer(source):
        if m[3]:
            here = begun[m[3].lower()]
            if m[2]:
                if here:
                    found.add(here.pop())
            elif not m[4].endswith("/"):
                if m[3].lower() in FLAT:
                    here.clear()
                here.append(m.start())
    return found


class Page:
    """Nodes of one page in page order: parent, tag group and word groups of
    elements; text, words and link characters of runs."""

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.words, self.runs = [-1], [0], [0], [()], {}
        stack, parts, linked, in_link = [(0, "html")], [], 0, False
        hidden, loose, ended = 0, False, None  # place in the stack of the outermost hidden element; it has no end tag
        at, n = 0, len(source)
        parent, depth, tags, words, runs = self.parent, self.depth, self.tag, self.words, self.runs

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    node = len(parent)
                    parent.append(stack[-1][0])
                    depth.append(depth[stack[-1][0]] + 1)
                    tags.append(-1)
                    words.append(())
                    runs[node] = text, min(linked, len(text))
                parts.clear()
                linked = 0

        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                stop = n
            else:
                stop = m.start()
            if stop > at and not hidden:
                text = source[at:stop]
                if "&" in text:
                    text = entities.unescape(text)
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            if m is None:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name in RAW:
                if not closing and not rest.endswith("/") and not (hidden and name == "title" and any(t == "svg" for _, t in stack[hidden:])):
                    end = _END.get(name) or _END.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I))
                    e = end.search(source, at)
                    at = e.end() if e else n
                if not hidden:
                    parts.append(" " if name == "textarea" else "")
            elif name in HIDDEN:
                if hidden and loose and (not closing or stack[hidden][1] == name):
                    del stack[hidden:]
                    hidden = 0
                    if closing:
                        continue
                if not hidden:
                    parts.append(" " if name in ("select", "button") else "")
                if closing and hidden:
                    for k in range(len(stack) - 1, hidden - 1, -1):
                        if stack[k][1] == name:
                            del stack[k:]
                            break
                    if len(stack) <= hidden:
                        hidden = 0
                elif not closing and not rest.endswith("/"):
                    if ended is None:
                        ended = closed(source)
                    if not hidden:
                        hidden, loose = len(stack), m.start() not in ended
                        stack.append((stack[-1][0], name))
                    elif m.start() in ended:
                        stack.append((stack[-1][0], name))
            elif hidden and name not in GROUP:
                pass
            elif name == "a":
                in_link = not closing
            elif name == "br":
                parts.append(" ")
            elif name in GROUP:
                if hidden:
                    if loose:
                        del stack[hidden:]
                        hidden = 0
                    elif name in ("html", "body", "hr"):
                        continue
                    elif not closing:
                        stack.append((stack[-1][0], name))
                        continue
                    else:
                        k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == name), 0)
                        if not k:
                            continue
                        if k > hidden:
                            del stack[k:]
                            continue
                        hidden = 0  # its parent ends
                flush()
                if name in ("html", "body") or name == "hr":
                    if name == "body" and not closing and rest:
                        words[0] = self._word_groups(rest)
                    continue
                if closing:
                    in_link = False
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][1] == name:
                            del stack[k:]
                            break
                    continue
                if stack[-1][1] == "p":
                    stack.pop()
                if name in CLOSES:
                    own, within = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][1] in own:
                            del stack[k:]
                            break
                        if stack[k][1] in within:
                            break
                node = len(parent)
                parent.append(stack[-1][0])
                depth.append(depth[stack[-1][0]] + 1)
                tags.append(GROUP[name])
                words.append(self._word_groups(rest) if rest else ())
                stack.append((node, name))
        flush()

    @staticmethod
    def _word_groups(rest: str) -> tuple[int, ...]:
        found = set()
        for m in ATTRIBUTE.finditer(rest):
            for w in WORD.findall(m[2] or m[3] or m[4] or ""):
                if (g := WORD_GROUP.get(w.lower())) is not None:
                    found.add(g)
        return tuple(found)


class Forest:
    """Pages as arrays, and messages over all of them at once, level by level."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        base = np.concatenate([[0], np.cumsum(sizes)])
        self.base, n = base, int(base[-1])
        self.parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base)])
        self.parent[base[:-1]] = -1
        depth = np.concatenate([np.array(p.depth) for p in pages])
        tag = np.concatenate([np.array(p.tag) for p in pages])
        self.leaf = tag < 0
        x = np.zeros((n, N_FEATURES))
        e = np.flatnonzero(~self.leaf)
        x[e, tag[e]] = 1
        for p, b in zip(pages, base):
            for i, gs in enumerate(p.words):
                for g in gs:
                    x[b + i, N_TAGS + g] = 1
        at = [b + i for p, b in zip(pages, base) for i in p.runs]
        runs = [r for p in pages for r in p.runs.values()]
        self.texts = dict(zip(at, (t for t, _ in runs)))
        if at:
            size = np.array([len(t) for t, _ in runs], float)
            count = np.array([t.count(" ") + 1 for t, _ in runs], float)
            link = np.array([k for _, k in runs], float) / size
            f = np.column_stack([
                np.ones(len(at)), np.log(count) / 3, link, link > 0.6, count < 4, count >= 15, count >= 40, [t[-1] in ".!?:;\"')»”" for t, _ in runs], ["©" in t for t, _ in runs], [t.count(",") for t, _ in runs] / count, (count >= 15) & (link < 0.3),
            ])
            x[np.array(at), LEAF:ABOVE] = f
        self.x, self.depth = x, depth
        self.kind = self.leaf.astype(int)  # of the edge to the parent
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        for level in self.levels[1:]:
            p = self.parent[level]
            x[level, ABOVE:] = np.maximum(x[p, ABOVE:], x[p, :LEAF])

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent, node) of each node with a parent.
        ``edge[kind, parent, child]``: log potentials."""
        own = np.zeros((len(self.parent), 2))
        own[:, 1] = self.x @ weights
        up, sent, down = own.copy(), np.zeros_like(own), np.zeros_like(own)
        for level in reversed(self.levels[1:]):
            s = np.logaddexp(edge[self.kind[level], :, 0] + up[level, :1], edge[self.kind[level], :, 1] + up[level, 1:])
            s -= s.max(1, keepdims=True)
            sent[level] = s
            np.add.at(up, self.parent[level], s)
        both = np.zeros((len(self.parent), 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - sent[level]  # of the parent, without this node
            joint = rest[:, :, None] + edge[self.kind[level]]
            d = np.logaddexp(joint[:, 0], joint[:, 1])
            down[level] = d - d.max(1, keepdims=True)
            joint = joint + up[level][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            both[level] = joint / joint.sum((1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), both


class Model:
    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        if not pages:
            return []
        forest = Forest(pages)
        p, _ = forest.marginals(self.weights, self.edge)
        out = []
        for page, base in zip(pages, forest.base):
            out.append("\n".join([t for i, (t, _) in page.runs.items() if p[base + i] >= 0.5]))
        return out


MARK = "\ue000"  # begins each run of content in a labelled page; private use


def fit(sources: list[str], steps: int = 250, rate: float = 0.1, decay: float = 0.02) -> Model:
    """Maximum likelihood on pages whose content runs begin with ``MARK``."""
    pages = [Page(s) for s in sources]
    truth = []
    for p in pages:
        size, good = np.zeros(len(p.parent)), np.zeros(len(p.parent))
        for i, (t, k) in list(p.runs.items()):
            size[i], good[i] = len(t), len(t) * t.startswith(MARK)
            p.runs[i] = (t.replace(MARK, "").strip() or "-", k)
        for i in range(len(p.parent) - 1, 0, -1):
            size[p.parent[i]] += size[i]
            good[p.parent[i]] += good[i]
        truth.append((good * 2 > size).astype(int))
    forest, y = Forest(pages), np.concatenate(truth)
    has = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[has], y[forest.parent[has]], y[has]), 1)
    theta = np.zeros(N_FEATURES + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, both = forest.marginals(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))
        expected = np.stack([both[has[forest.kind[has] == k]].sum(0) for k in (0, 1)])
        g = np.concatenate([forest.x.T @ (y - p), (seen - expected).reshape(-1)]) / len(pages) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))


def labelled_layouts(n: int = 400, seed: int = 3) -> list[str]:
    """Made pages in many layouts; content runs begin with ``MARK``."""
    r = random.Random(seed)
    pick, chance = r.choice, lambda p: r.random() < p

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def attr(*names: str) -> str:
        name = pick(names)
        return f' {pick(["class", "class", "id"])}="{name}"' if name else ""

    def links(low: int, high: int, item: str) -> str:
        return "".join(f"<{item}><a href='/x'>{words(1, 4)}</a></{item}>" if item else f"<a href='/x'>{words(1, 3)}</a> " for _ in range(r.randint(low, high)))

    def plain(tag: str, names: list[str], inner: str) -> str:
        """An element known by its tag or, as a plain one, by its name."""
        if tag and chance(0.5):
            return f"<{tag}{attr(*names) if chance(0.5) else ''}>{inner}</{tag}>"
        kind = pick(["div", "div", "section"])
        return f"<{kind}{attr(*names)}>{inner}</{kind}>"

    def block(low: int, high: int) -> str:
        return pick([f"<p>{sentence(low, high)}</p>", f"<p>{sentence(low, high)} <a href='/y'>{words(1, 3)}</a> {sentence(low, high)}</p>", sentence(low, high), f"<span>{sentence(low, high)}</span>"])

    def menu() -> str:
        return plain("nav", ["nav", "menu", "navbar", "breadcrumbs", "main-menu", "pagination"], pick([f"<ul>{links(2, 9, 'li')}</ul>", links(2, 7, ""), f"<ul{attr('menu', '')}>{links(3, 8, 'li')}</ul>"]))

    def advert() -> str:
        return plain("", ["ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement"], block(2, 30))

    def notice() -> str:
        return plain(pick(["", "dialog"]), ["cookie-notice", "notice", "alert", "cookie-consent", "gdpr", "popup", "announcement"], block(4, 35) + pick(["", "<button>Ok</button>"]))

    def sidebar() -> str:
        return plain("aside", ["sidebar", "widget", "related", "side-bar"], f"<h3>{words(1, 4)}</h3>" + pick([f"<ul>{links(2, 7, 'li')}</ul>", block(5, 35), block(3, 12) + block(3, 30)]))

    def form() -> str:
        return f"<form{attr('', 'search', 'newsletter', 'login', 'contact-form')}>{pick(['', f'<h3>{words(1, 4)}</h3>', block(3, 20)])}<label>{words(1, 4)}</label><input name='q'><button>{words(1, 2)}</button>{pick(['', f'<p>{sentence(4, 20)}</p>'])}</form>"

    def comments() -> str:
        one = lambda: pick([f"<div{attr('comment', 'comment-body', 'reply')}><p>{sentence(3, 45)}</p></div>", f"<li{attr('comment', '')}><p>{sentence(3, 45)}</p></li>", f"<article{attr('comment')}><p>{words(1, 2)}</p><p>{sentence(4, 40)}</p></article>", f"<p>{sentence(3, 40)}</p>"])
        inner = pick(["", f"<h3>{words(1, 2)}</h3>", f"<h2>{words(1, 3)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{(k := pick(['section', 'div', 'ol', 'ul', 'aside']))}{attr('comments', 'comment-list', 'reader-comments', 'discussion', 'replies')}>{inner}</{k}>"

    def share() -> str:
        return plain("", ["share", "social", "sharing-buttons"], links(2, 5, "") if chance(0.5) else f"<ul>{links(2, 5, 'li')}</ul>")

    def top() -> str:
        return plain("header", ["header", "site-header", "masthead", "topbar"], pick([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", words(1, 6), f"<a href='/'>{words(1, 3)}</a>"]) + pick(["", menu(), f"<p>{sentence(3, 12)}</p>"]))

    def bottom() -> str:
        return plain("footer", ["footer", "site-footer", "bottom", "copyright"], pick([f"© {words(1, 4)} · {sentence(2, 12)}", f"<p>© {words(2, 8)}</p>", f"<p>{sentence(4, 25)}</p>{links(2, 5, '')}", f"<ul>{links(2, 6, 'li')}</ul><p>{sentence(3, 15)}</p>"]))

    def content() -> str:
        say = lambda low, high: MARK + sentence(low, high)
        some = [
            lambda: f"<p>{say(5, 90)}</p>", lambda: f"<p>{say(5, 90)}</p>", lambda: f"<p>{say(8, 60)}", lambda: f"<p>{say(1, 6)}</p>", lambda: f"<p><b>{say(2, 30)}<br>",
            lambda: f"<p>{say(4, 40)} <a href='/z'>{words(1, 4)}</a> {sentence(2, 30)}</p>", lambda: f"<h2>{say(1, 8)}</h2>", lambda: f"<h3>{say(1, 8)}</h3>", lambda: f"<blockquote>{say(5, 40)}</blockquote>",
            lambda: "<ul>" + "".join(f"<li>{say(1, 18)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", lambda: f"<div>{say(5, 60)}</div>", lambda: f"<pre>{say(3, 20)}</pre>", lambda: f"<figure><img src='i'><figcaption>{say(2, 14)}</figcaption></figure>",
            lambda: "<table>" + "".join(f"<tr><td>{say(1, 5)}<td>{say(1, 5)}" for _ in range(r.randint(2, 4))) + "</table>",
        ]
        inner = pick([f"<h1>{say(2, 14)}</h1>", f"<h1>{say(2, 40)}</h1>", f"<header><h1>{say(2, 14)}</h1></header>", ""])
        for _ in range(pick([1, 1, 2, 3, 5, 8, 12])):
            inner += pick(some)()
            if chance(0.06):
                inner += pick([advert, share, sidebar, form])()
        if chance(0.2):
            inner += pick([share, comments, sidebar, form, menu])()
        tag, names = pick([("article", [""]), ("article", ["", "post", "story"]), ("article", [""]), ("main", [""]), ("div", ["content", "post-body", "entry-content", "article-text", "story", "main"]), ("section", ["content", "article", "text"]), ("div", [""])])
        return f"<{tag}{attr(*names)}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        before = [x() for x in (top, menu, notice, advert, sidebar) if chance(0.4)]
        after = [x() for x in (comments, sidebar, form, share, advert, notice, menu) if chance(0.3)]
        middle = content()
        for _ in range(r.randint(0, 3)):
            if chance(0.5):
                middle += pick([comments, sidebar, advert, share, form])()
            middle = f"<div{attr('', 'wrap', 'container', 'row', 'col', 'page', 'inner', 'layout')}>{middle}</div>"
        end = [bottom()] if chance(0.8) else []
        out.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join([*before, middle, *after, *end]) + "</body></html>")
    return out


_TELLING = re.compile(r"<(/?)(article|nav|header|footer|aside|main|section)\b[^>]*>", re.I)


def own_labels(source: str) -> str | None:
    """A page that marks one article, with ``MARK`` on the article's runs; else null."""
    found = [*re.finditer(r"<article\b[^>]*>(.*?)</article>", source, re.S | re.I)]
    if len(found) != 1 or re.search(r"<(nav|aside|form|footer)\b|comment", found[0][1], re.I):
        return None
    a, b = found[0].span(1)
    marked = re.sub(r">(\s*)([^<>\s])", rf">\1{MARK}\2", ">" + source[a:b])[1:]
    marked = re.sub(rf"(<(?:a|b|i|em|strong|span|u)\b[^>]*>\s*){MARK}", rf"{MARK}\1", marked)
    marked = re.sub(rf"(</(?:a|b|i|em|strong|span|u)>\s*|<br\s*/?>\s*){MARK}", r"\1", marked)
    return source[:a] + marked + source[b:]


def train(pages: DataFrame | None = None, page_id: str = "page_id", html: str = "html", max_train: int = 150, layouts: int = 500) -> Model:
    """``max_train`` pages of the corpus, of the smallest hashes of their ids, and made layouts."""
    sources = labelled_layouts(layouts)
    if pages is not None:
        some = pages.where(F.col(html).isNotNull() & F.lower(html).contains("<article") & (F.length(html) < 20_000))
        # Ids first, so that pages are brought for the sample alone, one for each id.
        ids = some.select(page_id).distinct().orderBy(F.xxhash64(page_id), page_id).limit(max_train)
        rows = some.join(F.broadcast(ids), page_id).groupBy(page_id).agg(F.min(html).alias("html")).collect()
        for row in sorted(rows, key=lambda r: str(r[0])):
            if (marked := own_labels(row["html"])) is not None:
                sources += [marked, _TELLING.sub(r"<\1div>", marked)]
    return fit(sources)


def extract(df: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", batch: int = 200) -> DataFrame:
    """``keep``, ``text`` and ``n_chars``."""
    src = df.select(*keep, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = model.texts(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
