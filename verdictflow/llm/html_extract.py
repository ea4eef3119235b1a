"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is read into a small DOM: block elements with their attributes, and the text blocks they own.
Every block element gets features of its subtree (text, link and punctuation density, counts), its
tag and attribute tokens, its depth, place and siblings, and those of its ancestors. Gradient-boosted
trees turn them into a log-odds of being article content. Decoding picks, for every node, one of
*before*, *inside* or *left out*, which may only move in this order from the root down: an excluded
box inside an article stays excluded with all it holds, and a page region is entered once per path.
The best assignment is found exactly, bottom up.

The trees are trained on a bounded sample (``sample`` pages, those with the smallest hash): on pages that mark their article, and on layouts generated around the sampled sentences that
also hold side bars, notices, adverts, forms and comments, with semantic tags or with bare ``div``
and class names. All pages are extracted, whole.

Defined results: null or empty html, and pages without content, give an empty text; null ids and
urls pass through; repeated rows are extracted independently and all stay; an empty table gives an
empty result; only the named columns are read, so other columns may have any name; unclosed tags,
quotes and comments are read as browsers read them in the common cases and never raise.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("script", "style", "textarea", "title")
OPENING = r"""<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|{OPENING}", re.I | re.S)
OPENING = re.compile(OPENING, re.I | re.S)
#: Elements left out with all they hold; without a closing tag they end with their parent.
FOREIGN = ("svg", "math")
OUT = frozenset((*FOREIGN, "noscript", "template", "iframe", "select", "object"))
NEXT_OF = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in OUT}
#: Holds HTML inside foreign elements; elsewhere in them a block element ends the foreign one.
HTML_IN_FOREIGN = frozenset(("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"))
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section "
                  "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these kinds, up to the nearest of the second kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
KINDS = {"nav": 0, "menu": 0, "header": 1, "hgroup": 1, "footer": 2, "aside": 3, "article": 4, "main": 4, "form": 5,
         "fieldset": 5, "search": 5, "p": 6, "blockquote": 6, "pre": 6, "ul": 7, "ol": 7, "dl": 7, "dir": 7, "li": 8,
         "dt": 8, "dd": 8, "table": 9, "tbody": 9, "thead": 9, "tfoot": 9, "tr": 9, "td": 9, "th": 9, "section": 10,
         "div": 10, "center": 10, "body": 11, "html": 11, "dialog": 12, "details": 12, "figure": 13, "figcaption": 13}
HEADING, OTHER, N_KINDS = 14, 15, 16


class Dom:
    """Block elements of a page in document order, and the text blocks they own."""

    def __init__(self, html: str):
        self.tag, self.words, self.parent, self.depth = ["html"], [()], [-1], [0]
        self.blocks: list[tuple[int, str]] = []  # owner, text
        self.links: list[int] = []  # characters of links, by text block
        open_, run, linked, in_link, at = [0], [], 0, False, 0
        out: list[str] = []  # the element that is being left out, and the open ones in it
        closed, inline = True, Counter()  # whether that one has a closing tag; open elements that are no blocks

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    self.blocks.append((open_[-1], text))
                    self.links.append(min(linked, len(text)))
                run, linked = [], 0

        while m := TOKEN.search(html, at):
            if m.start() > at and not out:
                run.append(html[at:m.start()])
                if in_link:
                    linked += m.start() - at
            at = m.end()
            if m[1] and out and out[0] in FOREIGN and (m0 := OPENING.match(html, m.start()))[0].endswith("/>"):
                at = m0.end()
            if m[3] is None:
                continue
            tag, ends = m[3].lower(), bool(m[2])
            if out:
                foreign, host = out[0] in FOREIGN, self.tag[open_[-1]]
                if ends and tag in out:
                    del out[len(out) - 1 - out[::-1].index(tag):]
                    continue
                if ends:
                    over = inline[tag] > 0 or tag == "head" or tag in BLOCK and tag in [self.tag[i] for i in open_[1:]]
                else:
                    over = tag == "body" or tag in BLOCK and (
                        foreign and HTML_IN_FOREIGN.isdisjoint(out)
                        or not closed and (host == "p" or host in CLOSES.get(tag, ())) and BLOCK.isdisjoint(out))
                if not over:
                    if not ends and tag not in VOID and not (foreign and m[4].endswith("/>")):
                        out.append(tag)
                    continue
                out = []
            if tag in OUT:
                if not ends and not (tag in FOREIGN and m[4].endswith("/>")):
                    out = [tag]
                    closed = (found := NEXT_OF[tag].search(html, at)) is not None and bool(found[1])
                continue
            if tag not in BLOCK and tag not in VOID:
                inline[tag] += -1 if ends and inline[tag] else not ends
            if tag == "a":
                in_link = not ends
                continue
            if tag not in BLOCK:
                if tag == "br" or tag == "option" or tag == "button":
                    run.append(" ")
                continue
            flush()
            in_link = False
            if ends:
                if tag in (names := [self.tag[i] for i in open_[1:]]):
                    del open_[1 + len(names) - 1 - names[::-1].index(tag):]
                continue
            if tag in ("html", "body") and tag in [self.tag[i] for i in open_[:2]]:
                continue
            if self.tag[open_[-1]] == "p":
                open_.pop()
            if tag in CLOSES:
                for k in range(len(open_) - 1, 0, -1):
                    name = self.tag[open_[k]]
                    if name in SCOPE.get(tag, ("table",)):
                        break
                    if name in CLOSES[tag]:
                        del open_[k:]
                        break
            if tag == "hr":
                continue
            self.tag.append(tag)
            self.words.append(tuple({w for g in ATTRIBUTE.findall(m[4]) for w in
                                     re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(g)).lower())})
                              if "=" in m[4] else ())
            self.parent.append(open_[-1])
            self.depth.append(len(open_))
            open_.append(len(self.tag) - 1)
        if at < len(html) and not out:
            run.append(html[at:])
        flush()


N_BASE = 25  # features beside the tag kinds


def features(pages: list[Dom], weight: dict[str, float], plain: bool = False) -> np.ndarray:
    """One row per node. ``plain`` hides tags and attributes, to train on structure alone."""
    sizes = np.array([len(d.tag) for d in pages])
    n, first = int(sizes.sum()), np.r_[0, np.cumsum(sizes)[:-1]]
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.array([p if p >= 0 else -1 for d in pages for p in d.parent])
    root = parent < 0
    parent = np.where(root, np.arange(n), parent + first[page])
    depth = np.array([x for d in pages for x in d.depth], float)
    own = np.zeros((n, 5))  # characters, words, link characters, sentence marks, text blocks
    before = np.zeros(n)
    for d, f in zip(pages, first.tolist(), strict=True):
        seen = 0
        for (i, text), link in zip(d.blocks, d.links, strict=True):
            k = f + i
            if not own[k, 4]:
                before[k] = seen
            seen += len(text)
            own[k] += (len(text), text.count(" ") + 1, link,
                       text.count(".") + text.count(",") + text.count("!") + text.count("?"), 1)
    kind = np.array([KINDS.get(t, HEADING if t[0] == "h" and len(t) == 2 else OTHER) for d in pages for t in d.tag])
    paragraph = (kind == 6) * 1.0
    tree = np.column_stack([own, np.ones(n), paragraph])
    order = np.argsort(-depth, kind="stable")  # children before parents
    cut = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cut):
        inner = level[~root[level]]
        np.add.at(tree, parent[inner], tree[inner])
    chars, words, links, marks, blocks, nodes, paras = tree.T
    total = chars[first][page] + 1
    siblings = np.bincount(parent[~root], minlength=n)[parent]
    group = parent * 32 + kind
    _, which, alike = np.unique(group, return_inverse=True, return_counts=True)
    place = np.zeros(n)
    by = np.lexsort((np.arange(n), parent))
    start = np.r_[True, parent[by][1:] != parent[by][:-1]]
    place[by] = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    low, high = np.zeros(n), np.zeros(n)
    if not plain:
        w = [[weight[x] for x in t if x in weight] for d in pages for t in d.words]
        low = np.array([min(x, default=0.0) for x in w])
        high = np.array([max(x, default=0.0) for x in w])
    kinds = np.zeros((n, N_KINDS))
    if not plain:
        kinds[np.arange(n), kind] = 1
    above = np.zeros((n, N_KINDS))
    low_above, high_above = np.minimum(low, 0), np.maximum(high, 0)
    for level in np.split(order, cut)[::-1]:
        p = parent[level]
        above[level] = np.maximum(above[p], kinds[p])
        low_above[level] = np.minimum(low_above[level], low_above[p])
        high_above[level] = np.maximum(high_above[level], high_above[p])
    par = parent
    base = np.column_stack([
        np.log1p(chars), np.log1p(words), links / (chars + 1), marks / (words + 1), chars / (nodes + 1),
        chars / (blocks + 1), words / (blocks + 1), np.log1p(nodes), np.log1p(paras), paras / nodes,
        np.log1p(own[:, 0]), own[:, 2] / (own[:, 0] + 1), own[:, 3] / (own[:, 1] + 1), depth, siblings,
        alike[which] / np.maximum(siblings, 1), place / np.maximum(siblings, 1), chars / total,
        chars[par] / total, links[par] / (chars[par] + 1), chars[par] / (nodes[par] + 1), low, high, low_above,
        high_above])
    # tag kinds of the node and of its ancestors share the remaining columns
    return np.column_stack([base, kinds, above])


class Trees:
    """Gradient boosting with logistic loss over quantile bins."""

    def __init__(self, count: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 24, l2: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.l2 = count, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        n, m, b = *x.shape, self.bins + 1
        mean = np.average(y, weights=weight)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        flat = binned + np.arange(m) * b
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            feature, cut = np.zeros(2 ** self.depth, int), np.full(2 ** self.depth, np.inf)
            node = np.ones(n, int)
            for level in range(self.depth):
                for k in range(2 ** level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2:
                        continue
                    at = flat[rows].ravel()
                    g = np.bincount(at, np.repeat(grad[rows], m), m * b).reshape(m, b).cumsum(1)
                    h = np.bincount(at, np.repeat(hess[rows], m), m * b).reshape(m, b).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g ** 2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt ** 2 / (ht + self.l2)
                    gain[(h < 1e-3) | (ht - h < 1e-3)] = 0
                    f, c = divmod(int(gain.argmax()), b)
                    if gain[f, c] > 1e-6 and c < len(edges[f]):
                        feature[k], cut[k] = f, edges[f][c]
                node = 2 * node + (x[np.arange(n), feature[node]] > cut[node])
            g = np.bincount(node, grad, 2 ** (self.depth + 1))
            h = np.bincount(node, hess, 2 ** (self.depth + 1))
            leaf = self.rate * g / (h + self.l2)
            score += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


SWITCH = 1.0  # what entering or leaving a region costs


def decode(dom: Dom, score: np.ndarray) -> list[str]:
    """The text blocks inside the best regions."""
    n = len(dom.tag)
    own = [0] * n
    for i, text in dom.blocks:
        own[i] += len(text)
    gain = (score * (0.5 + np.log1p(own))).tolist()
    # best sums of a subtree whose root is before, inside or left out
    best = [[0.0, g, 0.0] for g in gain]
    for i in range(n - 1, 0, -1):
        p, (before, inside, out) = best[dom.parent[i]], best[i]
        p[0] += max(before, inside - SWITCH)
        p[1] += max(inside, out - SWITCH)
        p[2] += out
    state = [0] * n
    state[0] = int(best[0][1] - SWITCH > best[0][0])
    for i in range(1, n):
        up, (before, inside, out) = state[dom.parent[i]], best[i]
        state[i] = up if up == 2 else int(inside - SWITCH > before) if up == 0 else 1 + int(out - SWITCH > inside)
    return [text for i, text in dom.blocks if state[i] == 1]


# What sites call their parts: training layouts use these names; the trees learn from them.
PARTS = {
    "menu": ("nav", "nav navbar menu main-menu top-nav site-nav breadcrumb navigation topbar links pagination pager"),
    "header": ("header", "header masthead site-header banner branding logo page-header hero-top"),
    "footer": ("footer", "footer site-footer bottom colophon copyright legal page-footer"),
    "sidebar": ("aside", "sidebar aside widget rail secondary side-column related recommended popular trending tags"),
    "notice": ("div", "notice cookie cookie-banner consent alert gdpr popup modal overlay message warning announcement"),
    "advert": ("div", "ad ads advert advertisement sponsor sponsored promo promoted adsense banner-ad ad-slot"),
    "form": ("form", "form newsletter subscribe signup login search search-form contact-form"),
    "comments": ("section", "comments comment reply replies discussion disqus respond comment-list reader-comments"),
    "share": ("div", "share sharing social social-links follow tools byline-tools"),
}
ARTICLE = "article post content entry story main article-body post-content entry-content main-content text body-text"
FILLER = ("The council met again and heard a long report on the state of the roads. Most members agreed, though "
          "not all. Work will start in spring and end, if the weather holds, before winter.")


def layout(rng: random.Random, sentences: list[str]) -> tuple[str, str]:
    """A generated page and the marker class of its content element."""
    def some(a: int, b: int) -> str:
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(a, b)))

    def words(k: int) -> str:
        return " ".join(rng.choice(sentences).split()[:k])

    semantic = rng.random() < 0.5

    def box(part: str, inner: str) -> str:
        tag, names = PARTS[part]
        name = rng.choice(names.split())
        if not semantic and tag != "form":
            tag = "div"
        attr = f' {rng.choice(("class", "id"))}="{name}"' if not semantic or rng.random() < 0.6 or tag == "div" else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def linked(k: int, j: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(j)}</a></li>' for _ in range(k)) + "</ul>"

    def comment() -> str:
        return f"<div><p>{words(2)}</p><p>{some(1, 3)}</p></div>"

    paragraphs = []
    for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
        r = rng.random()
        paragraphs.append(f"<h2>{words(5)}</h2>" if r < 0.1 else f"<blockquote>{some(1, 2)}</blockquote>" if r < 0.14
                          else "<ul>" + f"<li>{some(1, 1)}</li>" * rng.randint(2, 4) + "</ul>" if r < 0.2
                          else f'<p><a href="#">{some(1, 3)}</a></p>' if r < 0.26
                          else f"<p>{some(1, 6)}" + rng.choice(("</p>", "", "</p>")))
    title = [f"<h1>{words(rng.randint(3, 10))}</h1>"] if rng.random() < 0.9 else []
    # parts of the page between the paragraphs, and at the end of the article
    inner = [box(part, rng.choice((f"<p>{some(1, 2)}</p>", f"<h3>{words(3)}</h3><p>{some(1, 2)}</p>", linked(3, 3))))
             for part in ("advert", "share", "sidebar", "form", "notice", "menu") if rng.random() < 0.08]
    ends = [box("footer", rng.choice((words(4), f"<p>{words(8)}</p>", f"<p>{some(1, 1)}</p>", linked(3, 1))))] if rng.random() < 0.2 else []
    style = rng.random()
    if style < 0.7:
        for x in inner:
            paragraphs.insert(rng.randint(0, len(paragraphs)), x)
        tag = rng.choice(("article", "main")) if semantic else "div"
        name = rng.choice(ARTICLE.split()) if rng.random() < (0.4 if semantic else 0.7) else ""
        content = f'<{tag} class="{name} x-target">{"".join(title + paragraphs + ends)}</{tag}>'
    else:  # no element of its own: the paragraphs stand among the parts of the page
        content = [re.sub(r"^<(\w+)", r'<\1 class="x-target"', x) for x in title + paragraphs]
        for x in inner:
            content.insert(rng.randint(0, len(content)), x)
        content = "".join(content)
    above = [box("header", rng.choice((f"<p>{words(3)}</p>", linked(3, 2), f"<h2>{words(2)}</h2>"))),
             box("menu", linked(rng.randint(3, 9), rng.randint(1, 2))), box("notice", f"<p>{some(1, 2)}</p>"),
             box("advert", rng.choice((some(1, 2), f"<p>{some(1, 1)}</p>"))), box("form", f"<p>{words(4)}</p>")]
    below = [box("comments", "".join(comment() for _ in range(rng.randint(1, 6)))), box("share", linked(3, 1)),
             box("sidebar", rng.choice((linked(5, 6), f"<h3>{words(3)}</h3><p>{some(1, 2)}</p>"))),
             box("footer", rng.choice((f"&copy; {words(8)}", f"<p>{some(1, 2)}</p>", linked(4, 2)))),
             box("advert", some(1, 2)), box("form", f"<p>{words(6)}</p>"), box("notice", f"<p>{some(1, 1)}</p>")]
    dense = rng.choice((0.1, 0.5, 0.5, 0.5, 0.8))
    above = [x for x in above if rng.random() < dense]
    below = [x for x in below if rng.random() < dense]
    if rng.random() < 0.4:
        content = f"<div>{content}</div>"
    page = f"{''.join(above)}{content}{''.join(below)}"
    return f"<html><body>{f'<div>{page}</div>' if rng.random() < 0.3 else page}</body></html>", "target"


EXCLUDED = frozenset(w for _, names in PARTS.values() for n in names.split() for w in re.findall("[a-z]+", n)) - {
    "main", "message", "body", "text", "page", "hero", "top", "column", "side", "site", "links", "list"}


def labelled(dom: Dom, generated: bool) -> np.ndarray | None:
    """1 for content nodes of a page that marks its article, else 0; None if it does not."""
    out = np.zeros(len(dom.tag))
    for i in range(1, len(dom.tag)):
        target = "target" in dom.words[i] if generated else dom.tag[i] in ("article", "main")
        off = dom.tag[i] in ("nav", "aside", "footer", "form") or (not target and EXCLUDED.intersection(dom.words[i]))
        out[i] = not off and (target or out[dom.parent[i]] == 1)
        if generated and target:
            dom.words[i] = tuple(w for w in dom.words[i] if w not in ("target", "x"))
    return out if out.any() else None


class Extractor:
    """A trained model: attribute token weights and trees."""

    def __init__(self, sample: list[str], seed: int = 7, layouts: int = 1000):
        rng = random.Random(seed)
        pages, labels, text = [], [], []
        for html in sample:
            dom = Dom(html)
            if (y := labelled(dom, False)) is not None:
                pages.append(dom)
                labels.append(y)
            text += [t for _, t in dom.blocks if len(t) > 40][:8]
        real = len(pages)
        sentences = [s for t in text for s in re.findall(r"[^.!?]+[.!?]", t[:2000])][:5000]
        sentences = [s.strip() for s in sentences if " " in s.strip()] or re.findall(r"[^.]+\.", FILLER)
        for _ in range(layouts):
            dom = Dom(layout(rng, sentences)[0])
            if (y := labelled(dom, True)) is not None:
                pages.append(dom)
                labels.append(y)
        y = np.concatenate(labels)
        seen, good = Counter(), Counter()
        for dom, ys in zip(pages, labels, strict=True):
            for words, v in zip(dom.words, ys, strict=True):
                seen.update(words)
                if v:
                    good.update(words)
        rate = y.mean()
        self.weight = {w: float(np.log((good[w] + 2 * rate) / (k - good[w] + 2 * (1 - rate)) * (1 - rate) / rate))
                       for w, k in seen.items() if k >= 3}
        x = np.concatenate([features(pages, self.weight), features(pages, self.weight, plain=True)])
        # pages count alike, however many nodes they have, real ones as much as three layouts; the view
        # without names counts a third
        each = np.concatenate([np.full(len(v), (20 if i >= real else 60) / len(v)) for i, v in enumerate(labels)])
        self.trees = Trees().fit(x, np.concatenate([y, y]), np.concatenate([each, each / 3]))

    def texts(self, htmls: list[str], at_once: int = 400) -> Iterator[str]:
        for i in range(0, len(htmls), at_once):
            pages = [Dom(h) for h in htmls[i:i + at_once]]
            score = self.trees.score(features(pages, self.weight))
            at = 0
            for d in pages:
                yield "\n\n".join(decode(d, score[at:at + len(d.tag)]))
                at += len(d.tag)


def train(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 300,
          longest: int = 200_000) -> Extractor:
    """Trains on the ``sample`` distinct pages of smallest hash, of at most ``longest`` characters each:
    the bound on what comes to the driver."""
    html = F.col(html_col)
    pages = df.filter((F.length(html) > 0) & (F.length(html) <= longest)).select(
        F.xxhash64(F.col(id_col), html).alias("h"), html.alias("html"))
    # keeps about four times the sample, whatever the size of the table
    low = int(-2 ** 63 + 2 ** 64 * min(1.0, 4 * sample / max(1, df.count()))) - 1
    rows = pages.filter(F.col("h") <= low).dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    return Extractor([r.html for r in rows])


def extract(df: DataFrame, model: Extractor, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series(list(model.texts(htmls.tolist())), dtype=object)

    return (df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                      main_text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
