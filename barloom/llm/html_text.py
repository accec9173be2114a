"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block elements. Each gets numbers: depth, sizes and densities of its subtree (text, links, tags,
paragraphs, form fields), how it compares with its siblings, its kind of tag, and kinds of tokens in its ``class``, ``id``
and ``role``, of its own and of its ancestors. Boosted trees (logistic loss, own numpy code) give the probability that a
node is main text. They are fitted on the driver to pages that ``lesson`` writes from random words in many layouts
(``LESSONS`` pages, a parameter), whose main nodes are known.

Decoding chooses one state for each node so that the sum of log probabilities is greatest: *around* (not text itself, may
hold main nodes), *main*, or *dropped*. Below a main node only main or dropped may follow, below a dropped node only
dropped; so no ancestor and descendant contradict each other.

Defined results: null, empty and textless html give an empty text; tags that are cut off at the end count as text no more;
unclosed and wrongly nested tags are closed as their parents are; repeated pages repeat; an empty table gives an empty
result. Only ``page_id``, ``url`` and ``html`` are read. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices

LESSONS = 500

# fixed values: kinds of tags and of tokens in attributes
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("script style noscript template svg head title iframe object canvas select textarea option annotation annotation-xml".split())
#: Elements of formulas: their text counts, but they are not markup that thins a text out.
MATH = set(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts "
    "mprescripts mtable mtr mtd maction semantics".split()
)
RAW = set("script style textarea title noscript iframe".split())
BLOCKS = set(
    "html body article section main div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset table tbody thead tfoot tr td th "
    "blockquote pre figure figcaption address details summary menu dialog center hgroup button label legend search".split()
)
AROUND = set("html body div section main center table tbody tr td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAGS = [
    {"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside", "dialog"}, {"form", "fieldset", "button", "label", "legend", "search"},
    {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"div", "section", "center"}, {"table", "tbody", "tr", "td", "th"}, {"figure", "figcaption"},
]
TOKENS = [
    r"^ads?$|advert|sponsor|promo|banner|dfp|outbrain|taboola", r"nav|menu|breadcrumb|pager|pagination|toc", r"comment|disqus|repl(y|ies)|discuss|respon[ds]",
    r"side|aside|widget|related|recommend|trending|popular|share|social", r"foot|copyright|colophon|legal", r"^head|header|masthead|topbar|logo|brand",
    r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|signup|login|paywall|search|form", r"article|content|post|entry|story|main|body|text|prose",
]

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<(?=/?[A-Za-z!])[^>]*\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_KINDS = [re.compile(t) for t in TOKENS]


@lru_cache(maxsize=20_000)
def attribute_kinds(attributes: str) -> int:
    """Bits of the kinds of tokens; one more bit for hidden elements."""
    bits = 0
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            bits |= 1 << len(TOKENS)
        elif name in ("class", "id", "role"):
            for word in _WORDS.findall(value):
                for k, kind in enumerate(_KINDS):
                    if kind.search(word):
                        bits |= 1 << k
    return bits


class Page:
    """Block elements in page order (parents before children) and the text pieces of each."""

    def __init__(self, html: str):
        self.tag, self.parent, self.bits, self.above, self.depth = ["#"], [-1], [0], [0], [0]
        self.links, self.fields, self.tags = [0], [0], [1]
        self.pieces: list[tuple[int, str]] = []  # block and text, in page order; "" ends a block
        open_: list[tuple[str, int]] = [("#", 0)]  # open elements and the block each is in
        at, link = 0, 0
        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(html[at : m.start()], open_[-1][1], link)
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if any(name == t for t, _ in open_[1:]):
                    while open_[-1][0] != name:
                        link -= open_.pop()[0] == "a"
                    link -= open_.pop()[0] == "a"
                    if name in BLOCKS:
                        self.pieces.append((open_[-1][1], ""))
                continue
            block = open_[-1][1]
            self.tags[block] += name not in MATH
            if name in RAW or name in UNSEEN:
                self.fields[block] += name in ("select", "textarea")
                if name == "head":
                    end = re.compile(r"</head\s*>|<body", re.I).search(html, at)
                    at = end.start() if end and end.group().lower() == "<body" else end.end() if end else at
                else:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html) if name in RAW else at
                continue
            if name in VOID:
                self.fields[block] += name == "input"
                if name in ("br", "hr"):
                    self.pieces.append((block, " "))
                continue
            if name in BLOCKS:
                shut = CLOSES.get(name, ())
                while len(open_) > 1 and (open_[-1][0] == "p" or open_[-1][0] not in BLOCKS and any(t == "p" for t, _ in open_) or open_[-1][0] in shut):
                    link -= open_.pop()[0] == "a"
                block = open_[-1][1]
                self.pieces.append((block, ""))
                bits = attribute_kinds(m.group(3)) if m.group(3) else 0
                self.tag.append(name)
                self.parent.append(block)
                self.bits.append(bits)
                self.above.append(self.above[block] | bits | self._inside(name))
                self.depth.append(self.depth[block] + 1)
                self.links.append(0)
                self.fields.append(int(name == "button"))
                self.tags.append(1)
                block = len(self.tag) - 1
            link += name == "a"
            open_.append((name, block))  # a slash at the end closes nothing in HTML
        if at < len(html):
            self._text(html[at:], open_[-1][1], link)

    @staticmethod
    def _inside(name: str) -> int:
        for k in (0, 1, 2, 3, 4, 5):
            if name in TAGS[k]:
                return 1 << (16 + k)
        return 0

    def _text(self, raw: str, block: int, link: int) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append((block, text))
        if link > 0:
            self.links[block] += len(text.strip())

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own = np.zeros(n)
        marks = np.zeros(n)
        for b, t in self.pieces:
            if t and not t.isspace():
                own[b] += len(t)
                marks[b] += t.count(".") + t.count(",")
        text, links, tags, fields = own.tolist(), list(map(float, self.links)), list(self.tags), list(self.fields)
        paras, stops, parent = [float(t == "p") for t in self.tag], marks.tolist(), self.parent
        kids, place = [0] * n, [0] * n  # how many children, and how many siblings come later
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            fields[p] += fields[i]
            paras[p] += paras[i]
            stops[p] += stops[i]
            place[i] = kids[p]
            kids[p] += 1
        out = np.zeros((n, 30 + len(TAGS)), np.float32)
        for i in range(1, n):
            p, t = parent[i], text[i]
            near = kids[p]
            bits, above = self.bits[i], self.above[p]
            row = [
                self.depth[i], np.log1p(t), links[i] / t if t else 0.0, t / tags[i], kids[i], near, t / text[p] if text[p] else 0.0,
                1 - place[i] / max(1, near - 1), paras[i], fields[i], stops[i] / t if t else 0.0, own[i] / t if t else 0.0,
            ]
            out[i, :12] = row
            for k in range(len(TOKENS)):
                out[i, 12 + k] = bits >> k & 1
                out[i, 20 + k] = (above >> k & 1) if k < 4 else out[i, 20 + k]
            out[i, 24:30] = [above >> 16 & 1, above >> 17 & 1, above >> 18 & 1, above >> 19 & 1, above >> 20 & 1, above >> 21 & 1]
            for k, names in enumerate(TAGS):
                if self.tag[i] in names:
                    out[i, 30 + k] = 1
        return out

    def states(self, p: np.ndarray) -> list[int]:
        """0 around, 1 main, 2 dropped for each node, by the greatest sum of log probabilities."""
        n = len(self.tag)
        yes, no = np.log(np.clip(p, 1e-6, 1)).tolist(), np.log(np.clip(1 - p, 1e-6, 1)).tolist()
        hidden = 1 << len(TOKENS)
        main, drop, around = [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            main[i] += yes[i] if not self.bits[i] & hidden else -1e9
            drop[i] += no[i]
            around[i] += no[i] if self.tag[i] in AROUND or i == 0 else -1e9
            if i:
                q = self.parent[i]
                main[q] += max(main[i], drop[i])
                drop[q] += drop[i]
                around[q] += max(main[i], drop[i], around[i])
        state = [0] * n
        for i in range(1, n):
            above = state[self.parent[i]]
            if above == 2:
                state[i] = 2
            elif above == 1:
                state[i] = 1 if main[i] >= drop[i] else 2
            else:
                best = max(main[i], drop[i], around[i])
                state[i] = 1 if best == main[i] else 2 if best == drop[i] else 0
        return state

    def text(self, state: list[int]) -> str:
        blocks, now, last = [], [], -1
        for b, t in self.pieces:
            if not t or b != last:
                blocks.append("".join(now))
                now, last = [], b
            if t and (state[b] == 1 or b == 0):  # no element says that text outside of all is something else
                now.append(t)
        blocks.append("".join(now))
        return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


class Boosted:
    """Boosted regression trees of depth ``depth`` for the logistic loss, on binned numbers."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.base, self.cuts, self.found = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree: dict = {}
            self._grow(tree, 1, b, y - p, p * (1 - p), np.arange(len(y)), z)
            self.found.append(tree)
        return self

    def _grow(self, tree: dict, k: int, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, z: np.ndarray) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, -1, 0)
        if k < 1 << self.depth and len(rows) >= 20:
            for f in range(b.shape[1]):
                left_g = np.bincount(b[rows, f], g[rows], self.bins)[:-1].cumsum()
                left_h = np.bincount(b[rows, f], h[rows], self.bins)[:-1].cumsum()
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), f, at)
        if best[1] < 0:
            tree[k] = step = self.rate * total_g / (total_h + 1)
            z[rows] += step
            return
        _, f, at = best
        tree[k] = (f, self.cuts[f][at] if at < len(self.cuts[f]) else np.inf)
        left = b[rows, f] <= at
        self._grow(tree, 2 * k, b, g, h, rows[left], z)
        self._grow(tree, 2 * k + 1, b, g, h, rows[~left], z)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)

        def walk(tree: dict, k: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            node = tree[k]
            if not isinstance(node, tuple):
                z[rows] += node
                return
            left = x[rows, node[0]] <= node[1]
            walk(tree, 2 * k, rows[left])
            walk(tree, 2 * k + 1, rows[~left])

        for tree in self.found:
            walk(tree, 1, np.arange(len(x)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Marks words of main text in lessons (a private-use character).
_MAIN = "\ue000"


def lesson(rng: np.random.Generator) -> str:
    """A page in one of many layouts; words of main text carry a mark that ``taught`` turns into labels."""

    def words(n: int, main: bool = False) -> str:
        made = ["".join(rng.choice(list("aeioubcdlmnprstéß"), rng.integers(2, 9))) for _ in range(max(1, n))]
        text = " ".join(made).capitalize() + rng.choice([".", ".", "", "!!", "***"])
        return (_MAIN if main else "") + text

    def one(*options: str) -> str:
        return str(rng.choice(options))

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{words(int(rng.integers(1, 4)))}</a>' for i in range(n)]
        return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if rng.random() < 0.7 else " | ".join(items)

    def box(tag: str, token: str, inner: str) -> str:
        named = f' {one("class", "class", "id")}="{token}"' if token and (tag not in ("nav", "header", "footer", "aside") or rng.random() < 0.5) else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def paragraph() -> str:
        n = int(rng.choice([1, 3, 8, 20, 60, 120] if long else [1, 2, 4, 8]))
        text = words(n, True)
        if rng.random() < 0.3:
            text += f' <a href="#">{words(2)}</a> <b>{words(3)}</b>'
        kind = rng.random()
        if kind < 0.75:
            return f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>"
        if kind < 0.85:
            return f"<ul>{''.join(f'<li>{words(6, True)}</li>' for _ in range(int(rng.integers(2, 6))))}</ul>"
        return box(one("blockquote", "div", "h2", "pre", "figure"), "", text)

    def advert() -> str:
        return box(one("div", "div", "aside", "section"), one("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner"), words(int(rng.integers(2, 14))))

    def form() -> str:
        return f'<form action="/s"><label>{words(2)}</label><input name=q><button>{words(1)}</button></form>'

    long = rng.random() < 0.7
    heading = f"<h1>{words(int(rng.integers(1, 9)), True)}</h1>"
    inside = [heading] if rng.random() < 0.85 else []
    for _ in range(int(rng.choice([1, 1, 2, 3, 5, 8, 12]))):
        inside.append(paragraph())
        if rng.random() < 0.08:
            inside.append(advert() if rng.random() < 0.5 else box("div", one("notice", "cookie-notice", "share", "comment", "widget"), words(int(rng.integers(2, 20)))))
        if rng.random() < 0.04:
            inside.append(box("aside", one("related", "share", "newsletter"), words(8) + links(2)))
    tag, token = [("article", ""), ("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry"), ("div", ""), ("section", "story")][int(rng.integers(10))]
    main = box(tag, token, "".join(inside)) if rng.random() < 0.9 else "".join(inside)
    if rng.random() < 0.3:
        main = box(one("div", "main"), one("wrap", "container", "main", ""), main)
    chrome = [
        box(one("nav", "nav", "div", "div"), one("nav", "menu", "main-menu", "breadcrumbs"), links(int(rng.integers(2, 9)))) if rng.random() < 0.8 else "",
        box(one("header", "div"), one("header", "masthead", "site-head"), words(int(rng.integers(1, 8))) + (links(3) if rng.random() < 0.4 else "")) if rng.random() < 0.5 else "",
        box(one("div", "section", "dialog"), one("cookie-notice", "notice", "alert", "consent", "popup"), f"<p>{words(int(rng.integers(4, 25)))}</p>") if rng.random() < 0.35 else "",
        advert() if rng.random() < 0.6 else "",
        form() if rng.random() < 0.2 else "",
    ]
    comment = "".join(box(one("div", "div", "div", "li", "li", "p", "p", "article"), one("comment", "reply", "comment-body"), f"<p>{words(int(rng.integers(2, 40)))}</p>") for _ in range(int(rng.integers(1, 6))))
    after = [
        box(one("section", "div", "ol"), one("comments", "discussion", "responses", "comment-list"), (f"<h2>{words(1)}</h2>" if rng.random() < 0.5 else "") + comment) if rng.random() < 0.4 else "",
        box(one("aside", "aside", "div"), one("sidebar", "widget", "related-posts", "side"), f"<h3>{words(2)}</h3>" + (links(4) if rng.random() < 0.6 else f"<p>{words(int(rng.integers(4, 40)))}</p>")) if rng.random() < 0.5 else "",
        advert() if rng.random() < 0.2 else "",
        box(one("footer", "footer", "div"), one("footer", "foot", "copyright"), "&copy; " + words(int(rng.integers(1, 20)))) if rng.random() < 0.85 else "",
    ]
    rng.shuffle(chrome)
    body = [*chrome, main, *after] if rng.random() < 0.92 else [main]
    head = f"<head><title>{words(4)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(body)}</body></html>"


def taught(pages: int = LESSONS, seed: int = 11) -> Boosted:
    """The trees, fitted to the nodes of lessons."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(pages):
        page = Page(lesson(rng))
        n = len(page.tag)
        marked = [0] * n
        for b, t in page.pieces:
            marked[b] += _MAIN in t
        direct = [m > 0 for m in marked]
        for i in range(n - 1, 0, -1):
            marked[page.parent[i]] += marked[i]
        # a node is main if its own text is marked, or if it is an article or named as content, or in one, and holds marks
        good = [False] * n
        for i in range(1, n):
            named = page.tag[i] in TAGS[0] or page.bits[i] >> 7 & 1
            good[i] = bool(marked[i]) and (direct[i] or bool(named) or good[page.parent[i]])
        page.pieces = [(b, t.replace(_MAIN, "")) for b, t in page.pieces]
        x = page.features()
        xs.append(x[1:])
        ys.append(np.array(good[1:], float))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def main_text(pages: DataFrame, lessons: int = LESSONS) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    model = pages.sparkSession.sparkContext.broadcast(taught(lessons))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "html"):
            trees = [Page(h.decode("utf-8", "replace")) for h in raw]
            found = [t.features() for t in trees]
            p = np.split(model.value.probability(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])
            texts = [t.text(t.states(q)) for t, q in zip(trees, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")
