"""Main-text extraction from HTML: gradient-boosted trees over DOM nodes, decoded down the hierarchy.

A page is parsed into a tree of elements. Every block-level element gets features: its tag, how much the tokens of its
attributes and of its ancestors', the words of a short text and of the heading before it speak for main text (odds that
are learned), depth, size and density of its subtree, link share, sentence signs, and statistics among its siblings. Boosted trees give the probability that the element holds main text. Decoding chooses, by dynamic programming
over the tree, the likeliest labelling in which a dropped element has no kept descendant; an element that holds
text of its own counts fully, a mere container by less. Names are no evidence against an element that holds most of a page's
text, and a page of prose that decodes to nothing is decoded again without any names. Kept text is joined block by block
in page order.

The trees are trained here on pages made by a seeded generator of many layouts (PAGES pages), whose main text is known;
no row of the corpus is used. The same seed gives the same trees on every machine.

Defined results: a null or empty page gives an empty text; text outside all elements counts as the body's; broken mark-up
(missing ends, stray ends, cut tags) is read as browsers do for the common cases; a page of one huge text node is one block;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ship

PAGES, SEED, TREES, DEPTH, BINS, RATE, SHARE = 2400, 5, 90, 4, 32, 0.2, 0.4
SHRINK = 6  # sightings at which a token's odds count half

#: Comments, declarations and tags. A quote counts only after an equals sign; nothing is read twice.
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")
_LETTERS = re.compile(r"[^\W\d_]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg object canvas audio video select datalist xmp noembed noframes annotation annotation-xml".split())
ENDLESS = frozenset("textarea script style title iframe noembed noframes xmp".split())  # without an end they go on to the end of the page
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mtable mtr mtd mspace mstyle mpadded mphantom semantics".split()
)
CLOSES = {  # a start tag on the left ends open elements on the right
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
P_STAYS = INLINE | VOID - {"hr"}

HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAGS = "p div section article main body nav header footer aside form ul ol li table td h1 h2 h3 figure blockquote pre noscript".split()
TAG_AT = {t: k for k, t in enumerate(TAGS)}
ABOVE = "article main nav footer aside form header".split()  # of these it matters whether an element is inside of one
NAMING = frozenset(("class", "id", "role", "itemprop", "data-component", "aria-label"))
SHORT = 80  # words of no longer texts are looked at
MOST = 0.8  # of a page's text: names don't speak against what holds so much
PROSE = 200  # characters that make a page one of prose, if they stand in blocks with sentence signs


class Node:
    """An element. block: the nearest element above that isn't inline."""

    __slots__ = ("tag", "names", "hidden", "kids", "block", "own", "text", "link", "tags", "paras", "marks", "depth", "inline", "keep", "said", "title")

    def __init__(self, tag: str, block, names: tuple[str, ...] = (), hidden: bool = False, depth: int = 0) -> None:
        self.tag, self.block, self.names, self.hidden, self.depth, self.kids = tag, block, names, hidden, depth, []
        self.own = self.text = self.link = self.tags = self.paras = self.marks = 0
        self.inline, self.keep, self.said, self.title = tag in INLINE, False, "", None


def _named(attrs: str) -> tuple[tuple[str, ...], bool]:
    """The tokens of an element's names, and whether it is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in NAMING:
            names += _TOKEN.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower())
        elif name == "hidden" or name == "style" and "display:none" in (m[2] or m[3] or m[4] or "").replace(" ", "").lower():
            hidden = True
    return tuple(dict.fromkeys(names)), hidden


def parse(page: str) -> Node:
    """A tree of elements; text is str among the kids. The work grows with the page's length only."""
    root = Node("#root", None)
    path, where, solid = [root], {}, [0]  # the open elements; the places of each tag, and of those that aren't inline, in it
    endless: set[str] = set()  # raw tags that have no end in the rest of the page
    pos, n = 0, len(page)

    def close(k: int) -> None:
        while len(path) > k:
            x = path.pop()
            where[x.tag].pop()
            if not x.inline:
                solid.pop()

    while pos < n:
        m = _TAG.search(page, pos)
        end = m.start() if m else n
        if end > pos and path[-1].tag != "head":
            path[-1].kids.append(page[pos:end])
        if not m:
            break
        pos, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            at = where.get(tag)
            if at and not (tag in INLINE and at[-1] < solid[-1]):  # an inline end tag doesn't close blocks
                close(at[-1])
            continue
        if tag in RAW or tag == "noscript" and path[-1].tag == "head":
            stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos)
            if stop is None:
                endless.add(tag)
            if stop or tag in ENDLESS:
                pos = stop.end() if stop else n
            continue
        if tag in ("html", "body") and where.get(tag):
            continue
        if path[-1].tag == "head" and tag not in ("meta", "link", "base"):
            close(len(path) - 1)
        if tag not in P_STAYS:  # a block ends an open paragraph, and the inline elements in it
            k = solid[-1]
            if path[k].tag == "p":
                close(k)
            elif tag in HEADS or tag in ("article", "section", "nav", "footer", "header", "aside"):
                close(k + 1)
        if tag in CLOSES:
            least = max((where[x][-1] for x in HOLDS.get(tag, {"table"}) if where.get(x)), default=0)
            ends = [at[k] for at in (where.get(x, ()) for x in CLOSES[tag]) if (k := bisect_right(at, least)) < len(at)]
            if ends:
                close(min(ends))
        attrs = m[3]
        names, hidden = _named(attrs) if attrs else ((), False)
        node = Node(tag, path[solid[-1]], names, hidden, len(path))
        path[-1].kids.append(node)
        if tag not in VOID and not (attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in " \t\n\"'")):
            where.setdefault(tag, []).append(len(path))
            if not node.inline:
                solid.append(len(path))
            path.append(node)
    return root


def measure(root: Node) -> list[Node]:
    """Fill in the counts of every element; the block-level ones in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in reversed(x.kids) if not isinstance(k, str))
    for x in reversed(order):
        said = []
        for k in x.kids:
            if isinstance(k, str):
                c = len(k) if not k.isspace() else 0
                if c:
                    x.own += c
                    x.text += c
                    x.marks += len(_SENTENCE.findall(k)) + k.count(", ")
                    if x.text <= SHORT:
                        said.append(k)
            else:
                x.text += k.text
                x.link += k.link
                x.tags += k.tags + 1
                x.marks += k.marks
                x.paras += k.paras + (k.tag == "p")
                if k.inline:
                    x.own += k.own
                if x.text <= SHORT:
                    said.append(k.said)
                if k.tag in HEADS and x.text == k.text:  # nothing stands before it
                    x.title = k
        if x.text <= SHORT:
            x.said = " ".join(said)
        if x.tag == "a":
            x.link = x.text
    return [x for x in order if not x.inline and x.tag not in ("#root", "html", "head") and x.tag not in VOID]


def said_words(x: Node) -> list[str]:
    """The words of a short text, those of a heading below the first level apart from others."""
    kind = "h:" if x.tag in HEADS and x.tag != "h1" else "w:"
    return [kind + w for w in _LETTERS.findall(_html.unescape(x.said).lower())] if x.said else []


def odds_of(names, odds: dict[str, float]) -> tuple[float, float]:
    got = [odds.get(x, 0.0) for x in names]
    return (min(got), max(got)) if got else (0.0, 0.0)


N_FEATURES = len(TAGS) + len(ABOVE) + 31


def features(blocks: list[Node], root: Node, odds: dict[str, float]) -> np.ndarray:
    """One row for each block. odds: how much an attribute token, or a word of a short text, speaks for main text."""
    out = np.zeros((len(blocks), N_FEATURES), np.float32)
    total, base = max(1, root.text), len(TAGS)
    nth: dict[int, list] = {}
    for x in blocks:
        g = nth.setdefault(id(x.block), [0, 0, 0])
        g[0] += 1
        g[1] = max(g[1], x.text)
        g[2] += x.text
    #: of a block, for those in it: lowest and highest odds above, flags of ABOVE, hidden, odds of the last heading, blocks so far, tag and text of the last, highest odds of the last heading
    state: dict[int, list] = {}
    start = [0.0, 0.0, 0, False, 0.0, 0, "", 0, 0.0]
    for i, x in enumerate(blocks):
        up = state.get(id(x.block)) or state.setdefault(id(x.block), list(start))
        lo, hi = odds_of(x.names, odds)
        lo = max(lo, 0.0) if x.text > max(MOST * total, PROSE) else lo
        words = odds_of(said_words(x), odds)
        title = odds_of(said_words(x.title), odds)[0] if x.title else 0.0
        if x.tag in HEADS:
            up[4], up[8] = words
        k, last_tag, last_text = up[5], up[6], up[7]
        up[5], up[6], up[7] = k + 1, x.tag, x.text
        flags = up[2] | (1 << ABOVE.index(x.tag) if x.tag in ABOVE else 0)
        state[id(x)] = [min(up[0], lo), max(up[1], hi), flags, up[3] or x.hidden, min(up[4], title), 0, "", 0, up[8]]
        row = out[i]
        if x.tag in TAG_AT:
            row[TAG_AT[x.tag]] = 1
        for j in range(len(ABOVE)):
            if up[2] >> j & 1:
                row[base + j] = 1
        n, most, whole = nth[id(x.block)]
        row[base + len(ABOVE) :] = (
            lo,
            hi,
            lo + hi,
            up[0],
            up[1],
            up[0] + up[1],
            x.hidden,
            up[3],
            words[0],
            words[1],
            title,
            up[4],
            up[8],
            x.depth,
            math.log1p(x.text),
            math.log1p(x.own),
            x.text / total,
            x.link / max(1, x.text),
            x.text / (x.tags + 1),
            x.marks / max(1, x.text) * 100,
            x.paras,
            x.text / max(1, whole),
            x.text / max(1, most),
            k / max(1, n),
            n,
            last_tag in HEADS,
            last_tag == x.tag,
            last_text / total,
            x.block.text / total,
            x.block.link / max(1, x.block.text),
            x.block.paras,
        )
    return out


def _edges(v: np.ndarray) -> np.ndarray:
    """Cuts between all values if there are few (rare flags must be seen), else between quantiles."""
    u = np.unique(v)
    if len(u) > BINS:
        u = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)))
    return ((u[1:] + u[:-1]) / 2).astype(np.float32)


def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of a tree that each row comes to."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(DEPTH):
        at = at * 2 + 1 + (x[rows, feature[at]] >= cut[at])
    return at - (2**DEPTH - 1)


class Boosted:
    """Gradient boosting of complete trees on binned features, with logistic loss."""

    def __init__(self, odds: dict[str, float] | None = None) -> None:
        self.odds = odds or {}

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [_edges(x[:, j]) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        self.bias = float(np.log((w * y).sum() / (w * (1 - y)).sum()))
        z, rng = np.full(len(y), self.bias), np.random.default_rng(SEED)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (p - y), w * p * (1 - p)
            part = np.flatnonzero(rng.random(len(y)) < SHARE)  # each tree is grown on a part of the rows
            own, node = binned[part], np.zeros(len(part), np.int64)
            gp, hp = g[part], h[part]
            feature, cut = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, np.inf, np.float32)
            for d in range(DEPTH):
                best = [(1e-6, -1, 0)] * 2**d
                for j in range(x.shape[1]):
                    k = len(self.edges[j]) + 1
                    if k < 2:
                        continue
                    at = node * k + own[:, j]
                    gs = np.bincount(at, gp, 2**d * k).reshape(-1, k).cumsum(1)
                    hs = np.bincount(at, hp, 2**d * k).reshape(-1, k).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                    c = gain.argmax(1)
                    for q in range(2**d):
                        if gain[q, c[q]] > best[q][0] + 1e-9:
                            best[q] = gain[q, c[q]], j, c[q]
                right = np.zeros(len(part), bool)
                for q, (_, j, c) in enumerate(best):
                    if j >= 0:
                        feature[2**d - 1 + q], cut[2**d - 1 + q] = j, self.edges[j][c]
                        right |= (node == q) & (own[:, j] > c)
                node = node * 2 + right
            value = -RATE * np.bincount(node, gp, 2**DEPTH) / (np.bincount(node, hp, 2**DEPTH) + 1)
            z += value[_leaf(x, feature, cut)]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        self.feature, self.cut, self.value = np.array(self.feature), np.array(self.cut), np.array(self.value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            z += v[_leaf(x, f, c)]
        return 1 / (1 + np.exp(-z))


def decode(root: Node, blocks: list[Node], p: np.ndarray) -> None:
    """Mark the elements to keep: the likeliest labelling without a kept element below a dropped one."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = {}, {}
    kids: dict[int, list[Node]] = {}
    for x in blocks:
        kids.setdefault(id(x.block), []).append(x)
    for i in range(len(blocks) - 1, -1, -1):
        x = blocks[i]
        weight = math.log1p(x.own) if x.own else 1.0
        yes[id(x)] = weight * math.log(p[i]) + sum(max(yes[id(k)], no[id(k)]) for k in kids.get(id(x), ()))
        no[id(x)] = weight * math.log(1 - p[i]) + sum(no[id(k)] for k in kids.get(id(x), ()))
    for x in blocks:
        x.keep = (x.block.keep or x.block.tag in ("#root", "html")) and yes[id(x)] > no[id(x)]
    root.keep = True


def collect(root: Node) -> str:
    """Kept text, block by block."""
    out: list[str] = []
    block: list[str] = []

    def close():
        if block:
            text = " ".join(_html.unescape("".join(block)).split())
            if text:
                out.append(text)
            block.clear()

    stack: list = [(root, True)]
    while stack:
        x, keep = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if keep:
                block.append(x)
        elif x.tag == "br" or x.tag in VOID and x.inline:
            block.append(" ") if block else None
        elif x.inline:
            stack.extend((k, keep) for k in reversed(x.kids))
        else:
            close()
            keep = x.keep or x.tag in ("#root", "html")
            if x.tag in ("#root", "html") or keep:
                stack.append((None, False))
                own = keep and x.tag not in ("#root", "html") or x.tag in ("#root", "html") and not any(not isinstance(k, str) and not k.inline for k in x.kids)
                stack.extend((k, own) for k in reversed(x.kids))
    close()
    return "\n".join(out)


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main texts of whole pages; one prediction for all their elements."""
    trees = [parse(p) for p in pages]
    blocks = [measure(t) for t in trees]
    xs = [features(b, t, model.odds) for b, t in zip(blocks, trees, strict=True)]
    ps = np.split(model.predict(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1]) if xs else []
    out = []
    for t, b, p in zip(trees, blocks, ps, strict=True):
        decode(t, b, p)
        text = collect(t)
        if not text and sum(x.own for x in b if x.marks) >= PROSE:
            decode(t, b, model.predict(features(b, t, {w: v for w, v in model.odds.items() if ":" in w})))
            text = collect(t)
        out.append(text)
    return out


# --- training pages -------------------------------------------------------------------------------------------------


#: What templates call their blocks, and what boilerplate says, in several languages. Our own choice; the trees learn from
#: pages made with these how much each token speaks for main text.
CALLED = {
    "menu": "nav navbar navigation menu main-menu site-nav topnav breadcrumb breadcrumbs toc tabs pager pagination dropdown skip-links sitemap topbar toolbar mega-menu",
    "foot": "footer site-footer foot bottom colophon copyright legal imprint footer-links page-footer credits",
    "head": "header site-header masthead brand logo banner top page-top branding hero-bar",
    "side": "sidebar side aside rail widget widgets secondary complementary related related-posts recommended popular trending more-stories recent-posts teaser-list also-like",
    "bio": "author-bio author-box about-author byline-box tags tag-list post-tags categories meta-box post-meta",
    "ad": "ad ads advert advertisement adsense ad-slot sponsor sponsored promo promotion promoted banner-ad dfp outbrain taboola commercial ad-container",
    "note": "cookie cookies cookie-notice cookie-banner cc-window cc-banner consent gdpr notice alert modal popup overlay paywall dialog toast warning privacy-note disclaimer noscript-warning",
    "talk": "comments comment-list commentlist comments-area respond replies discussion disqus thread reviews feedback comment-section user-comments responses",
    "form": "search search-form login signin signup newsletter subscribe subscription register contact-form mailing-list opt-in",
    "share": "share share-buttons sharing social social-links follow buttons cta share-bar",
    "text": "content main-content post post-content entry entry-content article article-body body-text story story-body text prose markdown blog-post page-content wysiwyg hentry maincontent post-body",
    "wrap": "site page wrapper wrap container outer inner root app layout main row col grid top bar hero notice public-notice top-story site-content site-main content-area primary block box panel section item view story-wrap page-wrap wp-site home lead card",
    "title": "entry-header post-header article-header page-header title-wrap headline story-header entry-title",
}
SAID = {
    "menu": "home start accueil inicio contact kontakt about über sitemap menu menü archive blog news shop",
    "foot": "copyright rights reserved impressum datenschutz agb imprint privacy policy terms mentions légales confidentialité aviso legal privacidad colofon powered theme",
    "side": "related popular recent trending more from recommended ähnliche beliebte neueste verwandte articles artikel similaires récents relacionados recientes populares also weitere",
    "ad": "advertisement anzeige werbung publicité publicidad sponsored sponsor gesponsert buy kaufen offer angebot discount rabatt",
    "note": "cookies cookie consent accept akzeptieren zustimmen accepter aceptar javascript enable browser subscribers registered",
    "talk": "comments comment kommentare kommentar commentaires comentarios commenti reacties reply replies antworten répondre responder says schrieb",
    "form": "search suche recherche buscar login anmelden newsletter subscribe abonnieren abonnez suscríbete email password passwort",
    "share": "share teilen partager compartir facebook twitter linkedin whatsapp pinterest follow tweet",
}


class Maker:
    """Makes pages of many layouts. Main text is inside elements that carry data-keep, which is taken off before features."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = [a + b for a in "b c d f g h l m n p r s t v th ch st".split() for b in "a e i o u an en er on is".split()]
        self.called = {k: v.split() for k, v in CALLED.items()}
        self.boiler = {k: v.split() for k, v in SAID.items()}
        self.any_said = [w for v in self.boiler.values() for w in v]

    def words(self, n: int) -> list[str]:
        return ["".join(self.r.choices(self.syllables, k=self.r.choice([1, 1, 2, 2, 3]))) for _ in range(n)]

    def sentence(self, lo: int = 4, hi: int = 22) -> str:
        w = self.words(self.r.randint(lo, hi))
        if self.r.random() < 0.04:  # boilerplate's words are also words of texts
            w[self.r.randrange(len(w))] = self.r.choice(self.any_said)
        for i in range(4, len(w) - 1, 7):
            w[i] += self.r.choice([",", "", ""])
        return " ".join(w).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def said(self, kind: str, n: int = 2) -> str:
        """A few words of boilerplate, with others among them."""
        w = self.r.choices(self.boiler[kind], k=self.r.randint(1, n)) + self.words(self.r.choice([0, 0, 1, 2]))
        self.r.shuffle(w)
        return " ".join(w).capitalize()

    def name(self, kind: str) -> str:
        """An attribute that names a block, or none."""
        r = self.r.random()
        if r < 0.12:
            return ""
        names = [self.r.choice(self.called[kind]), *(self.words(1) if self.r.random() < 0.3 else []), *(["clearfix"] if self.r.random() < 0.1 else [])]
        if self.r.random() < 0.2:
            names[0] += self.r.choice(["-wrap", "-box", "-inner", "-1", "__list", "Container"])
        return f' {self.r.choice(["class", "class", "class", "id", "role", "aria-label"])}="{" ".join(names)}"'

    def boxed(self, text: str) -> str:
        """A box around the article or the page: its name says nothing, whatever it is, but that of a box is likelier."""
        r = self.r
        names = [r.choice(self.called["wrap"]) if r.random() < 0.75 else self.words(1)[0] if r.random() < 0.6 else r.choice("abcdefghi")] + (self.words(1) if r.random() < 0.2 else [])
        name = "" if r.random() < 0.15 else f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"'
        tag = r.choice(["div", "div", "div", "section", "main"])
        return f"<{tag}{name} data-keep>{text}</{tag}>"

    def prose(self, lo: int = 1, hi: int = 8) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))
        if self.r.random() < 0.15:  # no signs at all, or words that repeat
            n = self.r.choice([3, 20, 100, 300])
            s = " ".join(self.words(n) if self.r.random() < 0.5 else [w for w in self.words(n // 10 + 1) for _ in range(10)])
        if self.r.random() < 0.2:
            s = s.replace(" ", f' <a href="/x">{" ".join(self.words(2))}</a> ', 1)
        if self.r.random() < 0.2:
            s = f"<b>{s}</b>" if self.r.random() < 0.5 else f"<b>{s}<br>"
        return s

    def quoted(self) -> str:
        """A paragraph of main text that sounds like boilerplate: notices, addresses, or its words among others."""
        r, w = self.r, self.words(4)
        return r.choice([
            "All rights reserved.", f"Copyright {r.randint(1990, 2026)} {w[0].title()}. All rights reserved.", f"{self.said(r.choice([*self.boiler]), 3)}.", f"{self.sentence()[:-1]} {w[1]}@mail.example.com {w[2]}.",
            f"{self.sentence()} https://www.{w[0]}.example.com/{w[1]}", f"Licensed under the {w[0]} license, see http://{w[1]}.example.org.", f"{self.said(r.choice([*self.boiler]), 2)} {self.sentence()}",
            f"{r.choice(self.any_said).title()} {' '.join(self.words(r.randint(2, 5)))}", f"{r.choice(self.any_said).title()} {' '.join(self.words(r.randint(2, 5)))}.",
        ])

    def linked(self) -> str:
        """Prose in which up to nearly every word is a link."""
        share = self.r.choice([0.2, 0.5, 0.8, 0.95])
        return ". ".join(" ".join(f'<a href="/{w}">{w}</a>' if self.r.random() < share else w for w in self.words(self.r.randint(5, 25))).capitalize() for _ in range(self.r.randint(1, 4))) + "."

    def links(self, n: int, kind: str = "menu") -> str:
        """A list's items: a link each, of a word or some, now and then with signs."""
        r, some = self.r, self.boiler[kind]
        signs, most = r.choice(["", "", ",.!?"]), r.choice([1, 1, 1, 4])
        out = []
        for _ in range(n):
            text = r.choice(some) if r.random() < 0.3 else " ".join(self.words(r.randint(1, most))) + (r.choice(signs) if signs and r.random() < 0.5 else "")
            out.append(f'<li><a href="/{self.words(1)[0]}">{text.title() if r.random() < 0.5 else text}</a></li>')
        return "".join(out)

    def menu(self) -> str:
        body = f"<ul>{self.links(self.r.randint(2, 12))}</ul>"
        return self.r.choice([f"<nav>{body}</nav>", f"<div{self.name('menu')}>{body}</div>", f"<nav{self.name('menu')}>{body}</nav>", f"<ul{self.name('menu')}>{body[4:]}"])

    def edge(self, foot: bool) -> str:
        if foot:
            text = self.r.choice(["&copy; 2024 ", "&copy; site.example &middot; ", "All rights reserved. ", self.said("foot", 3) + " "]) + self.sentence(1, 14)
            if self.r.random() < 0.5:
                text = f"<p>{text}</p><ul>{self.links(3, 'foot')}</ul>"
            elif self.r.random() < 0.3:
                text = " | ".join(f'<a href="/l">{self.said("foot")}</a>' for _ in range(self.r.randint(1, 4)))
            return self.r.choice([f"<footer>{text}</footer>", f"<footer{self.name('foot')}>{text}</footer>", f"<div{self.name('foot') or ' id=footer'}>{text}</div>"])
        text = self.r.choice([f"<a href='/'>{self.words(1)[0]}</a>", f"<h2>{' '.join(self.words(2))}</h2>", f"<p>{self.sentence(3, 8)}</p>"])
        return self.r.choice([f"<header>{text}</header>", f"<header{self.name('head')}>{text}</header>", f"<div{self.name('head') or ' class=header'}>{text}</div>"])

    def talk(self) -> str:
        """Readers' comments: in blocks of their own, in lists, with names, with or without a class."""
        r = self.r
        who = lambda: r.choice(["<b>{}</b>", "<cite>{}</cite>", "<strong>{}:</strong>", '<a href="/u">{}</a>', "<span>{}</span>", "<h4>{}</h4>"]).format(self.words(1)[0].title())
        if r.random() < 0.35:
            who = lambda: self.words(1)[0].title() + ":"
        each = [who() + r.choice(["", " " + self.said("talk")]) + r.choice([f"<p>{self.prose(1, 3)}</p>", " " + self.sentence(2, 14)]) for _ in range(r.randint(1, 6))]
        title = r.choice([f"<h3>{self.said('talk')}</h3>", f"<h2>{len(each)} {self.said('talk', 1)}</h2>", f"<h3>{r.randint(1, 40)} {r.choice(self.boiler['talk'])}</h3>", f"<h3>{' '.join(self.words(2))}</h3>"])
        named = r.random() < 0.45
        own = lambda t: f"<{t}{r.choice([' class=comment', ' class=reply', ' class=c', ''])}>"
        if r.random() < 0.6:
            t = r.choice(["ul", "ol"])
            body = f"<{t}{self.name('talk') if r.random() < 0.4 else ''}>" + "".join(f"{own('li')}{x}</li>" for x in each) + f"</{t}>"
        else:
            body = "".join(f"{own('div')}{x}</div>" for x in each)
        if not named:
            title = f"<h3>{self.said('talk')}</h3>"
            return r.choice([f"<div>{title}{body}</div>", f"<section>{title}{body}</section>", title + body, title + body])
        return r.choice([f"<section{self.name('talk') or ' class=comments'}>{title}{body}</section>", f"<div{self.name('talk') or ' id=comments'}>{r.choice(['', title])}{body}</div>"])

    def junk(self) -> str:
        """A boilerplate block that can stand anywhere."""
        r, s = self.r, self.prose(1, 2)
        kind = r.randrange(10)
        if kind == 0:
            return f"<div{self.name('ad') or ' class=ad'}>{r.choice([s, '<p>' + s + '</p>', self.said('ad', 3), '<span>' + self.said('ad') + '</span><p>' + s + '</p>'])}</div>"
        if kind == 1:
            text = s if r.random() < 0.5 else self.said("note", 4) + ". " + s
            return f"<div{self.name('note') or ' class=notice'}><p>{text}</p>{'<button>OK</button>' * r.randint(0, 1)}</div>"
        if kind == 2:
            return f"<form action=\"/s\"{self.name('form')}><label>{r.choice([' '.join(self.words(2)), self.said('form')])}</label><input name=q><p>{s}</p><button>Go</button></form>"
        if kind == 3:
            return f"<div{self.name('share') or ' class=share'}>{r.choice(['<ul>' + self.links(r.randint(2, 5), 'share') + '</ul>', ' '.join('<a href=/s>' + w + '</a>' for w in r.choices(self.boiler['share'], k=3))])}</div>"
        if kind == 4:
            inner = f"<h3>{r.choice([' '.join(self.words(2)), self.said('side')])}</h3><ul>{self.links(r.randint(2, 7), 'side')}</ul>" + (f"<p>{s}</p>" if r.random() < 0.5 else "")
            if r.random() < 0.3:  # cards
                card = lambda: f"<div{r.choice([' class=card', ' class=item', ''])}><h4>{' '.join(self.words(r.randint(2, 6)))}</h4><p>{self.sentence(3, 16)}</p></div>"
                inner = f"<h3>{self.said('side', 3)}</h3>" + "".join(card() for _ in range(r.randint(2, 5)))
            return r.choice([f"<aside>{inner}</aside>", f"<aside{self.name('side')}>{inner}</aside>", f"<div{self.name('side') or ' class=sidebar'}>{inner}</div>"])
        if kind in (5, 9):
            return self.talk()
        if kind == 6:
            return f"<div{self.name('bio') or ' class=author-bio'}><p>{s}</p></div>"
        if kind == 7:
            return f"<noscript>{r.choice([self.said('note', 3) + '. ' + s, '<p>' + self.said('note', 4) + '.</p>'])}</noscript>"
        return f"<aside{self.name('side')}><p>{s}</p></aside>"

    def main(self) -> str:
        r, out = self.r, []
        k = " data-keep"
        end = lambda t: f"</{t}>" if t != "p" or r.random() > 0.1 else ""
        first = self.prose(1, r.choice([1, 1, 2, 8])) if r.random() < 0.2 else ""
        if r.random() < 0.85:
            title = self.sentence(1, 12)
            if r.random() < 0.1:
                title = re.sub(r"[<>]", "", self.quoted())[:60]
            elif r.random() < 0.4:  # cut, or repeated
                title = r.choice([title[:60], " ".join(self.words(1) * 20)[:60], title.upper(), self.prose(1, 2)[:60].replace("<", "")])
            if first:  # the text's beginning
                title = re.sub(r"<[^>]*>", "", first)[:60]
            h = f"<h1{k}>{title}</h1>"
            x = r.random()
            out.append(f"<header{k}>{h}</header>" if x < 0.12 else f"<header{self.name('title')}{k}>{h}</header>" if x < 0.2 else f"<div{self.name('title')}{k}>{h}</div>" if x < 0.35 else h)
        if first:
            out.append(f"<p{k}>{first}{end('p')}")
        rich = r.random() < 0.1
        for _ in range(r.choice([0, 0, 0, 1, 2, 5] if first else [0, 1, 1, 2, 3, 5, 8, 12, 20])):
            kind, t = r.random(), "p"
            if kind < 0.72:
                body = self.linked() if rich or r.random() < 0.05 else self.quoted() if r.random() < 0.12 else self.prose(1, r.choice([1, 2, 8]))
            elif kind < 0.8:
                t, body = r.choice(["h2", "h3"]), self.sentence(1, 8)
                if r.random() < 0.2:  # boilerplate's words in a heading, with prose below
                    body = f"{self.said(r.choice([*self.boiler]), 1)} {' '.join(self.words(r.randint(2, 4)))}"
                    out.append(f"<{t}{k}>{body}{end(t)}")
                    t, body = "p", self.prose(1, 3)
            elif kind < 0.88:
                t = r.choice(["ul", "ol"])
                body = "".join(f"<li{k}>{r.choice([self.sentence(2, 14), self.prose(1, 2), self.sentence(2, 14), self.linked()])}</li>" for _ in range(r.randint(2, 6)))
            elif kind < 0.92:
                t, body = "blockquote", f"<p{k}>{self.prose(1, 2) if r.random() < 0.6 else self.quoted()}</p>"
            elif kind < 0.95:
                t, body = "pre", " ".join(self.words(12))
            elif kind < 0.97:
                t = "table"
                body = "".join(f"<tr{k}>" + "".join(f"<td{k}>{' '.join(self.words(2))}</td>" for _ in range(3)) + "</tr>" for _ in range(3))
            elif kind < 0.975:
                t, body = "dl", "".join(f"<dt{k}>{r.choice([self.words(1)[0], self.said(r.choice([*self.boiler]), 1)])}</dt><dd{k}>{self.prose(1, 2)}</dd>" for _ in range(r.randint(1, 4)))
            elif kind < 0.98:
                t, body = "noscript", f"<p{k}>{self.prose(1, 2)}</p>"
            else:
                t, body = "figure", f"<img src=x.png><figcaption{k}>{self.sentence(3, 10)}</figcaption>"
            if t == "p" and r.random() < 0.08:
                t = "div"
            out.append(f"<{t}{k}>{body}{end(t)}")
            if r.random() < 0.05:
                out.append(self.junk())
        return "".join(out)

    def page(self) -> str:
        r, k = self.r, " data-keep"
        text = self.main()
        if r.random() < 0.4:
            text += self.talk() if r.random() < 0.4 else self.junk()
        style = r.random()
        if style < 0.5:
            text = f"<article{self.name('text') if r.random() < 0.5 else ''}{k}>{text}</article>"
        elif style < 0.65:
            text = f"<main{self.name('text') if r.random() < 0.3 else ''}{k}>{text}</main>"
        elif style < 0.9:
            text = f"<div{self.name('text')}{k}>{text}</div>"
        elif style < 0.95:
            text = f"<div{k}>{text}</div>"
        if r.random() < 0.3:
            text = f"<{r.choice(['main', 'section', 'div'])}{k}>{text}" + "".join(self.junk() for _ in range(r.randint(0, 2)))
        for _ in range(r.choice([0, 0, 0, 1, 2])):  # boxes of any name around the article
            text = self.boxed(text)
        before = [self.menu()] + ([self.edge(False)] if r.random() < 0.6 else []) + [self.junk() for _ in range(r.choice([0, 1, 1, 2]))]
        after = [self.junk() for _ in range(r.choice([0, 0, 1, 2, 3]))] + ([self.edge(True)] if r.random() < 0.9 else [])
        r.shuffle(before)
        if r.random() < 0.2:
            before = []
        if r.random() < 0.2:
            after = []
        if r.random() < 0.06:  # no page around it
            return "".join(before[:1]) + text + "".join(after[:1])
        whole = "".join(before) + text + "".join(after)
        for _ in range(r.choice([0, 0, 1, 1, 2])):  # and around the page
            whole = self.boxed(whole)
        ends = r.choice(["</body></html>", "</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title><style>p{{}}</style></head><body{k}>{whole}{ends}"


def marked_pages(pages: int, seed: int) -> list[tuple[Node, list[Node], np.ndarray]]:
    """root, blocks and answers of made pages; the answers aren't part of what is parsed."""
    maker, out = Maker(seed), []
    for _ in range(pages):
        page = maker.page()
        root = parse(page.replace(" data-keep", ""))
        blocks = measure(root)
        answer = {id(x): m for m, x in zip(_marks(page), _all_elements(root), strict=True)}
        out.append((root, blocks, np.array([answer[id(x)] for x in blocks], float)))
    return out


def token_odds(pages: list[tuple[Node, list[Node], np.ndarray]], least: int = 4) -> dict[str, float]:
    """log odds that an element with a token among its names, or a word in its short text or heading, is main text: less for rare
    ones, none for names of one or two letters but those that templates use."""
    known = {t for v in CALLED.values() for t in _TOKEN.findall(v)}
    yes, no = Counter(), Counter()
    for _, blocks, answers in pages:
        for x, keep in zip(blocks, answers, strict=True):
            (yes if keep else no).update({*x.names, *said_words(x), *(said_words(x.title) if x.title else ())})
    seen = {t: yes[t] + no[t] for t in yes.keys() | no.keys() if len(t) > 2 or t in known}
    return {t: round(max(-4.0, min(4.0, math.log((yes[t] + 0.3) / (no[t] + 0.3)))) * n / (n + SHRINK), 4) for t, n in seen.items() if n >= least}


def training_rows(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    """Features, answers, weights and the odds of tokens. A page's own answers aren't in the odds of its features."""
    made = marked_pages(pages, seed)
    halves = [token_odds(made[1::2]), token_odds(made[::2])]
    xs = [features(b, t, halves[k % 2]) for k, (t, b, _) in enumerate(made)]
    ws = [np.array([math.log1p(x.own) if x.own else 3.0 for x in b]) for _, b, _ in made]
    return np.concatenate(xs), np.concatenate([y for *_, y in made]), np.concatenate(ws), token_odds(made)


def _all_elements(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if x is not root:
            order.append(x)
        stack.extend(k for k in reversed(x.kids) if not isinstance(k, str))
    return order


def _marks(page: str) -> list[bool]:
    """Whether each start tag, in page order (which is the tree's order), carries data-keep; raw elements make no node."""
    return [" data-keep" in (m[3] or "") for m in _TAG.finditer(re.sub(r"<(title|style|script)>.*?</\1>", "", page)) if m[2] and not m[1] and m[2].lower() not in RAW]


_MODEL: Boosted | None = None


def trained(spark: SparkSession | None = None) -> Boosted:
    """The trees; trained once a process, or read from the shared folder where another process with this code left them."""
    global _MODEL
    if _MODEL is None:

        def build() -> dict:
            x, y, w, odds = training_rows()
            got = Boosted(odds).fit(x, y, w)
            return {"odds": odds, "bias": got.bias, "feature": got.feature.tolist(), "cut": got.cut.astype(float).tolist(), "value": got.value.tolist()}

        data = kept(spark, "html_trees", __file__, build) if spark else build()
        _MODEL = Boosted(data["odds"])
        _MODEL.bias, _MODEL.feature = data["bias"], np.array(data["feature"], np.int32)
        _MODEL.cut, _MODEL.value = np.array(data["cut"], np.float32), np.array(data["value"])
    return _MODEL


def extract_pages(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(trained(spark))  # TREES small trees and the odds of the made pages' tokens
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("body"))

    def run(batches):
        for b in batches:
            texts: list[str] = []
            for lo in range(0, b.num_rows, 200):
                texts += extract([x.as_py() or "" for x in b.column("body").slice(lo, 200)], held.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
