"""HTML extraction: gradient-boosted trees over DOM nodes, decoded so that no node contradicts its ancestors.

Every element and every run of text is a node with features of its subtree (text, link and tag density), its attribute
tokens, its depth and its siblings. Trees give each node three log-odds: its subtree is article text throughout, it is
boilerplate throughout, or it holds both. Decoding picks the best labelling of the tree in which everything below an
article node is article and everything below a boilerplate node is boilerplate.

The trees are fitted here, on at most ``MAX_PAGES`` pages of the table (those of least hash, of fewer than ``MAX_CHARS``
characters). Their own article
elements are the examples; since a site may mark its parts otherwise, every such page is also rebuilt with other
containers and class names and with parts that the page lacks (side bars, notices, forms, comments), filled from other
sentences of the sample.

Text: character references decoded, white space inside a block made one space, blocks in page order joined by two
newlines. Scripts, styles and the head never count.

Edge cases: a null, empty or text-free page gives the empty text and 0; unclosed and stray tags are repaired; pages of
any length are read whole; repeated rows are treated alike; an empty table gives an empty result (and an empty model,
for which all text counts but that in the elements of menus, headers, footers, side bars, forms and dialogs); other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices

#: Bounds of what is learned from: pages, and characters of a page.
MAX_PAGES, MAX_CHARS = 150, 200_000
ROUNDS, DEPTH, RATE, BINS = 20, 4, 0.4, 32

# Element kinds of the markup language, and tokens that sites use in class and id names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style head title template svg iframe select option datalist textarea button".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
APART = set("nav header footer aside form dialog menu".split())
TAG_GROUPS = (
    "article main", "section div", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dd dt", "nav", "header hgroup", "footer", "aside",
    "form fieldset label input", "a", "b i em strong span u small code mark sub sup q cite", "table tbody thead tfoot tr td th", "figure figcaption", "body html", "#text", "dialog details summary",
)
GOOD_TOKENS = set("article body content entry main post story text page hentry blog prose articlebody".split())
BAD_TOKENS = set(
    "ad ads adv advert advertisement advertising banner bar breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback foot footer "
    "footnav form head header hidden legal links login masthead menu menubar meta modal nav navbar navigation newsletter notice notices pagination popup "
    "promo promotion recommended related replies reply respond search share sharing shop side sidebar signup skip social sponsor sponsored subscribe "
    "tags teaser toolbar topbar widget widgets".split()
)
_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_WORDS = re.compile(r"[a-z]+")
ARTICLE, BOILER, BOTH = range(3)


@dataclass(slots=True)
class Node:
    tag: str
    tokens: tuple[str, ...] = ()
    parent: int = -1
    text: str = ""
    silent: bool = False
    children: list[int] = field(default_factory=list)


#: What an opening tag closes, and the elements that it doesn't look beyond; last, what an end tag doesn't look beyond.
_SCOPES = {
    "p": ({"p"}, {"td", "th", "button", "table", "body"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}), "head": ({"head"}, set()), "#block": ({"article", "main", "body", "section", "div", "td", "nav", "footer", "aside"}, set()), "#body": ({"body"}, set()),
}
_PLACE = {name: i for i, name in enumerate(_SCOPES)}


class _Builder(HTMLParser):
    """A flat list of nodes in page order; children follow their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root")]
        self.open = [0]
        self.near = [(0,) * len(_SCOPES)]  # by open element and scope: the nearest open element that a tag closes, 0 if none
        self.at: dict[str, list[int]] = {}  # places of open elements by tag

    def _add(self, node: Node) -> int:
        node.parent = self.open[-1]
        node.silent = node.silent or self.nodes[node.parent].silent
        self.nodes.append(node)
        self.nodes[node.parent].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def _cut(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        for at in self.open[place:]:
            self.at[self.nodes[at].tag].pop()
        del self.open[place:], self.near[place:]

    def _close(self, scope: str) -> None:
        if place := self.near[-1][_PLACE[scope]]:
            self._cut(place)

    def _push(self, at: int) -> None:
        tag, place = self.nodes[at].tag, len(self.open)
        self.near.append(tuple(place if tag in tags else 0 if tag in until else near for (tags, until), near in zip(_SCOPES.values(), self.near[-1], strict=True)))
        self.at.setdefault(tag, []).append(place)
        self.open.append(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag not in ("td", "th"):
            self._close("p")
        if tag == "li":
            self._close("li")
        elif tag in ("dd", "dt"):
            self._close("dd")
        elif tag in ("tr", "td", "th"):
            self._close("td")
            if tag == "tr":
                self._close("tr")
        elif tag == "option":
            self._close("option")
        elif tag == "body":
            self._close("head")
        values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        hidden = any(k == "hidden" for k, _ in attrs)
        at = self._add(Node(tag, tuple(_WORDS.findall(values.lower())) + (("hidden",) if hidden else ()), silent=tag in SILENT))
        if tag not in VOID:
            self._push(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        place = self.at[tag][-1] if self.at.get(tag) else 0
        around = 0 if tag in ("body", "html") else self.near[-1][_PLACE["#body" if tag in BLOCK else "#block"]]
        if place and place >= around:
            self._cut(place)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add(Node("#text", text=data))
        elif data and self.nodes[self.open[-1]].children:
            self._add(Node("#space", text=" "))


def parse(html: str) -> list[Node]:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.nodes


N_FEATURES = 30
_AROUND = {0: 0, 6: 1, 7: 1, 8: 1, 9: 1, 4: 2, 10: 3}
_FLAG = {0: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 6}


def features(nodes: list[Node]) -> np.ndarray:
    """(nodes, N_FEATURES); the root's row is there too. One pass down for what lies above a node, one up for sums."""
    n = len(nodes)
    up = [max(x.parent, 0) for x in nodes]
    group = [_GROUP.get(x.tag, len(TAG_GROUPS)) for x in nodes]
    chars, linked, words, tags, paragraphs, stops = ([0] * n for _ in range(6))
    good, bad, depth, under_link = [0] * n, [0] * n, [0] * n, [False] * n
    inside_good, inside_bad, before = [0] * n, [0] * n, [0] * n
    around = [(0, 0, 0, 0)] * n  # containers above: article, nav/header/footer/aside, list, form
    place, siblings, alike = [0] * n, [0] * n, [0] * n
    passed = 0
    for i, x in enumerate(nodes):
        tag, p = x.tag, up[i]
        if x.tokens:
            good[i], bad[i] = sum(t in GOOD_TOKENS for t in x.tokens), sum(t in BAD_TOKENS for t in x.tokens)
        before[i] = passed
        if i:
            depth[i] = depth[p] + 1
            under_link[i] = under_link[p] or tag == "a"
            inside_good[i], inside_bad[i] = inside_good[p] + good[p], inside_bad[p] + bad[p]
            g = group[p]
            around[i] = around[p] if g not in _AROUND else tuple(a + (k == _AROUND[g]) for k, a in enumerate(around[p]))
        if tag == "#text":
            passed += len(x.text)
            if not x.silent:
                chars[i] = len(x.text.strip())
                words[i] = x.text.count(" ") + 1
                stops[i] = x.text.count(".") + x.text.count("!") + x.text.count("?")
                linked[i] = chars[i] if under_link[i] else 0
        elif tag[0] != "#":
            tags[i] = 1
            paragraphs[i] = tag == "p"
        if x.children:
            kinds: dict[int, int] = {}
            for c in x.children:
                kinds[group[c]] = kinds.get(group[c], 0) + 1
            for k, c in enumerate(x.children):
                place[c], siblings[c], alike[c] = k, len(x.children), kinds[group[c]]
    below_good, below_bad, below_parts = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = up[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
        stops[p] += stops[i]
        below_good[p] += below_good[i] + good[i]
        below_bad[p] += below_bad[i] + bad[i]
        below_parts[p] += below_parts[i] + (group[i] in (6, 8, 9, 10))
    c, w, pa_, parent, g = (np.array(v, float) for v in (chars, words, paragraphs, up, group))
    parent = parent.astype(np.int64)
    total = max(chars[0], 1)
    rank = np.array([_FLAG.get(k, 0) for k in group], float)
    return np.column_stack(
        [
            g, g[parent], depth, np.log1p(c), np.log1p(w), c / total, np.array(linked) / np.maximum(c, 1), c / np.maximum(tags, 1),
            pa_, np.array(stops) / np.maximum(w, 1), w / np.maximum(pa_, 1), good, bad, inside_good, inside_bad, below_good, below_bad, below_parts,
            np.array(around, float).reshape(n, 4), place, siblings, alike, np.array(before) / max(passed, 1), c[parent] / total, c / np.maximum(c[parent], 1), rank > 0, rank,
        ]
    )


# ---- gradient-boosted trees ----


@dataclass
class Trees:
    """Per class a list of trees; a tree is (feature, threshold, left, right, value) as arrays, leaves have left -1."""

    base: np.ndarray
    trees: list[list[tuple[np.ndarray, ...]]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for turn in self.trees:
            for k, (which, cut, left, right, value) in enumerate(turn):
                at = np.zeros(len(x), np.int64)
                for _ in range(DEPTH):
                    inner = left[at] >= 0
                    go = x[np.arange(len(x)), which[at]] <= cut[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                out[:, k] += value[at]
        return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, ...]:
    which, cut, left, right, value = [0], [0.0], [-1], [-1], [0.0]
    open_ = [(0, np.arange(len(g)), 0)]
    while open_:
        node, rows, level = open_.pop()
        sg, sh = g[rows].sum(), h[rows].sum()
        value[node] = -RATE * sg / (sh + l2)
        if level == DEPTH or len(rows) < 8:
            continue
        best = (1e-6, -1, -1)
        for f in range(binned.shape[1]):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            cg = np.cumsum(np.bincount(b, g[rows], len(edges[f]) + 1))[:-1]
            ch = np.cumsum(np.bincount(b, h[rows], len(edges[f]) + 1))[:-1]
            gain = cg**2 / (ch + l2) + (sg - cg) ** 2 / (sh - ch + l2) - sg**2 / (sh + l2)
            gain[(ch < 1e-3) | (sh - ch < 1e-3)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            continue
        _, f, k = best
        go = binned[rows, f] <= k
        which[node], cut[node], left[node], right[node] = f, float(edges[f][k]), len(which), len(which) + 1
        for part in (rows[go], rows[~go]):
            open_.append((len(which), part, level + 1))
            which.append(0)
            cut.append(0.0)
            left.append(-1)
            right.append(-1)
            value.append(0.0)
    return np.array(which), np.array(cut), np.array(left), np.array(right), np.array(value)


def boost(x: np.ndarray, y: np.ndarray, classes: int = 3) -> Trees:
    """Softmax boosting with second-order leaves on binned features."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        cuts = values[:-1] if len(values) <= BINS else np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS))
        edges.append(cuts[cuts < values[-1]])
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    truth = np.eye(classes)[y]
    base = np.log(np.maximum(truth.mean(axis=0), 1e-3))
    score, turns = np.tile(base, (len(x), 1)), []
    for _ in range(ROUNDS):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        turn = []
        for k in range(classes):
            tree = _tree(binned, edges, p[:, k] - truth[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6))
            turn.append(tree)
        one = Trees(np.zeros(classes), [turn])
        score += one.scores(x)
        turns.append(turn)
    return Trees(base, turns)


# ---- decoding ----


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The label of every node in the best labelling without contradictions, from log probabilities (nodes, 3)."""
    n = len(nodes)
    article, boiler, mixed = (score[:, k].tolist() for k in (ARTICLE, BOILER, BOTH))
    for i in range(n - 1, 0, -1):
        # By now these hold the sums over i's children as well.
        if not nodes[i].children:
            mixed[i] = -np.inf
        p = nodes[i].parent
        article[p] += article[i]
        boiler[p] += boiler[i]
        mixed[p] += max(article[i], boiler[i], mixed[i])
    label = [BOTH] * n
    for i, x in enumerate(nodes):
        above = label[x.parent] if i else BOTH
        own = (article[i], boiler[i], mixed[i])
        label[i] = above if above != BOTH else own.index(max(own))
    return np.array(label)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def text_of(nodes: list[Node], label: np.ndarray) -> str:
    """Blocks of the text nodes labelled as article."""
    blocks: list[list[str]] = []
    block_of = np.zeros(len(nodes), np.int64)
    last = -1
    cut = False
    for i, x in enumerate(nodes):
        p = max(x.parent, 0)
        block_of[i] = i if x.tag in BLOCK else block_of[p]
        if x.tag == "br":
            if blocks:
                blocks[-1].append(" ")
            continue
        if x.tag in BLOCK:
            cut = True
        if x.tag[0] == "#" and x.text and not x.silent and label[i] == ARTICLE:
            if x.tag == "#space" and not blocks:
                continue
            own = int(block_of[i])
            if not blocks or own != last or cut:
                blocks.append([])
            last, cut = own, False
            blocks[-1].append(x.text)
    whole = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in whole if b)


# ---- learning ----


def _truth(nodes: list[Node]) -> np.ndarray | None:
    """Labels from a page's own marks: text under an article (or else main) element, outside the parts in it that are
    no article text; None if the page has no such element."""
    kinds = {x.tag for x in nodes}
    root = "article" if "article" in kinds else "main" if "main" in kinds else None
    if not root:
        return None
    n = len(nodes)
    inside, article, other = np.zeros(n, bool), np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        p = max(x.parent, 0)
        out = x.tag in ("nav", "footer", "aside", "form", "header") or bool(BAD_TOKENS & set(x.tokens))
        inside[i] = (inside[p] or x.tag == root) and not (out and inside[p])
        if x.tag == "#text" and not x.silent:
            (article if inside[i] else other)[i] = len(x.text)
    for i in range(n - 1, 0, -1):
        article[nodes[i].parent] += article[i]
        other[nodes[i].parent] += other[i]
    label = np.where((article > 0) & (other > 0), BOTH, np.where(article > 0, ARTICLE, BOILER))
    empty = (article == 0) & (other == 0)
    label[empty & inside] = ARTICLE
    return label


def _rebuilt(paragraphs: list[str], sentences: list[str], r: random.Random) -> tuple[str, list[str]]:
    """A page of the given article paragraphs in other containers, with parts around and inside it; and its article."""
    pick = lambda k: [escape(r.choice(sentences)) for _ in range(k)]
    item = lambda s: f'<li><a href="#">{s[:24]}</a></li>'

    def part(tag: str, names: str, inner: str) -> str:
        name = r.choice(names.split())
        mark = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(names.split())}"'])
        semantic = tag not in ("div", "section")
        return f"<{tag}{'' if semantic and r.random() < 0.6 else mark}>{inner}</{tag}>"

    def menu() -> str:
        return part(r.choice(["nav", "div", "ul", "header"]), "menu navbar navigation topbar nav breadcrumb", "<ul>" + "".join(map(item, pick(r.randint(3, 8)))) + "</ul>")

    def noise() -> str:
        s = pick(r.randint(1, 4))
        plain = "".join(f"<p>{x}</p>" for x in s)
        return r.choice(
            [
                lambda: part(r.choice(["aside", "div", "section"]), "sidebar side widget related recommended", r.choice([f"<h3>{s[0][:30]}</h3>", ""]) + r.choice([plain, "<ul>" + "".join(map(item, s)) + "</ul>"])),
                lambda: part("div", "cookie notice consent banner popup legal", r.choice([plain, s[0]])),
                lambda: part("div", "ad ads advert sponsored promo", r.choice([plain, s[0]])),
                lambda: part(r.choice(["form", "div"]), "newsletter subscribe signup search login form", f"<label>{s[0][:40]}</label><input type='text'><button>{s[0][:8]}</button>" + r.choice(["", f"<p>{s[-1]}</p>"])),
                lambda: part(r.choice(["section", "div"]), "comments replies respond disqus", f"<h3>{s[0][:20]}</h3>" + "".join(r.choice([f'<div class="comment"><p>{x}</p></div>', f"<div class='reply'><b>{x[:9]}</b> {x}</div>", f'<article class="comment"><p>{x}</p></article>']) for x in s)),
                lambda: part("div", "share social tags meta toolbar pagination", "".join(f'<a href="#">{x[:12]}</a> ' for x in s)),
            ]
        )()

    body = []
    for k, p in enumerate(paragraphs):
        tag = r.choice(["h1", "h1", "h2"]) if not k and len(p) < 200 else r.choice(["p"] * 8 + ["blockquote", "h2", "div", "pre", "li"])
        inner = escape(p)
        if r.random() < 0.2 and " " in inner:
            a, b = inner.split(" ", 1)
            inner = r.choice([f"<b>{a}</b> {b}", f'{a} <a href="#">{b[:20]}</a>{b[20:]}', f"<em>{a} {b}</em>"])
        body.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
        if r.random() < 0.08:
            body.append(noise())
    inner = "".join(body) + (noise() if r.random() < 0.4 else "")
    if r.random() < 0.3:
        inner = f'<div class="{r.choice(["content", "entry-content", "text", "inner", "body"])}">{inner}</div>'
    main = part(r.choice(["article", "main", "div", "section", "div"]), "content article post entry main story post-content article-body wrapper", inner)
    top = r.choice(["", part("header", "header masthead", f"<h2>{pick(1)[0][:40]}</h2>" + r.choice(["", menu()]))])
    extra = [noise() for _ in range(r.randint(0, 4))]
    where = r.randint(0, len(extra))
    foot = part(r.choice(["footer", "div"]), "footer foot legal", r.choice([f"&copy; {pick(1)[0]}", f"<p>{pick(1)[0]}</p>", "<ul>" + "".join(map(item, pick(3))) + "</ul>"]))
    middle = "".join(extra[:where]) + main + "".join(extra[where:])
    if r.random() < 0.5:
        middle = f'<div class="{r.choice(["page", "container", "wrapper", "row", "layout"])}">{middle}</div>'
    return f"<html><head><title>x</title></head><body>{top}{r.choice([menu(), ''])}{middle}{r.choice([foot, foot, ''])}</body></html>", paragraphs


def examples(pages: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the pages and of their rebuilt forms."""
    r = random.Random(seed)
    known = []
    for html in pages:
        nodes = parse(html)
        label = _truth(nodes)
        if label is not None:
            known.append((nodes, label))
    sentences = [s for nodes, _ in known for x in nodes if x.tag == "#text" and not x.silent for s in [" ".join(x.text.split())[:160]] if s]
    xs, ys = [], []
    for nodes, label in known:
        xs.append(features(nodes))
        ys.append(label)
        paragraphs = [b for b in text_of(nodes, np.where(label == BOTH, BOTH, label)).split("\n\n") if b]
        for _ in range(2 if paragraphs else 0):
            mine = paragraphs[: r.randint(1, len(paragraphs))] if r.random() < 0.5 else paragraphs
            html, kept = _rebuilt(mine, sentences, r)
            other = parse(html)
            want = {" ".join(k.split()) for k in kept}
            # The rebuilt article is what the marked paragraphs hold; find each block's text among them.
            x = features(other)
            xs.append(x)
            ys.append(_labels_by_text(other, want))
    if not xs:
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
    return np.concatenate(xs), np.concatenate(ys)


def _labels_by_text(nodes: list[Node], wanted: set[str]) -> np.ndarray:
    """Labels of a rebuilt page: an element whose whole text is a wanted paragraph is article text."""
    n = len(nodes)
    whole = [x.text if x.tag[0] == "#" and not x.silent else "" for x in nodes]
    for i in range(n - 1, 0, -1):
        whole[nodes[i].parent] = whole[i] + whole[nodes[i].parent]
    article, other, hit = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i, x in enumerate(nodes):
        hit[i] = bool(i and hit[x.parent]) or " ".join(whole[i].split()) in wanted
        if x.tag == "#text" and not x.silent:
            (article if hit[i] else other)[i] = len(x.text)
    for i in range(n - 1, 0, -1):
        article[nodes[i].parent] += article[i]
        other[nodes[i].parent] += other[i]
    label = np.where((article > 0) & (other > 0), BOTH, np.where(article > 0, ARTICLE, BOILER))
    for i, x in enumerate(nodes):
        if i and article[i] == 0 and other[i] == 0 and label[x.parent] == ARTICLE:
            label[i] = ARTICLE
    return label


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> Trees | None:
    """Trees fitted on a bounded sample of pages of fewer than ``max_chars`` characters; None if no page marks its
    article. All pages, of any length, are extracted whole."""
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[ >]")).filter(F.length("html") < max_chars)
    hashed = marked.select("html", F.xxhash64("html").alias("o"))
    # Tasks send the driver hashes to choose from, then only the chosen pages.
    last = hashed.select("o").distinct().orderBy("o").limit(max_pages).agg(F.max("o")).first()[0]
    rows = hashed.filter(F.col("o") <= last).dropDuplicates(["o"]).orderBy("o").collect() if last is not None else []
    x, y = examples([r["html"] for r in rows])
    return boost(x, y) if len(x) else None


def _unmarked(nodes: list[Node]) -> np.ndarray:
    """Labels without trees and without an article element: boilerplate are the elements that are so by name."""
    label = np.full(len(nodes), BOTH)
    for i, x in enumerate(nodes):
        if i and label[x.parent] == BOILER or x.tag in APART:
            label[i] = BOILER
        elif x.tag == "#text":
            label[i] = ARTICLE
    return label


def extract(htmls: list[str | None], trees: Trees | None) -> list[str]:
    every = [parse(h or "") for h in htmls]
    if trees is None:
        return [text_of(nodes, label if (label := _truth(nodes)) is not None else _unmarked(nodes)) for nodes in every]
    score = _log_softmax(trees.scores(np.concatenate([features(nodes) for nodes in every]))) if every else np.zeros((0, 3))
    ends = np.cumsum([len(nodes) for nodes in every])
    return [text_of(nodes, decode(nodes, score[e - len(nodes) : e])) for nodes, e in zip(every, ends, strict=True)]


def apply(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """page_id, url, text, n_chars, one row for each row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            texts = extract(batch.column("html").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
