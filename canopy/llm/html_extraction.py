"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with runs of text as leaves. Each node is content or not: its own potential is a
linear score of features (tag, words in class and id, link density, length, punctuation), and each edge has a potential
for the labels of parent and child, by the kind of edge. Sum-product messages run up and down the tree and give exact marginals; leaves with a
marginal of one half or more are the text. Node weights and edge potentials are trained together, by the likelihood of whole labelled
trees, whose gradient is what the marginals say less what the labels say: a generator here writes pages of
several layouts with the label of every block. Pages are independent, so a page is one row's work and nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from canopy.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# fixed values of HTML
RAW = frozenset("script style title textarea noscript template iframe".split())
CONTROLS = frozenset("button select".split())  # their text is a form's; a block that starts ends them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
# features: tags by role, and words of class, id and role attributes
ROLES = [
    ("article", "article main"), ("paragraph", "p blockquote pre"), ("heading", "h1 h2 h3 h4 h5 h6"), ("nav", "nav menu"), ("aside", "aside"), ("footer", "footer"), ("header", "header"),
    ("form", "form fieldset legend dialog"), ("list", "ul ol dl"), ("item", "li dt dd"), ("table", "table tbody thead tr td th"), ("figure", "figure figcaption"), ("generic", "div section center"), ("root", "html body #root"),
]
GOOD = "article content main post entry story text body prose page"
BAD = "ad ads advert advertisement banner sponsor promo menu nav navigation navbar breadcrumb breadcrumbs footer header masthead sidebar aside rail widget comment comments discussion reply respond cookie cookies consent notice alert gdpr popup modal overlay share sharing social related recommended newsletter subscribe signup login form search copyright legal pagination pager tags byline skip toolbar contentinfo complementary"
ROLE_OF = {t: i for i, (_, tags) in enumerate(ROLES) for t in tags.split()}
GOOD_WORDS, BAD_WORDS = frozenset(GOOD.split()), frozenset(BAD.split())
#: Stands before each content block of a labelled page.
MARK = "\ue000"
Edges = tuple[tuple[float, ...], ...]
N_FEATURES = 2 * len(ROLES) + 11


class Node:
    __slots__ = ("tag", "up", "good", "bad", "chars", "linked", "parts", "leaf")

    def __init__(self, tag: str, up: int, attributes: str = "", leaf: bool = False):
        self.tag, self.up, self.leaf, self.chars, self.linked, self.parts = tag, up, leaf, 0, 0, []
        self.good = self.bad = False
        if attributes:
            said = re.split(r"[^a-z]+", " ".join(x.strip("\"'") for x in ATTRIBUTE.findall(attributes)).lower())
            self.good, self.bad = not GOOD_WORDS.isdisjoint(said), not BAD_WORDS.isdisjoint(said)


def parse(page: str) -> list[Node]:
    """Block elements and runs of text, parents first, in page order. Unclosed and stray tags are taken as browsers do; an end tag costs what it closes."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # inline elements refer to their block
    blocks: dict[str, int] = {}  # open blocks by name
    inline: list[dict[str, int]] = [{}]  # for each open block, the inline elements open in it by name
    leaf, links, controls, at = -1, 0, 0, 0

    def text(raw: str) -> None:
        nonlocal leaf
        if controls or not raw or (leaf < 0 and raw.isspace()):
            return
        if leaf < 0:
            leaf = len(nodes)
            nodes.append(Node(nodes[stack[-1][1]].tag, stack[-1][1], leaf=True))
        n, said = nodes[leaf], entities.unescape(raw) if "&" in raw else raw  # a reference ends where a tag starts
        n.parts.append(said)
        n.chars += len(said)
        n.linked += len(said) if links else 0

    def pop(to: int) -> None:
        nonlocal leaf, links, controls
        for name, _ in reversed(stack[to:]):
            if name not in BLOCK:
                links -= name == "a"
                controls -= name in CONTROLS
                inline[-1][name] -= 1
            else:
                leaf = -1
                blocks[name] -= 1
                inline.pop()
        del stack[to:]

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if inline[-1].get(tag, 0) if tag not in BLOCK else blocks.get(tag, 0):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
            elif tag == "p":
                leaf = -1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                leaf = -1
            elif tag == "br":
                text(" ")
            continue
        if tag not in BLOCK:
            foreign = tag in ("svg", "math") or inline[-1].get("svg") or inline[-1].get("math")
            if not (foreign and m[3].rstrip().endswith("/")):
                links += tag == "a"
                controls += tag in CONTROLS
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
                stack.append((tag, stack[-1][1]))
            continue
        leaf = -1
        if controls and any(inline[-1].get(c) for c in CONTROLS):
            pop(next(k for k in range(len(stack)) if stack[k][1] == stack[-1][1] and stack[k][0] in CONTROLS))
        ends = CLOSES.get(tag, set())
        if blocks.get("p") or any(blocks.get(x) for x in ends):
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the one before it
                name = stack[k][0]
                if name == "p" or name in ends:
                    pop(k)
                    break
                if name in BLOCK and (not ends or name in HOLDS.get(tag, ())):
                    break
        nodes.append(Node(tag, stack[-1][1], m[3]))
        stack.append((tag, len(nodes) - 1))
        blocks[tag] = blocks.get(tag, 0) + 1
        inline.append({})
    text(page[at:])
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].up] += chars[i]
        linked[nodes[i].up] += linked[i]
    x = np.zeros((len(nodes), N_FEATURES))
    k = 2 * len(ROLES)
    for i, n in enumerate(nodes):
        x[i, ROLE_OF.get(n.tag, len(ROLES) - 2) + (len(ROLES) if n.leaf else 0)] = 1
        c, share = chars[i], linked[i] / chars[i] if chars[i] else 0.0
        end = next((p.rstrip()[-1:] for p in reversed(n.parts) if p.strip()), "") if n.leaf else ""
        x[i, k:] = (1, n.good, n.bad, share, share > 0.5, c == 0, c < 25, c > 80, c > 250, end in ".!?\"'”…:;" and end != "", n.leaf)
    return x


def edge_type(nodes: list[Node], i: int) -> int:
    """A run of text in its block; an element in an article; any other element."""
    return 0 if nodes[i].leaf else 1 if nodes[nodes[i].up].tag in ("article", "main") or nodes[nodes[i].up].good else 2


def log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], own: list[float], edges: Edges) -> list[float]:
    """Log odds of content for each node, from own log odds and log potentials by edge_type, for (parent, child) = 00, 01, 10, 11."""
    kind = [edges[edge_type(nodes, i)] if i else edges[0] for i in range(len(nodes))]
    belief, sent = list(own), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        b, (p00, p01, p10, p11) = belief[i], kind[i]
        sent[i] = log_sum(p11 + b, p10) - log_sum(p01 + b, p00)
        belief[nodes[i].up] += sent[i]
    for i in range(1, len(nodes)):
        rest, (p00, p01, p10, p11) = belief[nodes[i].up] - sent[i], kind[i]
        belief[i] += log_sum(p11 + rest, p01) - log_sum(p10 + rest, p00)
    return belief


def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Pages whose content is marked by MARK at the start of each content block; several layouts, with noise outside and inside the article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeionrtslcd") for _ in range(r.randint(1, 9)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=30: say(a, b).capitalize() + r.choice("....!?")
    much = lambda: " ".join(sentence(1, 25) for _ in range(r.choice([1, 1, 2, 4, 8])))
    C = MARK

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 2)}</a></li>' for _ in range(k)) + "</ul>"

    def noise() -> str:
        c = r.choice(["ad", "ads banner", "advert", "promo", "share-bar social", "related-posts", "cookie-notice", "newsletter subscribe", "breadcrumbs", "widget", "login form", "notice"])
        return r.choice([f'<div class="{c}">{much()}</div>', f'<div class="{c}"><p>{much()}</p><p>{much()}</p></div>', f'<div id="{c.split()[0]}">{links(3)}</div>', f"<aside><h3>{say(1, 3)}</h3><p>{much()}</p></aside>", f"<form><label>{say(1, 2)}</label><input><p>{much()}</p></form>", f"<nav>{links(r.randint(1, 9))}</nav>"])

    def comments() -> str:
        c = r.choice(["comments", "comment-list", "discussion", "replies comments"])
        return f'<{(t := r.choice(["div", "section"]))} class="{c}"><h3>{say(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{much()}</p></div>' for _ in range(r.randint(1, 5))) + f"</{t}>"

    def article() -> str:
        out = [f"<h1>{C}{r.choice([say, sentence])(1, 14)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 9, 20])):
            k = r.random()
            if k < 0.7:
                body = much() if r.random() < 0.8 else say(1, 90)
                out.append(f"<p>{C}{body}" + r.choice(["</p>", "</p>", ""]))
            elif k < 0.78:
                out.append(f"<p><b>{C}{say(1, 12)}.<br>")
            elif k < 0.84:
                out.append(f"<h{(h := r.randint(2, 4))}>{C}{r.choice([say, sentence])(1, 9)}</h{h}>")
            elif k < 0.89:
                out.append("<ul>" + "".join(f"<li>{C}{r.choice([say, sentence])(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote>{C}{much()}</blockquote>")
            elif k < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{C}{say(1, 3)}</td><td>{C}{say(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.96:
                out.append(f'<p>{C}{say(2, 6)} <a href="/x">{say(1, 9)}</a> {say(1, 6)}.</p>')
            else:
                out.append(noise())
        if r.random() < 0.15:
            out.append(comments())
        return "".join(out)

    pages = []
    for _ in range(n):
        top = r.choice([f"<nav>{links(r.randint(2, 9))}</nav>", f"<header><h2>{say(1, 3)}</h2><p>{much()}</p><nav>{links(4)}</nav></header>", f'<div id="header"><p>{much()}</p></div><div class="menu">{links(5)}</div>', ""])
        if r.random() < 0.7:
            top += noise()
        main = article()
        main = r.choice([f"<article>{main}</article>", f"<article>{main}</article>", f"<main><article>{main}</article></main>", f'<div class="content">{main}</div>', f'<div id="main"><div class="post">{main}</div></div>', f"<div><div>{main}</div></div>", f'<section class="entry">{main}</section>', main])
        side = r.choice(["", "", f"<aside>{links(4)}<p>{much()}</p></aside>", f'<div class="sidebar"><h4>{say(1, 2)}</h4>{links(3)}</div>', noise()])
        after = comments() if r.random() < 0.3 else ""
        foot = r.choice([f"<footer>&copy; {word()}.com &middot; {much()}</footer>", f"<footer><p>{much()}</p>{links(3)}</footer>", f'<div class="footer">{much()}</div>', ""])
        pages.append(f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title></head><body>{top}{main}{side}{after}{foot}" + r.choice(["</body></html>", ""]))
    return pages


def forest_marginals(own: np.ndarray, up: np.ndarray, kind: np.ndarray, levels: list[np.ndarray], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """marginals for many trees at once, level by level: log odds of each node, and for each node the joint probabilities of (parent, own) label 00, 01, 10, 11 (roots: zeros)."""
    belief, sent = own.copy(), np.zeros_like(own)
    for at in reversed(levels[1:]):
        b, (p00, p01, p10, p11) = belief[at], edges[kind[at]].T
        sent[at] = np.logaddexp(p11 + b, p10) - np.logaddexp(p01 + b, p00)
        np.add.at(belief, up[at], sent[at])
    below, joint = belief.copy(), np.zeros((len(own), 4))
    for at in levels[1:]:
        rest, (p00, p01, p10, p11) = belief[up[at]] - sent[at], edges[kind[at]].T
        belief[at] += np.logaddexp(p11 + rest, p01) - np.logaddexp(p10 + rest, p00)
        logs = np.stack([p00, p01 + below[at], p10 + rest, p11 + rest + below[at]], axis=1)
        joint[at] = np.exp(logs - logs.max(axis=1, keepdims=True))
        joint[at] /= joint[at].sum(axis=1, keepdims=True)
    return belief, joint


def labelled_forest(n_pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """features, labels, parents, edge types and levels of the nodes of labelled pages. An element's label is that of most of its text."""
    xs, ys, ups, kinds, depths = [], [], [], [], []
    for page in labelled_pages(n_pages):
        nodes, first = parse(page), len(ys)
        good, every, depth = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
        for i, n in enumerate(nodes):
            depth[i] = depth[n.up] + 1 if i else 0
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].leaf:
                every[i] = nodes[i].chars
                good[i] = every[i] if MARK in "".join(nodes[i].parts) else 0
                nodes[i].parts = [p.replace(MARK, "") for p in nodes[i].parts]
            if i:
                good[nodes[i].up] += good[i]
                every[nodes[i].up] += every[i]
        xs.append(features(nodes))
        ys += [int(2 * g > e) for g, e in zip(good, every, strict=True)]
        ups += [n.up + first for n in nodes]
        kinds += [edge_type(nodes, i) if i else 0 for i in range(len(nodes))]
        depths += depth
    deep = np.array(depths)
    return np.concatenate(xs), np.array(ys, dtype=float), np.array(ups), np.array(kinds), [np.flatnonzero(deep == d) for d in range(deep.max() + 1)]


@lru_cache(maxsize=1)
def fit(n_pages: int = 240, steps: int = 150, l2: float = 1e-3) -> tuple[list[float], Edges]:
    """Weights of the node features and log potentials of the edges: both at once the likeliest for labelled trees, less a penalty on their squares."""
    x, y, up, kind, levels = labelled_forest(n_pages)
    child, label = np.concatenate(levels[1:]), y.astype(int)
    seen = np.zeros((3, 4))
    np.add.at(seen, (kind[child], 2 * label[up[child]] + label[child]), 1.0)
    w = [np.zeros(x.shape[1]), np.zeros((3, 4))]
    moment, scale = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for t in range(1, steps + 1):  # Adam
        belief, joint = forest_marginals(x @ w[0], up, kind, levels, w[1])
        expected = np.zeros((3, 4))
        np.add.at(expected, kind[child], joint[child])
        for k, g in enumerate((x.T @ (1 / (1 + np.exp(-belief)) - y), expected - seen)):
            g = g / len(y) + l2 * w[k]
            moment[k], scale[k] = 0.9 * moment[k] + 0.1 * g, 0.99 * scale[k] + 0.01 * g * g
            w[k] = w[k] - 0.1 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(scale[k] / (1 - 0.99**t)) + 1e-8)
    return w[0].tolist(), tuple(tuple(v) for v in w[1].tolist())


def main_text(page: str, weights: np.ndarray, edges: Edges) -> str:
    nodes = parse(page)
    belief = marginals(nodes, (features(nodes) @ weights).tolist(), edges)
    blocks = (" ".join("".join(n.parts).split()) for n, b in zip(nodes, belief, strict=True) if n.leaf and b >= 0)
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text; empty if none), n_chars for each row of pages. A null html is an empty page; equal rows get equal results; other columns are not read."""
    weights, edges = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for b in batches:
            found = [main_text(h.as_py(), w, edges) if h.is_valid and h.as_py() else "" for h in b.column(2)]
            # ids stay as Arrow has them: pandas would round large ones beside nulls
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    return extract(table(spark, sf_dir, "pages"))
