"""Main text of web pages by a tree-structured graphical model.

Every element of a page's tree is a variable, content or not. A node's potential weighs its tag, the
kinds named by it and above it, and its text; an edge's potential weighs the four states of a parent and
its child, by the child's sort. Sum-product messages go up from the leaves and down again and give every
node its exact marginal, for all pages of a batch at once, level by level. The weights maximise the
likelihood of labelled pages, whose gradient is made of the same marginals.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.shared import small_batches
from quillmill.llm.labelled_pages import PAGES
from quillmill.llm.html_tree import BIT, GROUPS, INLINE, TAG, TAGS, Page

KINDS = len(GROUPS)
#: bias, tags, own kinds, kinds above, and numbers
SIZE = 1 + len(TAGS) + 2 * KINDS + 4
SORTS = 3
BY_HAND = 6
_SORT = np.array([0 if t in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dt", "dd", "td", "th") else 2 if t in INLINE else 1 for t in TAGS])


class Forest:
    """The nodes of several pages as arrays."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = lambda name: np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, int(self.first[-1]))
        base = np.repeat(self.first[:-1], sizes)
        parent = flat("parent")
        self.parent = np.where(parent < 0, -1, parent + base)
        self.tag, own, above = flat("tag"), flat("own"), flat("above")
        length, linked = flat("length"), flat("linked")
        n = len(self.parent)
        x = np.zeros((n, SIZE), np.float32)
        x[:, 0] = 1
        x[np.arange(n), 1 + self.tag] = 1
        for k in range(KINDS):
            x[:, 1 + len(TAGS) + k] = (own >> k) & 1
            x[:, 1 + len(TAGS) + KINDS + k] = (above >> k) & 1
        at = 1 + len(TAGS) + 2 * KINDS
        x[:, at] = np.log1p(length) / 5
        x[:, at + 1] = linked / np.maximum(length, 1)
        x[:, at + 2] = (own | above) == 0
        x[:, at + 3] = ((own | above) & ~BIT["main"] == 0) & ((own | above) > 0)
        self.x = x
        self.sort = _SORT[self.tag]
        depth = flat("depth")
        order = np.argsort(depth, kind="stable")
        self.levels = [level for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(level) and depth[level[0]]]


def _log_sum(a: np.ndarray) -> np.ndarray:
    """Over the last axis of length 2."""
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(f: Forest, w: np.ndarray, pair: np.ndarray, edges: bool = False):
    """P(content) per node; with ``edges`` also P(parent's state, child's state) per node below a root."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = f.x @ w
    up = np.zeros((n, 2))  # to the parent
    for level in reversed(f.levels):
        # own[level] already holds what came from below
        up[level] = _log_sum(pair[f.sort[level]] + own[level][:, None, :])
        np.add.at(own, f.parent[level], up[level])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2)) if edges else None
    for level in f.levels:
        p = f.parent[level]
        rest = own[p] + down[p] - up[level]
        both = pair[f.sort[level]] + rest[:, :, None]
        down[level] = np.logaddexp(both[:, 0], both[:, 1])
        if edges:
            j = both + own[level][:, None, :]
            j -= np.logaddexp(_log_sum(j[:, 0]), _log_sum(j[:, 1]))[:, None, None]
            joint[level] = np.exp(j)
    belief = own + down
    prob = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return (prob, joint) if edges else prob


def train(pages: list[Page], labels: list[list[int]], steps: int = 300, rate: float = 0.15, ridge: float = 2e-4):
    """Weights by gradient ascent (Adam) on the mean log-likelihood of the labelled trees."""
    f = Forest(pages)
    y = np.array([v for page in labels for v in page], float)
    inner = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((SORTS, 2, 2))
    np.add.at(seen, (f.sort[inner], y[f.parent[inner]].astype(int), y[inner].astype(int)), 1)
    w, pair = np.zeros(SIZE), np.zeros((SORTS, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for t in range(1, steps + 1):
        prob, joint = marginals(f, w, pair, edges=True)
        gw = f.x.T @ (y - prob) / len(y) - ridge * w
        expected = np.zeros_like(pair)
        np.add.at(expected, f.sort[inner], joint[inner])
        gp = (seen - expected) / len(y) - ridge * pair
        for k, (value, g) in enumerate(((w, gw), (pair, gp))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, pair


# ---- labelled pages


def labelled_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A made-up page and the texts of its main blocks. Elements of the article carry the attribute ``data-y``."""
    words = "alder birch cedar dune elm fern grove heath iris juniper kelp larch moss nettle oak pine quartz reed sage thyme".split()
    say = lambda a, b: " ".join(rnd.choice(words) for _ in range(rnd.randint(a, b))).capitalize()
    main: list[str] = []

    def kept(tag: str, a: int, b: int) -> str:
        text = say(a, b) + rnd.choice([".", "", "!"])
        main.append(text)
        return f"<{tag} data-y>{text}" + (f"</{tag}>" if rnd.random() < 0.9 else "")

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{k}'>{say(1, 3)}</a></li>" for k in range(n))

    def noise(kind: str) -> str:
        name = rnd.choice(GROUPS[kind].split())
        attr = rnd.choice(["class", "id"])
        body = rnd.choice([
            lambda: f"<ul>{links(rnd.randint(2, 8))}</ul>", lambda: f"<p>{say(4, 40)}</p>", lambda: say(2, 30), lambda: f"<h3>{say(1, 4)}</h3><p>{say(3, 25)}</p>",
            lambda: f"<div><p>{say(5, 60)}</p><p>{say(5, 30)}</p></div>", lambda: f"<div><a href='/x'>{say(1, 5)}</a> {say(0, 4)}</div>",
        ])()
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        if kind == "form":
            body = f"<label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button>" + (f"<p>{say(3, 12)}</p>" if rnd.random() < 0.4 else "")
        if kind == "comment":
            body = "".join(
                f"<{c} class='{rnd.choice(['comment', 'reply', 'item'])}'><b>{say(1, 2)}</b><p>{say(3, 50)}</p><div class='comment-content'><p>{say(3, 20)}</p></div></{c}>"
                for c in [rnd.choice(["div", "li", "article", "section"])] * rnd.randint(1, 4)
            )
        if tag and rnd.random() < 0.6:
            return f"<{tag}>{body}</{tag}>" if rnd.random() < 0.6 else f"<{tag} {attr}='{name}'>{body}</{tag}>"
        block = rnd.choice(["div", "section", "div"])
        extra = rnd.choice(["", "box ", "block-", "x-"])
        return f"<{block} {attr}='{extra}{name}'>{body}</{block}>"

    def content() -> str:
        parts = []
        if rnd.random() < 0.8:
            h = kept("h1", 2, 10)
            parts.append(f"<header data-y>{h}</header>" if rnd.random() < 0.25 else h)
        for _ in range(rnd.randint(1, 9)):
            r = rnd.random()
            if r < 0.66:
                parts.append(kept("p", 1, 70))
            elif r < 0.74:
                parts.append(kept(rnd.choice(["h2", "h3"]), 1, 6))
            elif r < 0.80:
                parts.append("<ul data-y>" + "".join(kept("li", 1, 14) for _ in range(rnd.randint(1, 5))) + "</ul>")
            elif r < 0.84:
                parts.append("<table data-y><tr data-y>" + "".join(kept("td", 1, 3) for _ in range(3)) + "</tr></table>")
            elif r < 0.88:
                parts.append(f"<div data-y>{kept('p', 2, 40)}</div>")
            elif r < 0.91:
                parts.append(kept(rnd.choice(["blockquote", "pre"]), 3, 20))
            elif r < 0.94:
                parts.append(f"<figure data-y><img src='i'>{kept('figcaption', 1, 6)}</figure>")
            else:
                parts.append(noise(rnd.choice(["ad", "share", "side", "note", "form", "nav"])))
        if rnd.random() < 0.35:
            parts.append(noise(rnd.choice(["comment", "comment", "share", "side"])))
        return "".join(parts)

    r = rnd.random()
    if r < 0.4:
        wrap = ["<article data-y>", "</article>"]
    elif r < 0.55:
        wrap = ["<main data-y>", "</main>"]
    elif r < 0.62:
        wrap = ["<main data-y><article data-y>", "</article></main>"]
    elif r < 0.85:
        wrap = [f"<div data-y {rnd.choice(['class', 'id'])}='{rnd.choice(['content', 'post', 'entry', 'story', 'main', 'post-content', 'articleBody', 'entry-content'])}'>", "</div>"]
    else:
        wrap = ["<div data-y>", "</div>"]
    before = "".join(noise(rnd.choice(["nav", "head", "ad", "note", "form", "side", "hidden"])) for _ in range(rnd.randint(0, 4)))
    after = "".join(noise(rnd.choice(["foot", "side", "comment", "share", "ad", "nav", "form"])) for _ in range(rnd.randint(0, 4)))
    body = content()
    return f"<html><head><title>{say(2, 5)}</title></head><body>{before}{wrap[0]}{body}{wrap[1]}{after}</body></html>", main


def labelled_tree(source: str) -> tuple[Page, list[int]]:
    """A page and its nodes' labels: whether ``data-y`` marks the element."""
    import quillmill.llm.html_tree as tree

    marks: list[int] = [0]

    class Marked(tree.Page):
        pass

    page = Marked(source)
    # nodes come in the order of their start tags
    nodes = []
    for m in tree._MARK.finditer(source):
        end, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if end or not tag or tag in tree.VOID or tag in tree.RAW:
            continue
        if tag in tree.INLINE and not tree.own_mask(tag, attributes):
            continue
        nodes.append(int("data-y" in attributes))
    marks += nodes
    return page, marks


@cache
def default_model(pages: int = 500, seed: int = 7, without: str | None = None) -> tuple[tuple, tuple]:
    """Fitted to made-up pages and to those written by hand, which count ``BY_HAND`` times; ``without`` holds one layout out."""
    rnd = random.Random(seed)
    made = [labelled_tree(labelled_page(rnd)[0]) for _ in range(pages)]
    made += [labelled_tree(page) for name, page in PAGES.items() if name != without] * BY_HAND
    return train([p for p, _ in made], [y for _, y in made])


def main_texts(sources: list[str | None], model, threshold: float = 0.5, at_once: int = 1_000_000) -> list[str]:
    w, pair = model
    out: list[str] = []
    block: list[Page] = []
    size = 0

    def flush():
        if block:
            f = Forest(block)
            keep = marginals(f, w, pair) >= threshold
            for k, p in enumerate(block):
                out.append(p.text(keep[f.first[k] : f.first[k + 1]].tolist()))
            block.clear()

    for s in sources:
        block.append(Page(s or ""))
        size += len(s or "")
        if size >= at_once:
            flush()
            size = 0
    flush()
    return out


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", model=None, threshold: float = 0.5) -> DataFrame:
    """``df`` with the main text of ``html_col`` in ``text_col``; empty where there is none or the html is null.

    Rows and all other columns stay; a column named like ``text_col`` is replaced.
    """
    small_batches(df.sparkSession)
    model = model or default_model()

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array(main_texts(pages.to_pylist(), model, threshold), pa.string())

    return df.withColumn(text_col, run(F.col(html_col)))
