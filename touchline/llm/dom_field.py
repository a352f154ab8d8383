"""Main text of pages by a tree-structured graphical model of their DOM.

Every block and every run of text is a node that is content or not. A node's features (tag, names in its class, id and role,
length, links) give its own potential; a parent and its child share a potential that depends on the kind of the child.
Sum-product messages pass from the leaves up and from the page down, and give each node's exact marginal. The weights maximise
the likelihood of labelled pages: made ones, and a bounded sample of the given pages that mark their article themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices
from touchline.llm.dom import Tree, parse
from touchline.llm.labelled_pages import MARK, labelled_pages

SAMPLE_PAGES = 200  # given pages used for training, at most
FEATURES = 1 << 16  # features are numbered by a hash below this
ROUNDS, RATE, RIDGE = 300, 0.1, 0.02
BATCH_NODES = 200_000  # pages are put through the model together up to so many nodes

# Tags and words in names that say what a block is for.
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu button select option textarea label fieldset dialog input".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner bio breadcrumb breadcrumbs captcha comment comments complementary "
    "consent contentinfo cookie cookies copyright disclaimer discussion disqus feedback foot footer form gdpr head header legal links "
    "login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promotion "
    "recommended related replies reply respond search share sharing side sidebar signup skip social sponsor sponsored subscribe tags "
    "toolbar top warning widget".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_NAMES = frozenset("article body content entry main page post story text".split())
PLAIN, RUN, BOILERPLATE, CONTENT = range(4)  # kinds of children


@dataclass
class Forest:
    """Trees of several pages end to end."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    features: np.ndarray  # numbers, all nodes' end to end
    owner: np.ndarray  # node of each number


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def _features(tree: Tree, i: int, inside: str) -> list[str]:
    tag = tree.tag[i]
    if tag:
        names = {*tree.names[i]}
        hints = [f"name:{w}" for w in tree.names[i]] + ["boilerplate"] * bool(BOILERPLATE_NAMES & names) + ["content"] * bool(CONTENT_NAMES & names)
        return ["block", f"tag:{tag}", *hints, *(["hidden"] if tree.hidden[i] else [])]
    text, links = tree.text[i], tree.linked[i]
    words = text.count(" ") + 1
    return ["run", f"in:{inside}", f"words:{_bucket(words, (2, 4, 8, 15, 30))}", f"links:{_bucket(10 * links // len(text), (1, 4, 8))}",
            f"stops:{text[-1] in '.!?:;…”'}", *(["copyright"] if text[0] == "©" else [])]


def _kind(tree: Tree, i: int) -> int:
    if not tree.tag[i]:
        return RUN
    names = {*tree.names[i]}
    if tree.tag[i] in BOILERPLATE_TAGS or names & BOILERPLATE_NAMES or tree.hidden[i]:
        return BOILERPLATE
    return CONTENT if tree.tag[i] in CONTENT_TAGS or names & CONTENT_NAMES else PLAIN


def forest(trees: list[Tree]) -> Forest:
    parent, depth, kind, numbers, owner, known = [], [], [], [], [], {}
    for tree in trees:
        start = len(parent)
        for i, up in enumerate(tree.parent):
            parent.append(start + up if up >= 0 else -1)
            depth.append(depth[start + up] + 1 if up >= 0 else 0)
            kind.append(_kind(tree, i))
            for name in _features(tree, i, tree.tag[up]):
                if name not in known:
                    known[name] = zlib.crc32(name.encode()) % FEATURES
                numbers.append(known[name])
                owner.append(start + i)
    return Forest(*[np.array(x, np.int64) for x in (parent, depth, kind, numbers, owner)])


@dataclass
class Field:
    """Weights: of features for being content, and [kind of child, label of parent, label of child] of edges."""

    node: np.ndarray
    edge: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and P(parent's label, own label) of every node that has a parent (zero for roots)."""
        own = np.zeros((len(f.parent), 2))
        np.add.at(own[:, 1], f.owner, self.node[f.features])
        order = np.argsort(f.depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(f.depth))[:-1])
        up, sent = own.copy(), np.zeros_like(own)  # evidence from a node and below it; the message to its parent
        for nodes in levels[:0:-1]:
            sent[nodes] = np.logaddexp(*(self.edge[f.kind[nodes]] + up[nodes][:, None, :]).transpose(2, 0, 1))
            np.add.at(up, f.parent[nodes], sent[nodes])
        down = np.zeros_like(own)  # message from the parent
        pair = np.zeros((len(own), 2, 2))
        for nodes in levels[1:]:
            above = up[f.parent[nodes]] + down[f.parent[nodes]] - sent[nodes]
            joint = self.edge[f.kind[nodes]] + above[:, :, None]
            down[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = joint + up[nodes][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair[nodes] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def train(trees: list[Tree], labels: list[np.ndarray]) -> Field:
    """Weights of highest likelihood, with a ridge, by adaptive gradient steps from zero."""
    f, y = forest(trees), np.concatenate(labels).astype(int)
    inner = np.nonzero(f.parent >= 0)[0]
    seen_node = np.bincount(f.features, y[f.owner], FEATURES)
    seen_edge = np.zeros((4, 2, 2))
    np.add.at(seen_edge, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    model = Field(np.zeros(FEATURES), np.zeros((4, 2, 2)))
    squares = [np.full(FEATURES, 1e-6), np.full((4, 2, 2), 1e-6)]
    for _ in range(ROUNDS):
        content, pair = model.marginals(f)
        edge = np.zeros((4, 2, 2))
        np.add.at(edge, f.kind[inner], pair[inner])
        for weights, gradient, total in zip((model.node, model.edge), (
                seen_node - np.bincount(f.features, content[f.owner], FEATURES) - RIDGE * model.node,
                seen_edge - edge - RIDGE * model.edge), squares):
            total *= 0.9
            total += 0.1 * gradient**2
            weights += RATE * gradient / np.sqrt(total)
    return model


def _upward(tree: Tree, content: np.ndarray) -> np.ndarray:
    """Labels of all nodes from those of the runs: a block is content if most of the text below it is."""
    good, size = np.zeros(len(content)), np.zeros(len(content))
    for i in range(len(content) - 1, -1, -1):
        if not tree.tag[i]:
            size[i] = len(tree.text[i])
            good[i] = size[i] * content[i]
        if i:
            size[tree.parent[i]] += size[i]
            good[tree.parent[i]] += good[i]
    return np.where(size > 0, 2 * good > size, 0).astype(int)


def marked(tree: Tree) -> np.ndarray | None:
    """Labels of a page that marks its one article itself: runs below it and below no block for another purpose. Else None."""
    roots = [i for i, t in enumerate(tree.tag) if t == "article"] or [i for i, t in enumerate(tree.tag) if t == "main"]
    if len(roots) != 1:
        return None
    inside = np.zeros(len(tree.tag), int)
    for i in range(1, len(tree.tag)):
        inside[i] = i == roots[0] or inside[tree.parent[i]] and _kind(tree, i) != BOILERPLATE
    content = np.array([inside[i] and not t for i, t in enumerate(tree.tag)], int)
    return _upward(tree, content) if content.any() else None


def fitted(df: DataFrame, html: str = "html") -> Field:
    """The model of the made pages and of at most SAMPLE_PAGES of the given ones, those with the smallest hashes."""
    trees = [parse(p) for p in labelled_pages()]
    labels = [_upward(t, np.array([x.startswith(MARK) for x in t.text], int)) for t in trees]
    sample = df.where(F.col(html).isNotNull()).select(F.col(html).alias("h")).orderBy(F.xxhash64("h"), "h").limit(SAMPLE_PAGES)
    for row in sample.collect():
        tree = parse(row.h)
        if (found := marked(tree)) is not None:
            trees.append(tree)
            labels.append(found)
    for tree in trees:
        tree.text = [x.replace(MARK, "") for x in tree.text]
    return train(trees, labels)


def content_of(pages: list[str], model: Field, least: float = 0.5) -> list[str]:
    """Main text of every page: runs whose marginal is at least `least`, in page order, joined by one space."""
    out: list[str] = []
    trees: list[Tree] = []

    def finish() -> None:
        content, _ = model.marginals(forest(trees)) if trees else (np.zeros(0), None)
        start = 0
        for tree in trees:
            good = content[start:start + len(tree.tag)] >= least
            out.append(" ".join(x for x, g in zip(tree.text, good) if g and x))
            start += len(tree.tag)
        trees.clear()

    nodes = 0
    for page in pages:
        trees.append(parse(page))
        nodes += len(trees[-1].tag)
        if nodes >= BATCH_NODES:
            finish()
            nodes = 0
    finish()
    return out


def main_text(html: Column, model: Field) -> Column:
    """Main text of a column of pages; null and empty pages give an empty text."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in slices(batches):
            yield pa.array(content_of([p or "" for p in pages.to_pylist()], model), pa.string())

    return extract(html)
