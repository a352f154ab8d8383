"""HTML as a tree of blocks and the runs of text in them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
RAW = frozenset("script style title".split())
IN_HEAD = frozenset("base basefont bgsound command head html link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                     "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                  "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div td th select".split())


@dataclass
class Tree:
    """Nodes in page order; node 0 is the page. A text run is a node without a tag."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["page"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    hidden: list[bool] = field(default_factory=lambda: [False])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])  # characters of the run inside links

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), hidden: bool = False, text: str = "", linked: int = 0) -> int:
        for values, value in zip((self.parent, self.tag, self.names, self.hidden, self.text, self.linked),
                                 (parent, tag, names, hidden, text, linked)):
            values.append(value)
        return len(self.parent) - 1


def parse(html: str) -> Tree:
    """Tree of a page. Unclosed, crossed and stray tags are taken as browsers roughly do; scripts, styles and heads are left out.

    Inline elements belong to the run around them, a line break is white space, character references are decoded and white
    space is made one space.
    """
    tree, run, links = Tree(), [], [0]
    stack = [("page", 0)]  # open elements with the node of the block they are in; unseen ones have node -1
    at, unseen, in_link = 0, 0, 0

    def flush() -> None:
        text = SPACES.sub(" ", "".join(run)).strip()
        if text:
            tree.add(stack[-1][1], "", text=text, linked=min(links[0], len(text)))
        run.clear()
        links[0] = 0

    def close(depth: int) -> None:
        nonlocal unseen, in_link
        while len(stack) > depth:
            if stack[-1][0] not in INLINE:
                flush()
            name, _ = stack.pop()
            unseen -= name in UNSEEN
            in_link -= name == "a"

    def gather(piece: str) -> None:
        if piece and not unseen:
            piece = unescape(piece)
            run.append(piece)
            links[0] += len(piece) if in_link else 0

    def end_head(name: str, piece: str = "") -> None:
        """Close an open head at what cannot stand in one: a body, or other tags and text outside a template or noscript."""
        depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "head"), 0)
        if depth and (name == "body" or (name not in IN_HEAD or piece.strip()) and all(n not in ("template", "noscript") for n, _ in stack[depth:])):
            close(depth)

    size = len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            end_head("html", html[at:])
            gather(html[at:])
            break
        if unseen:
            end_head("html", html[at:found.start()])
        gather(html[at:found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:  # an end tag
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name), 0)
            if depth:
                close(depth)
            continue
        attributes = found[3] or found[6] or ""
        if unseen:
            end_head(name)
        if name in CLOSES_P and any(n == "p" for n, _ in stack):
            close(max(d for d, (n, _) in enumerate(stack) if n == "p"))
        if name in CLOSED_BY_SAME:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in CLOSED_BY_SAME[name]:
                    close(d)
                    break
                if stack[d][0] in SCOPE and not (name == "tr" and stack[d][0] in ("td", "th")):
                    break
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in RAW:
            if name in ("br", "hr", "wbr"):
                gather(" " if name != "wbr" else "")
            if name not in INLINE and name not in ("br", "img"):
                flush()
            continue
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            in_link += name == "a"
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            if name == "title":
                flush()
                end = end or re.compile("(?=<)").search(html, at)  # one without an end is taken to end at the next tag
            at = end.end() if end else size
            continue
        flush()
        unseen += name in UNSEEN
        node = stack[-1][1]
        if not unseen:
            words = tuple(w for m in NAMED.finditer(attributes) for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
            low = attributes.lower()
            node = tree.add(node, name, words, "display:none" in low.replace(" ", "") or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", low)))
        stack.append((name, node))
    close(1)
    flush()
    return tree
