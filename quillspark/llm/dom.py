"""A small, forgiving HTML reader: block elements as nodes, their own text in blocks, in page order."""

from __future__ import annotations

import html
import re

#: Fixed values of the HTML standard: elements by how they take part in the layout or hold text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title template noscript head svg math iframe noembed noframes object canvas audio video select datalist".split())
BLOCK = frozenset(
    "html body article aside address blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table caption tbody thead tfoot tr td th ul menu center search".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
NO_P_INSIDE = BLOCK - {"html", "body"}  # these end an open paragraph
CONTAINERS = frozenset("html body article aside blockquote details dialog dd div dl fieldset figure footer form header li main nav ol section table td th ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ENDS: dict[str, re.Pattern] = {}


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "own", "links", "tags", "controls", "children", "at")

    def __init__(self, tag, attrs, parent, depth, at):
        self.tag, self.attrs, self.parent, self.depth, self.at = tag, attrs, parent, depth, at
        self.own = self.links = self.tags = self.controls = 0
        self.children: list[int] = []


def read(page: str) -> tuple[list[Node], list[list]]:
    """Nodes (0 is the root; parents come first) and blocks: [node, pieces of decoded text]. Text outside every block element
    gets a node without a name."""
    nodes = [Node("", "", -1, 0, 0)]
    blocks: list[list] = []
    stack: list[tuple[str, int]] = [("", 0)]  # tag; its node, or that of the nearest block for inline elements
    open_block, unseen, links, loose = -1, 0, 0, 0  # loose: the nameless block of text that stands outside all blocks
    pos, n = 0, len(page)

    def text(piece: str) -> None:
        nonlocal open_block, loose
        node = stack[-1][1]
        if not node and not (open_block >= 0 and loose):
            if piece.isspace():
                return
            nodes.append(Node("", "", 0, 1, pos))
            nodes[0].children.append(len(nodes) - 1)
            loose = len(nodes) - 1
        node = node or loose
        if open_block < 0 or blocks[open_block][0] != node:
            if piece.isspace():
                return
            blocks.append([node, []])
            open_block = len(blocks) - 1
        piece = html.unescape(piece) if "&" in piece else piece
        blocks[open_block][1].append(piece)
        size = len(piece) - piece.count(" ")
        nodes[node].own += size
        if links:
            nodes[node].links += size

    def pop_to(depth: int) -> None:
        nonlocal unseen, links, open_block
        while len(stack) > depth:
            tag, _ = stack.pop()
            if tag in UNSEEN:
                unseen -= 1
            elif tag == "a":
                links -= 1
            if tag in BLOCK:
                open_block = -1

    while pos < n:
        m = TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos and not unseen:
            text(page[pos:end])
        if not m:
            break
        pos = m.end()
        closing, opening, attrs, broken, rest = m.groups()
        if closing:
            tag = closing.lower()
            if tag in ("body", "html"):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                other = stack[depth][0]
                if other == tag:
                    pop_to(depth)
                    break
                if other in BLOCK and (tag not in BLOCK or tag == "p" and other in CONTAINERS or tag == "li" and other in ("ul", "ol")):
                    break  # what stands in between is not closed by this
            continue
        tag = opening or broken
        if not tag:
            continue
        if broken and not page.startswith(">", pos - 1):
            break  # cut off inside a tag
        tag, attrs = tag.lower(), attrs if opening else rest
        if tag in VOID:
            if tag == "br" or tag == "hr":
                if tag == "hr":
                    open_block = -1
                elif open_block >= 0:
                    blocks[open_block][1].append(" ")
            elif tag == "input":
                nodes[stack[-1][1]].controls += 1
            continue
        if tag in RAW:
            found = _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)).search(page, pos)
            stop = found.start() if found else n
            if tag == "textarea":
                nodes[stack[-1][1]].controls += 1
            pos = page.find(">", stop) + 1 if found else n
            pos = pos or n
            continue
        if tag == "body" and len(nodes) > 1:  # ends a head that was left open
            for depth in range(1, len(stack)):
                if stack[depth][0] == "head":
                    pop_to(depth)
                    break
        if tag in BLOCK:
            if tag in NO_P_INSIDE or tag == "p":
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        pop_to(depth)
                        break
                    if stack[depth][0] in CONTAINERS:
                        break
            if tag in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in CLOSES[tag]:
                        pop_to(depth)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
                    elif stack[depth][0] in STOPS[tag]:
                        break
            open_block = -1
            if not unseen:
                up = stack[-1][1]
                nodes.append(Node(tag, attrs, up, nodes[up].depth + 1, m.start()))
                nodes[up].children.append(len(nodes) - 1)
                stack.append((tag, len(nodes) - 1))
                continue
        elif not unseen:
            nodes[stack[-1][1]].tags += 1
            if tag in ("button", "label", "option"):
                nodes[stack[-1][1]].controls += 1
        if tag in UNSEEN:
            unseen += 1
        elif tag == "a":
            links += 1
        if not attrs.endswith("/") or tag not in ("svg", "math"):
            stack.append((tag, stack[-1][1]))
        elif tag in UNSEEN:
            unseen -= 1
    return nodes, blocks


def block_text(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())
