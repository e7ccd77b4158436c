"""Act text out of a saved page: the blocks of the first article in a container of a known class."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "li"))


class _Reader(HTMLParser):
    def __init__(self, container: str, article: str, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.container, self.article, self.drop = container, article, drop
        self.stack: list[tuple[str, str]] = []  # tag, role
        self.found = self.over = False
        self.blocks: list[list[str]] = []
        self.going = False  # the last piece of text goes on

    def _has(self, role: str) -> bool:
        return any(r == role for _, r in self.stack)

    def handle_starttag(self, tag, attrs):
        self.going = False
        if tag in VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        role = ""
        if self._has("article"):
            if tag in ("script", "style") or self.drop & set(classes):
                role = "drop"
            elif tag in BLOCKS and not any(t in ("p", "li") and r == "block" for t, r in self.stack) and not self._has("drop"):
                role = "block"
                self.blocks.append([])
        elif tag == self.article and not self.over and (not self.container or self._has("container")):
            role, self.found = "article", True
        elif self.container and self.container in classes:
            role = "container"
        self.stack.append((tag, role))

    def handle_comment(self, data):
        self.going = False

    def handle_endtag(self, tag):
        self.going = False
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.over |= any(r == "article" for _, r in self.stack[depth:])
                del self.stack[depth:]
                return

    def handle_data(self, data):
        if self._has("block") and not self._has("drop"):
            if self.going:
                data = self.blocks[-1].pop() + data
            self.blocks[-1].append(data)
            self.going = True


def act_text(page: str | None, container: str = "text_upd", article: str = "article", drop: tuple[str, ...] = ("note",), skip: tuple[str, ...] = ()) -> str | None:
    """Blocks joined by line ends, a block's pieces of text (between tags) by blanks; None if the page has no such article."""
    reader = _Reader(container, article, frozenset(drop))
    reader.feed(page or "")
    reader.close()
    if not reader.found:
        return None
    lines = [" ".join(" ".join(b).split()) for b in reader.blocks]
    return "\n".join(x for x in lines if x and not x.startswith(tuple(skip) or "\0"))


def act_text_column(page: Column, container: str = "text_upd", skip: tuple[str, ...] = (), strict: bool = False) -> Column:
    """act_text of a column; null, or an error if strict, where the page has no act."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: act_text(p, container, skip=skip))

    text = of(page)
    return F.coalesce(text, F.raise_error(F.lit("the page has no act text")).cast("string")) if strict else text
