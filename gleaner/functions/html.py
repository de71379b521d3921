"""HTML helpers for Arrow batches.

Only what needs a real tokenizer runs in Python: plain text of markup, and
links selected by a CSS path.  Everything around it stays in column expressions.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gleaner.constants import JSON_LD_DATE_KEYS
from gleaner.functions.text import non_blank

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NONE: set[str] = set()
_LINKS = StructType(
    [
        StructField("links", ArrayType(StructType([StructField("href", StringType()), StructField("text", StringType())]))),
        StructField("titles", ArrayType(StringType())),
        StructField("error", StringType()),
    ]
)


class _Text(HTMLParser):
    """Collects stripped text nodes outside script and style."""

    def __init__(self) -> None:
        super().__init__()
        self.nodes: list[str] = []
        self._hidden: str | None = None
        self._pending: list[str] = []

    def flush(self) -> None:
        text = "".join(self._pending).strip()
        self._pending = []
        if text:
            self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in ("script", "style"):
            self._hidden = tag

    def handle_endtag(self, tag):
        self.flush()
        if tag == self._hidden:
            self._hidden = None

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if self._hidden is None:
            self._pending.append(data)


def _markup_text(markup: str) -> str:
    parser = _Text()
    parser.feed(markup)
    parser.close()
    parser.flush()
    return "\n".join(parser.nodes)


@F.pandas_udf(StringType())
def markup_text(markup: pd.Series) -> pd.Series:
    """Text nodes of markup, one per line; null when there are none."""
    return markup.map(lambda m: _markup_text(m) or None if isinstance(m, str) else None)


def html_or_text(value: Column) -> Column:
    """Plain text as it is, markup reduced to its text; blank becomes null.

    Plain values reach the Python worker only as nulls.
    """
    text = non_blank(value)
    is_markup = text.contains("<") & text.contains(">")
    return F.when(is_markup, markup_text(F.when(is_markup, text))).otherwise(text)


@F.pandas_udf(StructType([StructField("at", IntegerType()), StructField("text", StringType())]))
def first_text(candidates: pd.Series) -> pd.DataFrame:
    """Position and text of the first candidate that has any text."""
    rows = []
    for values in candidates:
        found = (None, None)
        for at, value in enumerate(() if values is None else values):
            text = (value or "").strip()
            if "<" in text and ">" in text:
                text = _markup_text(text)
            if text:
                found = (at, text)
                break
        rows.append(found)
    return pd.DataFrame(rows, columns=["at", "text"]).astype({"at": "Int32"})


class _Selected(HTMLParser):
    """Elements matching selector paths of ``tag``, ``.class`` and ``#id`` parts."""

    def __init__(self, paths: list[list[list[tuple[str, set[str], str | None]]]]) -> None:
        super().__init__()
        self.paths = paths
        self.open: list[tuple[str, set[str], str | None]] = []
        self.found: list[list[dict]] = [[] for _ in paths]
        self.live: list[tuple[int, dict]] = []

    def _fits(self, part, element) -> bool:
        tag, classes, ident = part
        return (not tag or tag == element[0]) and classes <= element[1] and ident in (None, element[2])

    def _matches(self, path) -> bool:
        if not self._fits(path[-1], self.open[-1]):
            return False
        wanted = len(path) - 2
        for element in reversed(self.open[:-1]):
            if wanted < 0:
                break
            if self._fits(path[wanted], element):
                wanted -= 1
        return wanted < 0

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        classes = attributes.get("class")
        self.open.append((tag, set(classes.split()) if classes else _NONE, attributes.get("id")))
        for at, alternatives in enumerate(self.paths):
            if any(self._matches(path) for path in alternatives):
                node = {"href": attributes.get("href"), "text": []}
                self.found[at].append(node)
                self.live.append((len(self.open), node))
        if tag in _VOID:
            self._close(len(self.open) - 1)

    def _close(self, depth: int) -> None:
        del self.open[depth:]
        if self.live:
            self.live = [(level, node) for level, node in self.live if level <= depth]

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        for _, node in self.live:
            node["text"].append(data.strip())


def _selector_paths(selector: str) -> list[list[tuple[str, set[str], str | None]]]:
    """Split ``a.b c#d, e`` into alternatives of compound parts."""
    alternatives = []
    for alternative in selector.split(","):
        path = []
        for compound in alternative.split():
            name = compound.replace("#", ".#").split(".")
            if any(not part.strip("#").replace("-", "").replace("_", "").isalnum() for part in name[1:]) or (
                name[0] not in ("", "*") and not name[0].replace("-", "").isalnum()
            ):
                raise ValueError(f"unsupported selector: {selector}")
            idents = [part[1:] for part in name[1:] if part.startswith("#")]
            classes = {part for part in name[1:] if not part.startswith("#")}
            path.append((name[0].lower().strip("*"), classes, idents[0] if idents else None))
        if not path:
            raise ValueError(f"unsupported selector: {selector}")
        alternatives.append(path)
    return alternatives


@F.pandas_udf(_LINKS)
def select_links(page: pd.Series, link_selector: pd.Series, title_selector: pd.Series) -> pd.DataFrame:
    """Links and titles of listing pages, in document order."""
    rows = []
    for body, links, titles in zip(page, link_selector, title_selector):
        try:
            paths = [_selector_paths(links or "a")]
            if titles and titles.strip():
                paths.append(_selector_paths(titles))
            parser = _Selected(paths)
            parser.feed(body or "")
            parser.close()
            found = [
                [{"href": node["href"], "text": "".join(node["text"])} for node in nodes] for nodes in parser.found
            ]
            rows.append((found[0], [node["text"] for node in found[1]] if len(found) > 1 else [], None))
        except ValueError as problem:
            rows.append(([], [], str(problem)))
    return pd.DataFrame(rows, columns=["links", "titles", "error"])


def _linked_data_dates(block: str) -> list[str]:
    try:
        payload = json.loads(block)
    except ValueError:
        return []
    dates: list[str] = []
    level = payload if isinstance(payload, list) else [payload]
    while level:
        below: list = []
        for node in level:
            if isinstance(node, list):
                below += node
            elif isinstance(node, dict):
                dates += [node[key] for key in JSON_LD_DATE_KEYS if isinstance(node.get(key), str)]
                if isinstance(node.get("@graph"), list):
                    below += node["@graph"]
        level = below
    return dates


@F.pandas_udf(ArrayType(StringType()))
def linked_data_dates(blocks: pd.Series) -> pd.Series:
    """Date strings of JSON-LD blocks, block by block and level by level."""
    return blocks.map(
        lambda items: None if items is None else [date for block in items for date in _linked_data_dates(block)]
    )

