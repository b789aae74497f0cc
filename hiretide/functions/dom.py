"""A small element tree for HTML pages, used inside Arrow batches only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def facts(fields: str) -> T.StructType:
    """Schema of extracted facts, 'name kind, ...' (no session needed)."""
    pairs = (part.split(" ") for part in fields.split(", "))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator["Element"]:
        """Descendants in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def select(self, test: Callable[["Element"], bool]) -> Iterator["Element"]:
        return (e for e in self.walk() if test(e))

    def first(self, test: Callable[["Element"], bool]) -> "Element | None":
        return next(self.select(test), None)

    def strings(self) -> Iterator[str]:
        """Visible strings in document order; script and style bodies count only
        for the element that owns them."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    yield node.strip()
            elif node.tag not in ("script", "style", "template"):
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open = self.root

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID_TAGS:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(markup: str) -> Element:
    builder = _TreeBuilder()
    builder.feed(markup)
    builder.close()
    return builder.root


def by_tag(*tags: str) -> Callable[[Element], bool]:
    return lambda e: e.tag in tags


def by_class(*classes: str) -> Callable[[Element], bool]:
    return lambda e: any(c in e.classes for c in classes)


def link(e: Element) -> bool:
    return e.tag == "a" and "href" in e.attrs


@F.pandas_udf(T.StringType())
def text_of_fragment(values: pd.Series) -> pd.Series:
    return values.map(lambda markup: parse(markup).text(), na_action="ignore")


def outer_html(element: Element) -> str:
    """Markup of an element, for texts that are kept as HTML."""
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in element.attrs.items())
    inner = "".join(escape(c, quote=False) if isinstance(c, str) else outer_html(c) for c in element.children)
    closing = "" if element.tag in VOID_TAGS else f"</{element.tag}>"
    return f"<{element.tag}{attrs}>{inner}{closing}"
