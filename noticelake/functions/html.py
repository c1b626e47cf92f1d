"""HTML extraction as Arrow-batched functions over the standard library's tolerant parser.

A page becomes a small tree; void elements never hold content, and an open
paragraph or list item ends where a new block begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.schemas import NOTICE_DEFAULTS, TRANSIT_NOTICE, WATER_PAGE

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open paragraph, and those that end an open element of their own kind.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = frozenset("li dt dd option tr td th".split())
HIDDEN = frozenset(("script", "style"))


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def pieces(self) -> Iterator[str]:
        """All text below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                yield child
            elif child.tag not in HIDDEN:
                stack += reversed(child.children)

    def text(self, separator: str = "", strip: bool = True) -> str:
        """The pieces of text, joined; stripped, empty ones fall out."""
        return separator.join(filter(None, (p.strip() if strip else p for p in self.pieces())))

    def first_text(self) -> str | None:
        """The first piece of text directly in this element."""
        return next((c for c in self.children if isinstance(c, str)), None)

    def find_all(self, tag: str | None = None, class_: str | None = None, id_: str | None = None) -> Iterator[Node]:
        for node in self.walk():
            if (tag is None or node.tag == tag) and (class_ is None or class_ in node.attrs.get("class", "").split()) and (id_ is None or node.attrs.get("id") == id_):
                yield node

    def find(self, *args, **kwargs) -> Node | None:
        return next(self.find_all(*args, **kwargs), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, tags, barriers=frozenset()):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close(("p",), BLOCKS - {"p"} | SIBLINGS)
        if tag in SIBLINGS:
            self._close(("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,), frozenset(("ul", "ol", "dl", "table")))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in BLOCKS:
            self.open.pop()

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parse(html: str | None, as_written: bool = False) -> Node:
    """The tree of a page; ``as_written`` leaves character references as they are, also those without their semicolon."""
    builder = _Builder()
    builder.feed((html or "").replace("&", "&amp;") if as_written else html or "")
    builder.close()
    return builder.root


class MissingContainer(ValueError):
    """A page has no element of the wanted id."""


def _container(root: Node, id_: str, strict: bool) -> Node | None:
    found = root.find(id_=id_)
    if found is None and strict:
        raise MissingContainer(f"no element with id {id_}")
    return found


def links_of(root: Node, container: str = "main_content", item: str = "list-item", strict: bool = False) -> list[str | None]:
    """The first link of every listed item, in order, repeats kept, as written."""
    inside = _container(root, container, strict)
    anchors = (n.find("a") for n in inside.find_all("div", item)) if inside else ()
    return [a.attrs.get("href") for a in anchors if a is not None]


def notices_of(root: Node, container: str = "infoAccordion", strict: bool = False) -> list[dict[str, str]]:
    """Every accordion group as a notice, with a default for each missing field."""
    out, inside = [], _container(root, container, strict)
    for group in inside.find_all("div", "accordion-group") if inside else ():
        header, body, time = group.find("a", "accordion-toggle"), group.find("div", "accordion-inner"), group.find("div", "info-time")
        found = {"data_id": group.attrs.get("data-id"), "header": header and header.text(), "body": body and body.text(" "), "info_time": time and time.text()}
        out.append({k: NOTICE_DEFAULTS[k] if v is None else v for k, v in found.items()})
    return out


def detail_of(root: Node, container: str = "main_content", strict: bool = False) -> dict[str, str | None] | None:
    """Title, date and content of a detail page; None without a paragraph in its view."""
    inside = _container(root, container, strict)
    content = next((p for view in inside.find_all(class_="view") for p in view.find_all("p")), None) if inside else None
    if content is None:
        return None
    title, date = inside.find("h1"), inside.find(class_="list-item-date")
    return {"title": title and title.text(), "date": date and date.text(), "content": content.text()}


def first_text_of(root: Node, class_: str, tag: str | None = None) -> str | None:
    """The first text node of the first div whose class attribute is exactly that, or of a paragraph right in it."""
    for node in root.find_all("div"):
        if node.attrs.get("class") == class_:
            for at in [c for c in node.children if isinstance(c, Node) and c.tag == tag] if tag else [node]:
                if (text := at.first_text()) is not None:
                    return text
    return None


def _over_pages(f: Callable[[Node], object], kind: str, as_written: bool = False) -> Callable[[Column | str], Column]:
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f(parse(p, as_written)) for p in pages], dtype=object)

    def run_struct(pages: pd.Series) -> pd.DataFrame:
        found = [None if p is None else f(parse(p)) for p in pages]
        return pd.DataFrame([{**(x or dict.fromkeys(names)), "found": x is not None} for x in found], columns=[*names, "found"])

    names = [c.split()[0] for c in kind.split(", ")] if " " in kind and "<" not in kind else []
    if names:
        shaped = F.pandas_udf(run_struct, f"{kind}, found boolean")
        return lambda html: _nullable(shaped(html), names)
    shaped = F.pandas_udf(run, kind)
    return lambda html: shaped(html)


def _nullable(found: Column, names: list[str]) -> Column:
    return F.when(found["found"], F.struct(*(found[n].alias(n) for n in names)))


def listing_links(html: Column | str, strict: bool = False) -> Column:
    """array<string> of a listing page's links; a page without the container has none, or fails if strict."""
    return _over_pages(lambda root: links_of(root, strict=strict), "array<string>")(html)


def links(html: Column | str, as_written: bool = False) -> Column:
    """array<string> of all of a page's links, in order, repeats kept; ``as_written`` leaves character references as they are."""
    return _over_pages(lambda root: [n.attrs["href"] for n in root.find_all("a") if "href" in n.attrs], "array<string>", as_written)(html)


def transit_notices(html: Column | str, strict: bool = False) -> Column:
    """array<struct> of a transit page's notices."""
    kind = f"array<struct<{TRANSIT_NOTICE.replace(' string', ':string')}>>"
    return _over_pages(lambda root: notices_of(root, strict=strict), kind)(html)


def water_detail(html: Column | str, strict: bool = False) -> Column:
    """struct of a detail page, null where it has no content."""
    return _over_pages(lambda root: detail_of(root, strict=strict), WATER_PAGE)(html)


def element_text(html: Column | str, tag: str | None = None, class_: str | None = None, id_: str | None = None, separator: str = "", strip: bool = True, as_written: bool = False) -> Column:
    """The text of the first matching element, or null; ``as_written`` leaves character references as they are."""

    def text(root: Node) -> str | None:
        node = root.find(tag, class_, id_)
        return None if node is None else node.text(separator, strip)

    return _over_pages(text, "string", as_written)(html)


def first_text_node(html: Column | str, class_: str, tag: str | None = None, as_written: bool = False) -> Column:
    return _over_pages(lambda root: first_text_of(root, class_, tag), "string", as_written)(html)
