"""HTML pages to ordered items, links and chunks. A tree needs Python; pages are read over Arrow batches.

A page stays one row up to its chunks, so nothing is shuffled: the items of a page are an array, in document order.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags without an end tag, tags whose text is no content, and classes left out with their subtree.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
LEFT_OUT = {"navigation", "footer", "sidebar", "menu"}
#: Classes of a table that is content, and tags that end an open paragraph.
TABLES = {"wikitable", "sortable"}
ENDS_P = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main"}
#: Namespaces of pages that aren't content.
NAMESPACES = ("Special:", "User:", "Talk:", "File:", "MediaWiki:", "Template:", "Help:", "Category:", "Aiuto:")

ITEM = "struct<type:string,level:int,content:string,url:string,context:array<string>>"
Root = tuple[str, str] | None


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def texts(self) -> Iterator[str]:
        """The stripped texts below, blank ones left out."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    if child.strip():
                        yield child.strip()
                elif child.tag not in SILENT:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def find(self, root: tuple[str, str]) -> Node | None:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.tag == root[0] and node.attrs.get("id") == root[1]:
                return node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("", {})
        self.open = [self.top]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P and any(n.tag == "p" for n in self.open):
            self.handle_endtag("p")
        if tag == "li" and self.open[-1].tag == "li":
            self.open.pop()
        if tag in ("td", "th", "tr") and self.open[-1].tag in ("td", "th"):
            self.open.pop()
        if tag == "tr" and self.open[-1].tag == "tr":
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.top


def markdown(table: Node) -> str:
    """A table's rows as markdown; the first row is the head, short rows are filled up, missing cells are empty."""
    rows: list[list[str]] = []
    stack: list[Node] = [table]
    while stack:
        node = stack.pop()
        if node.tag == "tr":
            rows.append([" ".join(" ".join(c.texts()).split()) for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")])
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def items_of(html: str | None, base: str = "", root: Root = ("div", "mw-content-text"), repeat: bool = True) -> list[tuple]:
    """(type, level, content, url, context) of a page's headers, paragraphs, tables, images, lists and loose texts.

    Elements with a class of ``LEFT_OUT`` are gone. Only what is below ``root`` counts; a page without it has no items.
    A header keeps the headers above it as context and ends deeper ones. Tables count if they have a class of
    ``TABLES``, others are gone through like any element; so are lists without a filled entry. With ``repeat`` the loose
    texts directly in headers and paragraphs, and what is nested in them, come again as items of their own, as in the
    engine this one replaces; without it they come once.
    """
    start = tree(html)
    start = start if root is None else start.find(root)
    if start is None:
        return []
    heads, out = [""] * 6, []

    def put(kind: str, content: str, level: int | None = None, url: str | None = None, depth: int = 6) -> None:
        out.append((kind, level, content, url, [h for h in heads[:depth] if h]))

    def left_out(node: Node) -> bool:
        return node.tag in SILENT or bool(LEFT_OUT & set((node.attrs.get("class") or "").split()))

    def element(node: Node) -> list:
        """What is left to be gone through below ``node``."""
        tag = node.tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if text := " ".join(node.texts()):
                level = int(tag[1])
                if heads[level - 1] != text:
                    heads[level - 1 :] = [text, *[""] * (6 - level)]
                put("header", text, level, depth=level)
            return node.children if repeat else []
        if tag == "p":
            if text := " ".join(node.texts()):
                put("paragraph", text)
            return node.children if repeat else []
        if tag == "table" and TABLES & set((node.attrs.get("class") or "").split()) and (text := markdown(node)):
            put("table", text)
            return []
        if tag == "img" and node.attrs.get("src") is not None:
            src = node.attrs["src"]
            put("image", node.attrs.get("alt") or "", url=src if src.startswith("http") else urljoin(base, src))
            return []
        if tag in ("ul", "ol"):
            entries = [" ".join(c.texts()) for c in node.children if isinstance(c, Node) and c.tag == "li"]
            if entries := [f"- {e}" for e in entries if e]:
                put("list", "\n".join(entries))
                return []
        return node.children

    stack = [iter(start.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                if child.strip():
                    put("text", child.strip())
            elif not left_out(child):
                stack.append(iter(element(child)))
                break
        else:
            stack.pop()
    return out


def page_items(pages: DataFrame, html: str = "html", url: str = "url", root: Root = ("div", "mw-content-text"), repeat: bool = True) -> DataFrame:
    """url, title and items (an array) of every page. A page without a first heading has the title No Title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("url", pa.string()), ("context", pa.list_(pa.string()))]))
        names = ("type", "level", "content", "url", "context")
        for b in batches:
            own = [[dict(zip(names, x)) for x in items_of(h, u or "", root, repeat)] for h, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(own, kind)], names=["url", "title", "items"])

    rows = pages.select(html, F.col(url).alias("url"), page_title(F.col(html)).alias("title"))
    return rows.mapInArrow(run, f"url string, title string, items array<{ITEM}>")


def structured_items(pages: DataFrame, **how) -> DataFrame:
    """url, pos, type, level, content, image_url and context of every item of every page."""
    rows = page_items(pages, **how).select("url", F.posexplode("items").alias("pos", "_i"))
    return rows.select("url", "pos", "_i.type", "_i.level", "_i.content", F.col("_i.url").alias("image_url"), "_i.context")


def page_title(html: Column) -> Column:
    """Text of h1#firstHeading, else No Title."""
    inner = F.regexp_extract(html, r"""(?is)<h1[^>]*id=["']firstHeading["'][^>]*>(.*?)</h1>""", 1)
    text = F.trim(F.regexp_replace(inner, r"<[^>]+>", ""))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.when(F.coalesce(text, F.lit("")) == "", "No Title").otherwise(text)


def is_wiki_page(url: Column, domain: str) -> Column:
    """Whether an address is a content page of the wiki: in the domain, in no namespace, its title without ``:`` or ``?``."""
    title = F.substring_index(F.substring_index(url, "/wiki/index.php/", -1), "#", 1)
    inside = url.startswith(domain) & url.contains("/wiki/index.php/") & ~title.rlike("[:?]")
    for name in NAMESPACES:
        inside = inside & ~url.contains(name)
    return F.coalesce(inside, F.lit(False))


def absolute(base: Column, href: Column) -> Column:
    """``href`` resolved against the address ``base``: other schemes, hosts, roots, and ``.`` and ``..`` in paths."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    path = F.regexp_replace(F.regexp_replace(F.substring(base, F.char_length(origin) + 1, F.lit(1 << 30)), r"[?#].*$", ""), r"[^/]*$", "")
    path = F.when(path == "", "/").otherwise(path)
    tail = F.regexp_extract(href, r"([?#].*)?$", 1)
    bare = F.regexp_replace(href, r"[?#].*$", "")
    joined = F.when(bare.startswith("/"), bare).otherwise(F.concat(path, bare))
    parts = F.filter(F.split(joined, "/"), lambda x: x != ".")
    stack = F.aggregate(
        parts, F.lit([]).cast("array<string>"),
        lambda s, x: F.when(x == "..", F.when(F.size(s) > 1, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)).otherwise(F.concat(s, F.array(x))),
    )
    clean = F.array_join(F.when(joined.rlike(r"(^|/)\.\.?$"), F.concat(stack, F.array(F.lit("")))).otherwise(stack), "/")
    full = F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
    full = full.when(href == "", base).when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), tail))
    return full.when(bare == "", F.concat(F.regexp_replace(base, r"[?#].*$", ""), tail)).otherwise(F.concat(origin, clean, tail))


def links(pages: DataFrame, html: str = "html", url: str = "url", root: Root = ("div", "mw-content-text"), keep=None) -> DataFrame:
    """src, dst of the pages' distinct absolute links, without query and fragment, below ``root`` or else anywhere.

    ``keep`` (a column of an address to a condition) leaves out links, such as :func:`is_wiki_page`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, out = [], []
            for h, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                top = tree(h)
                stack = [(top.find(root) if root else None) or top]
                while stack:
                    node = stack.pop()
                    if node.tag == "a" and node.attrs.get("href"):
                        src.append(u)
                        out.append(node.attrs["href"].strip())
                    stack.extend(c for c in node.children if isinstance(c, Node))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(out, pa.string())], names=["src", "href"])

    rows = pages.select(html, url).mapInArrow(run, "src string, href string")
    rows = rows.select("src", F.regexp_replace(absolute(F.col("src"), F.col("href")), r"[?#].*$", "").alias("dst")).where("dst <> ''")
    return (rows.where(keep(F.col("dst"))) if keep else rows).distinct()


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")
