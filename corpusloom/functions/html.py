"""HTML functions: a small tree builder and Arrow functions over it.

Trees keep implicit closing to what pages need: a new block ends an open paragraph, list items and
table cells end their predecessors, void elements take no content, script and style are raw text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from .udfs import arrow_function

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select body html div section article".split())

# What the boilerplate filter removes.
DROP_CLASSES = frozenset(
    "nav-aside-wrapper nav-aside nav-container nav-menu navigation navbar menu menu-item sub-menu menu-wrapper breadcrumb breadcrumb-container breadcrumbs "
    "footer site-footer page-footer sidebar aside widget sr-only sr-only-xl screen-reader-text hidden visually-hidden social share social-share "
    "comments comment-form ad advertisement banner".split()
)
DROP_TAGS = frozenset("nav footer aside script style noscript iframe".split())
DROP_IDS = ("nav-aside", "menu-main", "sidebar", "footer", "comments")
UNSAFE_TAGS = frozenset("script style noscript iframe meta link form input button".split())
SAFE_ATTRIBUTES = ("href", "src", "alt", "title", "id", "name", "rowspan", "colspan")
HIDDEN_CLASSES = frozenset("hidden d-none hide invisible".split())
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """This node and its descendants in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo += reversed(x.children)

    def text(self) -> str:
        """Stripped strings joined by single spaces."""
        return " ".join(s for s in (t.strip() for t in self.strings()) if s)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def markup(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                out.append(f"</{x[0]}>")
            elif isinstance(x, str):
                out.append(escape(x, quote=False))
            else:
                if x.tag:
                    out.append("<" + x.tag + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag and x.tag not in VOID:
                    todo.append((x.tag,))
                todo += reversed(x.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None)

    def _close(self, tags: set[str] | frozenset[str], upto: frozenset[str]) -> None:
        node = self.top
        while node.parent is not None and node.tag not in tags:
            if node.tag in upto:
                return
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close({"p"}, HOLDS | {"td", "th", "li"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], HOLDS)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.top = self.top.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.top
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)


def tree(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def without_boilerplate(root: Node) -> Node:
    seen_ids: set[str] = set()
    for node in list(root.walk()):
        first_id = node.attrs.get("id") in DROP_IDS and node.attrs["id"] not in seen_ids
        if first_id:
            seen_ids.add(node.attrs["id"])
        if first_id or node.tag in DROP_TAGS or DROP_CLASSES & set(node.classes):
            node.remove()
    return root


def flat_links(root: Node) -> Node:
    """Links become their text; those without text go."""
    for node in list(root.walk()):
        if node.tag == "a" and node.parent is not None:
            words = "".join(t.strip() for t in node.strings())
            node.parent.children = [x for c in node.parent.children for x in ([words] if words else []) * (c is node) + [c] * (c is not node)]
    return root


def _controls(root: Node) -> dict[str, list[Node]]:
    """Toggling buttons and links by the id that they open."""
    found: dict[str, list[Node]] = {}
    for node in root.walk():
        if node.tag in ("button", "a") and node.attrs.get("data-toggle") == "collapse":
            for target in {node.attrs.get(k, "").lstrip("#") for k in ("data-target", "aria-controls")} - {""}:
                found.setdefault(target, []).append(node)
    return found


def is_hidden(node: Node, controls: dict[str, list[Node]]) -> bool:
    """Within something collapsed or hidden."""
    for up in node.ancestors():
        classes = set(up.classes)
        if up.tag in ("div", "section") and any(c.attrs.get("aria-expanded") == "false" or "show" not in classes for c in controls.get(up.attrs.get("id", ""), ())):
            return True
        if up.tag == "details" and "open" not in up.attrs or up.attrs.get("aria-hidden") == "true":
            return True
        if classes & HIDDEN_CLASSES or "collapse" in classes and "show" not in classes:
            return True
    return False


def toggle_title(node: Node, controls: dict[str, list[Node]]) -> str | None:
    """The text of what opens the closest collapsible around the node."""
    for up in node.ancestors():
        if up.tag in ("div", "section"):
            for control in controls.get(up.attrs.get("id", ""), ()):
                if title := control.text():
                    return title
        if up.tag == "details":
            if summary := next((n for n in up.walk() if n.tag == "summary"), None):
                return summary.text()
    return None


def text_elements(page: str | None) -> list[dict]:
    root = tree(page)
    controls = _controls(root)
    rows = []
    for node in root.walk():
        if node.tag in TEXT_TAGS:
            hidden = is_hidden(node, controls)
            rows.append({"pos": len(rows), "tag": node.tag, "text": node.text(), "visible": not hidden, "title": toggle_title(node, controls) if hidden else None})
    return rows


def _sanitised(page: str | None) -> str:
    root = tree(page)
    for node in list(root.walk()):
        if node.tag in UNSAFE_TAGS:
            node.remove()
        node.attrs = {k: v for k, v in node.attrs.items() if k in SAFE_ATTRIBUTES}
    return root.markup()


def knowledge_text(page: str | None) -> str:
    """Headers as # lines, list items as dashes, table rows with bars; other text as it is."""
    root = tree(page)
    for node in list(root.walk()):
        if node.tag in ("script", "style"):
            node.remove()

    def put(node: Node, words: str) -> None:
        node.children, node.tag = [words], ""

    raw = lambda n: "".join(n.strings()).strip()
    nodes = list(root.walk())
    for node in nodes:
        if node.tag in ("h1", "h2", "h3", "h4"):
            put(node, f"\n\n{'#' * int(node.tag[1])} {raw(node)}\n")
    for node in [n for n in root.walk() if n.tag == "li"]:
        put(node, f"- {raw(node)}\n")
    for node in [n for n in root.walk() if n.tag == "table"]:
        lines = [" | ".join(raw(c) for c in row.walk() if c.tag in ("td", "th")) for row in node.walk() if row.tag == "tr"]
        put(node, "\n" + "\n".join(lines) + "\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(root.strings())).strip()


def markdown(page: str | None) -> str:
    """Markdown with # headers: paragraphs, emphasis, links, lists, rules and line breaks."""
    root = tree(page)
    for node in list(root.walk()):
        if node.tag in ("script", "style", "head"):
            node.remove()

    def inline(node: Node | str, depth: int = 0) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        inner = "".join(inline(c, depth + (node.tag in ("ul", "ol"))) for c in node.children)
        word = inner.strip()
        match node.tag:
            case "h1" | "h2" | "h3" | "h4" | "h5" | "h6":
                return f"\n\n{'#' * int(node.tag[1])} {word}\n\n"
            case "b" | "strong":
                return f"**{word}**" if word else ""
            case "i" | "em":
                return f"*{word}*" if word else ""
            case "code":
                return f"`{word}`"
            case "a":
                return f"[{word}]({node.attrs['href']})" if word and node.attrs.get("href") else word
            case "img":
                return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
            case "br":
                return "  \n"
            case "hr":
                return "\n\n---\n\n"
            case "li":
                return f"\n{'  ' * max(0, depth - 1)}* {word}"
            case "p" | "div" | "section" | "article" | "ul" | "ol" | "table" | "blockquote":
                return f"\n\n{inner.strip(' ')}\n\n" if word else ""
            case "tr":
                return "\n| " + " | ".join("".join(inline(c) for c in n.children).strip() for n in node.children if isinstance(n, Node)) + " |"
        return inner

    try:
        text = inline(root)
    except RecursionError:  # nested deeper than any page: its text without marks
        return root.text()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n(?!\S)", "\n", text)).strip()


def header_anchors(page: str | None, least: int = 50) -> list[dict]:
    """h1-h4 with their id, or a made one, and the text up to the next header of the same or a higher level."""
    flow: list[tuple[Node | None, str]] = []
    root = tree(page)
    heads = {id(n): n for n in root.walk() if n.tag in ("h1", "h2", "h3", "h4")}
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            flow.append((None, x))
        elif id(x) in heads:
            flow.append((x, x.text()))
        else:
            todo += reversed(x.children)
    rows = []
    for k, (head, title) in enumerate(flow):
        if head is None:
            continue
        scope = []
        for other, words in flow[k + 1 :]:
            if other is not None and other.tag <= head.tag:
                break
            scope.append(words.strip())
        text = " ".join(s for s in scope if s)
        made = re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", title.lower()))[:50]
        if len(re.sub(r"\W+", " ", text).strip()) >= least:
            rows.append({"id": head.attrs.get("id") or f"synth-{len(rows)}-{made}", "tag": head.tag, "header": title, "scope": text, "native": "id" in head.attrs})
    return rows


def _struct_list(fn, schema: str):  # noqa: ANN001, ANN202
    @arrow_function(schema)
    def udf(pages: pd.Series) -> pd.Series:
        return pages.map(fn)

    return udf


ELEMENT = "array<struct<pos:int,tag:string,text:string,visible:boolean,title:string>>"
elements = _struct_list(text_elements, ELEMENT)
sanitised = _struct_list(_sanitised, "string")
kb_text = _struct_list(knowledge_text, "string")
to_markdown = _struct_list(markdown, "string")
anchors = _struct_list(header_anchors, "array<struct<id:string,tag:string,header:string,scope:string,native:boolean>>")
clean_markup = _struct_list(lambda p: flat_links(without_boilerplate(tree(p))).markup(), "string")
clean_text = _struct_list(lambda p: flat_links(without_boilerplate(tree(p))).text(), "string")
links = _struct_list(lambda p: [{"href": n.attrs["href"], "text": n.text()} for n in tree(p).walk() if n.tag == "a" and n.attrs.get("href")], "array<struct<href:string,text:string>>")
