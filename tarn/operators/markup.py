"""HTML pages to Markdown, tables and links, with a small tolerant tree builder (Arrow UDFs)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("script style noscript template head".split())
CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 pre blockquote li section article".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
# Note boxes and how they are named, and the names of release-note columns by their headings.
NOTES = {"note": "Note", "warning": "Warning", "tip": "Tip", "info": "Note", "information": "Note"}
HEADERS = {
    "sr. #": "sno", "sr #": "sno", "sr.#": "sno", "s.no": "sno", "sno": "sno", "#": "sno", "no": "sno",
    "task id": "id", "tfs/portal id": "id", "portal/tfs id": "id", "tfs id": "id", "portal id": "id", "id": "id",
    "module": "module", "new feature/ improvement of current feature": "feature_type", "prerequisites": "prerequisites",
    "details": "details", "description": "details", "configuration changes": "config_changes", "key feature": "key_feature", "key features": "key_feature",
    "is there a change to previous behavior?": "behavior_change", "is there a change to previous behaviour?": "behavior_change", "is this feature 'on' by default?": "on_by_default",
}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)

    def walk(self):
        """The node and all below it, in document order."""
        left = [self]
        while left:
            n = left.pop()
            yield n
            left += [k for k in reversed(n.kids) if isinstance(k, Node)]

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else (k.text() if k.tag not in SKIP else "") for k in self.kids)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def content_root(root: Node) -> Node:
    """The first of the usual content holders, else the whole page."""
    for want in (lambda n: n.attrs.get("id") == "main-content", lambda n: "wiki-content" in n.attrs.get("class", "").split(), lambda n: n.attrs.get("id") == "content", lambda n: n.tag == "main", lambda n: n.tag == "article"):
        for n in root.walk():
            if want(n):
                return n
    return root


def squash(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def inline(n: Node | str, base: str = "") -> str:
    if isinstance(n, str):
        return n
    if n.tag in SKIP:
        return ""
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        src = n.attrs.get("src", "")
        return f"![{n.attrs.get('alt', '')}]({src if src.startswith('http') else base + src})"
    inner = "".join(inline(k, base) for k in n.kids)
    bare = squash(inner)
    if not bare:
        return inner
    if n.tag in ("strong", "b"):
        return f"**{bare}**"
    if n.tag in ("em", "i"):
        return f"*{bare}*"
    if n.tag == "code":
        return f"`{bare}`"
    if n.tag == "a":
        href = n.attrs.get("href", "")
        return bare if not href or href.startswith("#") else f"[{bare}]({href})"
    return inner


def table_rows(t: Node) -> list[list[str]]:
    return [[squash("".join(inline(k) for k in c.kids)) for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in t.walk() if r.tag == "tr"]


def table_md(t: Node) -> str:
    rows = [r for r in table_rows(t) if r]
    if not rows:
        return ""
    n = len(rows[0])
    fit = [[*r, *[""] * n][:n] for r in rows]
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(fit[0]), line(["---"] * n), *(line(r) for r in fit[1:])])


def list_md(n: Node, depth: int, base: str) -> str:
    out, no = [], 0
    for k in n.kids:
        if not isinstance(k, Node) or k.tag != "li":
            continue
        no += 1
        head = squash("".join(inline(x, base) for x in k.kids if isinstance(x, str) or x.tag not in ("ul", "ol")))
        out.append("  " * depth + (f"{no}. " if n.tag == "ol" else "- ") + head)
        out += [list_md(x, depth + 1, base) for x in k.kids if isinstance(x, Node) and x.tag in ("ul", "ol")]
    return "\n".join(x for x in out if x)


def blocks(n: Node, base: str = "") -> list[str]:
    """The Markdown blocks of a node's children."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if squash("".join(run)):
            out.append(squash("".join(run)))
        run.clear()

    for k in n.kids:
        if isinstance(k, str) or k.tag in ("a", "b", "strong", "i", "em", "code", "span", "br", "img", "u", "small", "sub", "sup", "label"):
            run.append(inline(k, base))
            continue
        if k.tag in SKIP or k.tag == "nav" or {"toc", "toc-macro", "breadcrumbs", "page-metadata"} & set(k.attrs.get("class", "").split()):
            continue
        flush()
        kind = next((NOTES[c.split("-")[-1]] for c in k.attrs.get("class", "").split() if "macro" in c and c.split("-")[-1] in NOTES), None)
        if kind:
            out.append(f"> **{kind}:** {squash(k.text())}")
        elif re.fullmatch(r"h[1-6]", k.tag):
            if squash(k.text()):
                out.append("#" * int(k.tag[1]) + " " + squash("".join(inline(x, base) for x in k.kids)))
        elif k.tag in ("ul", "ol"):
            out.append(list_md(k, 0, base))
        elif k.tag == "table":
            out.append(table_md(k))
        elif k.tag == "pre":
            out.append("```\n" + k.text().strip("\n") + "\n```")
        elif k.tag == "blockquote":
            out.append("\n".join("> " + x for x in "\n\n".join(blocks(k, base)).split("\n")))
        else:
            out += blocks(k, base)
    flush()
    return [b for b in out if b]


def to_markdown(html: str | None, base: str = "") -> str:
    """A page's content as Markdown; empty for null."""
    return "\n\n".join(blocks(content_root(parse(html)), base))


def header_name(h: str) -> str:
    s = squash(h).lower()
    if s.startswith("risk assessment"):
        return "risk"
    return HEADERS.get(s) or re.sub(r"[^a-z0-9]+", "_", s).strip("_") or "col"


def sections(html: str | None, aliases: dict[str, list[str]]) -> list[tuple[str, int, dict[str, str]]]:
    """Rows of the tables under headings that name a section: (section, row, values); each section is filled once."""
    root = content_root(parse(html))
    flat = [n for n in root.walk() if re.fullmatch(r"h[1-6]|table", n.tag)]
    done: set[str] = set()
    out: list[tuple[str, int, dict[str, str]]] = []
    for i, n in enumerate(flat):
        if n.tag == "table":
            continue
        head = squash(n.text()).lower()
        name = next((s for s, al in aliases.items() if any(head == a or a in head for a in al)), None)
        if head == "table of contents" or name is None or name in done:
            continue
        nxt = flat[i + 1] if i + 1 < len(flat) else None
        if nxt is None or nxt.tag != "table":
            continue
        rows = [r for r in table_rows(nxt) if r]
        if len(rows) < 2:
            continue
        done.add(name)
        names = [header_name(h) for h in rows[0]]
        got = [dict(zip(names, r, strict=False)) for r in rows[1:]]
        out += [(name, k, r) for k, r in enumerate(r for r in got if any(r.values()))]
    return out


def links(html: str | None) -> list[tuple[str, str]]:
    """Distinct (href, text) of anchors in order of first mention."""
    seen: dict[str, str] = {}
    for n in parse(html).walk():
        if n.tag == "a" and n.attrs.get("href"):
            seen.setdefault(n.attrs["href"], squash(n.text()))
    return list(seen.items())


@F.arrow_udf(T.StringType())
def markdown(html: pa.Array) -> pa.Array:
    return pa.array([to_markdown(h) for h in html.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))
def page_links(html: pa.Array) -> pa.Array:
    return pa.array([[{"href": a, "text": b} for a, b in links(h)] for h in html.to_pylist()], pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))
