"""Ticket pages of web portals: fields by their labels, threads, files and what kind of page it is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.markup import Node, parse, squash

# What tells a browser that is gone, and cell values that stand for nothing.
BROWSER_DEAD = ("target closed", "browser has been closed", "browser disconnected", "page closed", "connection closed", "context or browser has been closed")
NOTHING = frozenset(["", "-", "—", "n/a", "[not selected]", "-- select --", "none", "select...", "select one"])
# Labels of the newer portal's fields.
LABELS = {"organization": "organization", "project": "product", "priority": "priority", "category": "category", "severity": "severity", "status": "status", "assigned to": "assignee", "csqa owner": "csqa_owner"}
# Parts of the older portal's labels with the fields they mean, the more specific ones first.
OLD_LABELS = [
    ("ticket id", "title"), ("fx client server details", "environment_details"), ("fxclientserverdetails", "environment_details"), ("fx client server detail", "environment_details"), ("environment", "environment_details"),
    ("total status", "total_status"), ("scope status", "scope_status"), ("status", "status"), ("sqa assign to", "sqa_assignee"), ("assigned to", "assignee"), ("assignee", "assignee"), ("csqa owner", "csqa_owner"),
    ("site1 qa signoff", "site1_qa_signoff"), ("site2 qa signoff", "site2_qa_signoff"), ("dev estimate hrs", "dev_estimate_hrs"), ("qa estimate hrs", "qa_estimate_hrs"), ("dev actual hrs", "dev_actual_hrs"), ("qa actual hrs", "qa_actual_hrs"),
    ("csqa actual hrs", "csqa_actual_hrs"), ("other actual hrs", "other_actual_hrs"), ("estimate start date", "estimate_start_date"), ("estimate dev end date", "estimate_dev_end_date"), ("estimate qa start date", "estimate_qa_start_date"),
    ("estimated qa completion date", "estimated_qa_completion_date"), ("estimated client delivery date", "estimated_client_delivery_date"), ("internal target date", "internal_target_date"), ("tfs id", "tfs_id"), ("delay count", "delay_count"),
    ("delay days", "delay_days"), ("is this ticket parked", "is_parked"), ("release ver", "release_ver"), ("awaiting_production_deployment", "awaiting_production_deployment"), ("project", "product"), ("organization", "organization"),
    ("organisation", "organization"), ("category", "category"), ("priority", "priority"), ("severity", "severity"), ("module", "module"), ("sprint", "sprint"), ("tags", "tags"), ("scope note", "scope_note"), ("type", "ticket_type"),
    ("deployment", "deployment"), ("td client server", "product"),
]
MIME_ENDINGS = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg", "text/plain": "txt", "text/csv": "csv", "application/zip": "zip"}
# The headers of tickets and of the entries of a thread.
_STAMP = r"[\d-]+\s+[\d:]+\s+(?:AM|PM)"
_OLD_CREATED = re.compile(rf"created\s+by\s+(?P<by>\S+)\s+on\s+(?P<at>{_STAMP})", re.IGNORECASE)
_OLD_COMMENT = re.compile(rf"comment\s+(?P<id>\d+)\s+posted\s+by\s+(?P<who>\S+)\s+on\s+(?P<at>{_STAMP})", re.IGNORECASE)
_OLD_EMAIL = re.compile(rf"email\s+(?P<id>\d+)\s+sent\s+to\s+\S+\s+by\s+(?P<who>\S+)\s+on\s+(?P<at>{_STAMP})", re.IGNORECASE)
_NUMBER = re.compile(r"Ticket\s*#\s*(\d+)", re.IGNORECASE)
_CREATED = re.compile(r"Created\s+(?P<at>\d{2}/\d{2}/\d{4})\s+by\s+(?P<by>\S+)", re.IGNORECASE)
_TITLE = re.compile(r"Ticket ID \d+ -\s*(.+)$")
_ENTRY = re.compile(r"comment\s+(\d+)\s+posted\s+by|email\s+(\d+)\s+(?:received\s+from|sent\s+by)", re.IGNORECASE)
_DATE = re.compile(r"[A-Z][a-z]{2,8}\s+\d{1,2},\s+\d{4}\s+at\s+\d{1,2}:\d{2}\s*[AP]M")
_CARD = {"rounded-lg", "border", "bg-white"}
_DROPDOWN = "floating-dropdown-btn"


def cell_value(cell: Node) -> str:
    """What a form cell shows: the chosen option, else the first real one, else an input's value, else its text."""
    options = [n for n in cell.walk() if n.tag == "option"]
    chosen = next((o for o in options if "selected" in o.attrs), None) or next((o for o in options if o.attrs.get("value", "x") not in ("", "0", "-1")), None)
    if chosen:
        return squash(chosen.text())
    for n in cell.walk():
        if n.tag == "input" and n.attrs.get("type", "text") in ("text", "number"):
            v = n.attrs.get("value", "").strip()
            if v and v not in (n.attrs.get("id"), n.attrs.get("name")):
                return v
    plain = Node(cell.tag, kids=[k for k in cell.kids if isinstance(k, str) or k.tag not in ("a", "button", "script", "style", "select", "input")])
    return squash(plain.text())


def _first(node: Node | None, want: Callable[[Node], bool]) -> Node | None:
    return next((n for n in node.walk() if want(n)), None) if node else None


def _placed(node: Node, above: tuple[Node, ...] = ()) -> Iterator[tuple[Node | str, tuple[Node, ...]]]:
    """Every node and text below a node with what it lies in, outermost first, in document order."""
    left: list[tuple[Node | str, tuple[Node, ...]]] = [(node, above)]
    while left:
        n, path = left.pop()
        yield n, path
        if isinstance(n, Node):
            left += [(k, (*path, n)) for k in reversed(n.kids)]


def _spaced(node: Node) -> str:
    """All texts of a node, stripped and with blanks between; scripts and styles have none."""
    parts = (t.strip() for t, path in _placed(node) if isinstance(t, str) and path[-1].tag not in ("script", "style"))
    return " ".join(t for t in parts if t)


def _images(node: Node | None) -> list[dict[str, str]]:
    """Images given in place as data: their type and their data."""
    out = []
    for n in node.walk() if node else ():
        m = re.match(r"data:([^;,]*)[^,]*;base64,(.*)$", n.attrs.get("src", ""), re.DOTALL) if n.tag == "img" else None
        if m:
            out.append({"mime": m[1], "data": m[2]})
    return out


def _cells(row: Node) -> list[Node]:
    return [k for k in row.kids if isinstance(k, Node) and k.tag == "td"]


NO_RESOLUTION: dict[str, object] = {"text": "", "comments": [], "attachments": []}

# ---------------------------------------------------------------- the older portal: forms in tables


def fields(html: str | None, labels: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Values by key: a row's label takes the first free key whose pattern it contains, patterns from the most specific down;
    values that stand for nothing are left out."""
    out: dict[str, str] = {}
    for row in (n for n in parse(html).walk() if n.tag == "tr"):
        cells = _cells(row)
        if len(cells) < 2:
            continue
        label, value = squash(cells[0].text()).rstrip(":").lower(), cell_value(cells[1])
        if not label or value.lower() in NOTHING:
            continue
        key = next((k for pattern, k in labels if pattern in label and k not in out), None)
        if key:
            out[key] = value
    return out


def old_created(html: str | None) -> tuple[str, str]:
    """Who created a ticket, and when, from the label that says so."""
    for row in (n for n in parse(html).walk() if n.tag == "tr"):
        for cell in _cells(row)[:1]:
            if m := _OLD_CREATED.search(squash(cell.text())):
                return m["by"], m["at"].strip()
    return "", ""


def old_comments(html: str | None) -> list[dict[str, object]]:
    """The thread: rows whose first cell holds two tables, the header and the body."""
    out: list[dict[str, object]] = []
    for row in (n for n in parse(html).walk() if n.tag == "tr"):
        cells = _cells(row)
        tables = [k for k in cells[0].kids if isinstance(k, Node) and k.tag == "table"] if cells else []
        if len(tables) != 2:
            continue
        head = squash(tables[0].text())
        if m := _OLD_COMMENT.search(head) or _OLD_EMAIL.search(head):
            out.append({"id": m["id"], "author": m["who"], "date": m["at"].strip(), "internal": "internal" in head.lower(), "body": squash(tables[1].text()), "images": _images(tables[1]), "attachments": []})
    return out


def old_not_found(html: str | None, ticket_id: str) -> bool:
    low = (html or "").lower()
    return f"ticket not found: {ticket_id}" in low or ("ticket not found" in low and ticket_id in (html or ""))


def old_ticket(html: str | None, ticket_id: str, base: str) -> dict[str, object]:
    """A ticket page as a record; empty for pages that say there is no such ticket, and for null."""
    if not html or old_not_found(html, ticket_id):
        return {}
    got: dict[str, object] = dict(fields(html, OLD_LABELS))
    by, at = old_created(html)
    made = {"created_by": by, "created_at": at} if by else {}
    return {"ticket_id": ticket_id, "title": got.pop("title", ""), "url": f"{base.rstrip('/')}/edit_bug.aspx?id={ticket_id}", **made, **got, "comments": old_comments(html), "resolution": NO_RESOLUTION, "attachments": []}


def old_resolution(html: str | None) -> dict[str, object]:
    """The text of the resolution form and the thread below it."""
    root = parse(html)
    if not html or "ticket not found" in root.text().lower():
        return NO_RESOLUTION
    area = _first(root, lambda n: n.tag == "textarea" and n.attrs.get("id") == "txtDescription")
    if area is None:
        form = _first(root, lambda n: n.tag == "form" and "resolutionForm" in (n.attrs.get("id"), n.attrs.get("name")))
        area = _first(form, lambda n: n.tag == "textarea")
    return {"text": squash(area.text()) if area else "", "comments": old_comments(html), "attachments": []}


# ---------------------------------------------------------------- the newer portal: cards


def new_fields(html: str | None) -> dict[str, object]:
    """Labelled dropdowns, the ticket's number, title, creator and whether it awaits deployment."""
    root = parse(html)
    out: dict[str, object] = {}
    for button in (n for n in root.walk() if n.tag == "button" and _DROPDOWN in n.classes):
        label, value = (_first(button, lambda n, c=c: c in n.classes) for c in ("floating-dropdown-label", "floating-dropdown-value"))
        if label and value:
            key, shown = LABELS.get(squash(label.text()).rstrip("*").strip().lower()), squash(value.text())
            if key and shown:
                out.setdefault(key, shown)
    whole = _spaced(root)
    if m := _NUMBER.search(whole):
        out["ticket_id"] = m[1]
    title = _first(root, lambda n: n.tag == "title")
    if title and (m := _TITLE.match(squash(title.text()))):
        out["title"] = m[1].strip()
    if m := _CREATED.search(whole):
        out |= {"created_at": m["at"], "created_by": m["by"]}
    box = _first(root, lambda n: n.tag == "input" and n.attrs.get("type") == "checkbox")
    return out | {"awaiting_production_deployment": bool(box and "checked" in box.attrs)}


def _downloads(node: Node, above: tuple[Node, ...], icons_only: bool) -> list[str]:
    """The file names of the download controls below a node; icons have the word as their title only."""
    out = []
    for n, path in _placed(node, above):
        if not isinstance(n, Node) or n.tag not in ("button", "a"):
            continue
        icon = n.attrs.get("title", "").strip().strip('"').strip().lower() == "download"
        if icon or (not icons_only and squash(n.text()).lower() == "download"):
            card = next((p for p in reversed(path) if p.tag == "div" and "rounded-lg" in p.attrs.get("class", "")), None)
            out.append(_file_name(card or next((p for p in reversed(path) if p.tag == "div" and "mt-3" in p.classes), None) or node))
    return out


def _file_name(card: Node) -> str:
    wants = (lambda n: n.tag == "p" and "break-words" in n.classes, lambda n: n.tag == "p" and "text-sm" in n.classes, lambda n: n.tag == "h4", lambda n: "filename" in n.classes, lambda n: n.tag == "div" and "min-w-0" in n.classes)
    return next((name for want in wants if (found := _first(card, want)) and (name := squash(found.text()))), "")


def _thread(node: Node, above: tuple[Node, ...] = ()) -> list[dict[str, object]]:
    """The entries of a thread: cards with a header that is not itself within a body, in page order, each once."""
    cards: dict[int, tuple[Node, tuple[Node, ...]]] = {}
    for text, path in _placed(node, above):
        if isinstance(text, str) and _ENTRY.search(text) and not any("comment-html-content" in p.classes for p in path):
            at = next((i for i in range(len(path) - 1, -1, -1) if path[i].classes >= _CARD), None)
            if at is not None:
                cards.setdefault(id(path[at]), (path[at], path[:at]))
    return [entry for card, path in cards.values() if (entry := _entry(card, path))]


def _entry(card: Node, above: tuple[Node, ...]) -> dict[str, object] | None:
    inside = list(_placed(card, above))
    at = next((i for i, (t, path) in enumerate(inside) if isinstance(t, str) and _ENTRY.search(t) and not any("comment-html-content" in p.classes for p in path)), None)
    if at is None:
        return None
    m = _ENTRY.search(inside[at][0])
    who = next((n for n, _ in inside[at:] if isinstance(n, Node) and n.tag == "a"), None)
    body = _first(card, lambda n: n.tag == "div" and "comment-html-content" in n.classes) or _first(card, lambda n: n.tag == "div" and "max-w-none" in n.classes)
    lines = [ln.strip() for t, _ in (_placed(body) if body else ()) if isinstance(t, str) for ln in t.splitlines()]
    date = _DATE.search(_spaced(card))
    return {
        "id": m[1] or m[2], "author": squash(who.text()) if who else "", "date": date[0] if date else "", "internal": any(n.tag in ("span", "div") and squash(n.text()) == "Internal" for n in card.walk()),
        "body": "\n".join(ln for ln in lines if ln), "images": _images(body), "attachments": [{"label": f} for f in _downloads(card, above, False)],
    }


def new_not_found(html: str | None) -> bool:
    """Whether a page is no ticket: without dropdowns and without a ticket's number."""
    root = parse(html)
    return not _first(root, lambda n: n.tag == "button" and _DROPDOWN in n.classes) and not _NUMBER.search(_spaced(root))


def new_ticket(html: str | None, ticket_id: str, base: str) -> dict[str, object]:
    """A ticket page as a record; empty for pages that are none."""
    if not html or new_not_found(html):
        return {}
    got = new_fields(html)
    return {**got, "ticket_id": got.get("ticket_id") or ticket_id, "url": f"{base.rstrip('/')}/tickets/{ticket_id}/edit", "comments": _thread(parse(html))}


def new_resolution(html: str | None) -> dict[str, object]:
    """The resolution panel: its text, its thread and its files."""
    found = next(((n, path) for n, path in _placed(parse(html)) if isinstance(n, Node) and n.tag == "div" and "resolution-container" in n.classes), None)
    if found is None:
        return NO_RESOLUTION
    region, above = found
    post = _first(region, lambda n: n.tag == "div" and "post-content" in n.classes)
    return {"text": squash(_spaced(post)) if post else "", "comments": _thread(region, above), "attachments": [{"label": f} for f in _downloads(region, above, True)]}


def new_files(html: str | None) -> list[dict[str, str]]:
    """The entries of the files panel."""
    return [{"label": f} for f in _downloads(parse(html), (), True) if f]


TICKET = "struct<ticket_id:string,title:string,url:string,created_by:string,created_at:string,fields:map<string,string>,comments:array<struct<id:string,author:string,date:string,internal:boolean,body:string,images:array<struct<mime:string,data:string>>,attachments:array<struct<label:string>>>>>"


def ticket_records(pages: DataFrame, html: str = "html", ticket_id: str = "ticket_id", base: str = "base", old: bool = False) -> DataFrame:
    """The pages with ``record``, null for pages that are no tickets; the labelled values are in ``record.fields``."""
    kind = pa.struct([
        *((n, pa.string()) for n in ("ticket_id", "title", "url", "created_by", "created_at")), ("fields", pa.map_(pa.string(), pa.string())),
        ("comments", pa.list_(pa.struct([*((n, pa.string()) for n in ("id", "author", "date")), ("internal", pa.bool_()), ("body", pa.string()), ("images", pa.list_(pa.struct([("mime", pa.string()), ("data", pa.string())]))), ("attachments", pa.list_(pa.struct([("label", pa.string())])))]))),
    ])
    own = ("ticket_id", "title", "url", "created_by", "created_at", "comments", "resolution", "attachments", "awaiting_production_deployment")

    def record(page: str | None, no: str | None, at: str | None) -> dict[str, object] | None:
        got = (old_ticket if old else new_ticket)(page, no or "", at or "")
        return {**{k: got.get(k) for k in own[:6]}, "fields": [(k, v) for k, v in got.items() if k not in own]} if got else None

    @F.arrow_udf(TICKET)
    def read(page: pa.Array, no: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([record(*x) for x in zip(page.to_pylist(), no.to_pylist(), at.to_pylist(), strict=True)], type=kind)

    return pages.withColumn("record", read(html, ticket_id, base))


def is_login(html: Column) -> Column:
    """The newer portal's sign-in page: it says so and has no fields of a ticket."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return _any(low, ("sign in", "/login")) & ~low.contains(_DROPDOWN)


def is_old_login(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return low.contains('id="user"') & low.contains('id="pw"')


def is_browser_dead(message: Column) -> Column:
    return _any(F.lower(F.coalesce(message, F.lit(""))), BROWSER_DEAD)


def _any(text: Column, signals: Sequence[str]) -> Column:
    hit = F.lit(False)
    for s in signals:
        hit = hit | text.contains(s)
    return hit


def attachment_name(disposition: Column, label: Column, mime: Column, number: Column) -> Column:
    """The server's name, else a label with an ending, else a number with the ending of the type."""
    given = F.nullif(F.regexp_extract(F.coalesce(disposition, F.lit("")), r'filename="?([^";]+)"?', 1), F.lit(""))
    named = F.when((F.length(label) <= 120) & label.rlike(r"\.[A-Za-z0-9]{1,8}$"), label)
    ending = F.coalesce(F.create_map(*(F.lit(x) for kv in MIME_ENDINGS.items() for x in kv))[mime], F.lit("bin"))
    return F.coalesce(given, named, F.concat(F.lit("attachment_"), number.cast("string"), F.lit("."), ending))


def unique_names(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names made unique per folder: _1, _2, ... before the ending, in order."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order)) - 1
    stem, dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 1)
    return files.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), dot)))


def unique_versions(pages: DataFrame, version: str, title: str, order: str) -> DataFrame:
    """Versions made unique in listing order: a repeated one gets its title's slug, a repeated pair also a number."""
    from tarn.functions.text import slug

    again = F.row_number().over(Window.partitionBy(version).orderBy(order)) > 1
    with_tail = F.when(again, F.concat(F.col(version), F.lit("-"), slug(F.col(title), "x"))).otherwise(F.col(version))
    rows = pages.withColumn("_v", with_tail)
    k = F.row_number().over(Window.partitionBy("_v").orderBy(order)) - 1
    return rows.withColumn("unique_version", F.when(k == 0, F.col("_v")).otherwise(F.concat("_v", F.lit("-"), k.cast("string")))).drop("_v")


def match_files(labels: DataFrame, downloads: DataFrame, on: str = "filename") -> DataFrame:
    """Labels with the path of the file of that name; of repeated names the last download counts."""
    last = downloads.groupBy(on).agg(F.max_by("saved_path", "seq").alias("saved_path"))
    return labels.join(last, on, "left")
