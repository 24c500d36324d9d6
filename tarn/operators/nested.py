"""Nested ticket records as related flat tables, by Merkle subtree identities.

Every object of a ticket (comment, image, attachment, resolution) is canonicalised and hashed bottom-up: an
object's hash covers its own scalar fields and the hashes of its children, so equal subtrees have equal hashes
wherever they occur.  :func:`objects` stores each distinct subtree once; :func:`occurrences` is the bridge with
one row per place an object is found at, with the hash of its parent, its role and its ordinal.

Typed tickets stay in the JVM throughout.  JSON payloads, whose shape drifts, are first brought to the same typed
shape by one Arrow UDF, then take the same plan.

Defined results: null elements and blank objects (only nulls, blank strings, empty or likewise blank lists and
objects) give no row but keep their ordinal; a null or empty list gives none; repeated rows and equal objects give
one occurrence per place; a payload that is no complete JSON ticket gives none; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = "label string, filename string, mime string, saved_path string, rest string"
COMMENT = f"id string, author string, date string, internal string, body string, rest string, images array<struct<{LEAF}>>, attachments array<struct<{LEAF}>>"
RECORD = f"comments array<struct<{COMMENT}>>, resolution struct<text string, rest string, comments array<struct<{COMMENT}>>, attachments array<struct<{LEAF}>>>, attachments array<struct<{LEAF}>>"

LEAF_FIELDS = ("label", "filename", "mime", "saved_path")
COMMENT_FIELDS = ("id", "author", "date", "internal", "body")
CHILD_LISTS = {"comment": ("images", "attachments"), "resolution": ("comments", "attachments"), "leaf": ()}
#: Field names that tell a lone object from an object keyed by ids.
OWN_KEYS = {
    "leaf": {*LEAF_FIELDS, "data", "name", "url", "type", "size"},
    "comment": {*COMMENT_FIELDS, "images", "attachments", "type"},
    "resolution": {"text", "comments", "attachments"},
}
TICKET_KEYS = {"ticket_id", "comments", "resolution", "attachments"}


# ---------------------------------------------------------------- JSON payloads to the typed shape


def decoded(value: Any) -> Any:
    """What a JSON string stands for, through any number of encodings; other values as they are.

    Every decoding leaves a shorter string, so it ends."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def as_list(value: Any, kind: str) -> list[Any]:
    """The elements of a child list, whatever shape it was stored in."""
    value = decoded(value)
    if value is None:
        return []
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value and not (value.keys() & OWN_KEYS[kind]) and all(v is None or isinstance(v, dict | str | list) for v in value.values()):
        return [{"id": key, **x} if kind == "comment" and isinstance(x := decoded(v), dict) and x and not blank(x) else v for key, v in value.items()]
    return [value]


def blank(value: Any) -> bool:
    if value is None or isinstance(value, str):
        return not (value or "").strip()
    if isinstance(value, list):
        return all(map(blank, value))
    return isinstance(value, dict) and all(map(blank, value.values()))


def text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def shaped(value: Any, kind: str) -> dict[str, Any] | None:
    """One object in the typed shape; what the shape has no field for goes to ``rest`` as canonical JSON."""
    value = decoded(value)
    if value is None or blank(value):
        return None
    fields = {"leaf": LEAF_FIELDS, "comment": COMMENT_FIELDS, "resolution": ("text",)}[kind]
    if not isinstance(value, dict):
        main = {"leaf": "label", "comment": "body", "resolution": "text"}[kind]
        return {main: text(value)}
    out: dict[str, Any] = {f: text(value.get(f)) for f in fields}
    for child in CHILD_LISTS[kind]:
        out[child] = [shaped(x, "comment" if child == "comments" else "leaf") for x in as_list(value.get(child), "comment" if child == "comments" else "leaf")]
    rest = {k: v for k, v in value.items() if k not in fields and k not in CHILD_LISTS[kind] and not blank(v)}
    out["rest"] = text(rest) if rest else None
    return out


def find_ticket(value: Any) -> dict[str, Any] | None:
    """The ticket in a payload, inside any envelope however deep: the first in stored order."""
    left = [value]
    while left:
        now = decoded(left.pop())
        if isinstance(now, dict):
            if now.keys() & TICKET_KEYS:
                return now
            left += reversed(now.values())
        elif isinstance(now, list) and len(now) == 1:
            left.append(now[0])
    return None


def payload_ticket(payload: str | None) -> dict[str, Any] | None:
    """The ticket a payload holds; null where it is unusable."""
    if not payload or not payload.strip():
        return None
    try:
        return find_ticket(json.loads(payload.lstrip("\ufeff")))
    except (ValueError, RecursionError):
        return None


def shaped_payload(payload: str | None) -> dict[str, Any] | None:
    ticket = payload_ticket(payload)
    if ticket is None:
        return None
    return {
        "comments": [shaped(x, "comment") for x in as_list(ticket.get("comments"), "comment")],
        "resolution": shaped(ticket.get("resolution"), "resolution"),
        "attachments": [shaped(x, "leaf") for x in as_list(ticket.get("attachments"), "leaf")],
    }


def _arrow_types() -> pa.DataType:
    s = pa.string()
    leaf = pa.struct([(f, s) for f in (*LEAF_FIELDS, "rest")])
    comment = pa.struct([*((f, s) for f in (*COMMENT_FIELDS, "rest")), ("images", pa.list_(leaf)), ("attachments", pa.list_(leaf))])
    resolution = pa.struct([("text", s), ("rest", s), ("comments", pa.list_(comment)), ("attachments", pa.list_(leaf))])
    return pa.struct([("comments", pa.list_(comment)), ("resolution", resolution), ("attachments", pa.list_(leaf))])


def parse_payloads(raw: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """``src, row_id`` and the typed record of each JSON payload; null parts where it is unusable."""
    kind = _arrow_types()

    @F.arrow_udf(f"struct<{RECORD.replace(' array', ':array').replace(' struct', ':struct').replace(' string', ':string')}>")
    def shape(payloads: pa.Array) -> pa.Array:
        return pa.array([shaped_payload(p) for p in payloads.to_pylist()], type=kind)

    rec = raw.select(F.lit("ticket_raw").alias("src"), F.col(id_col).cast("bigint").alias("row_id"), shape(F.col(payload_col)).alias("r"))
    return rec.select("src", "row_id", "r.comments", "r.resolution", "r.attachments")


# The expressions below are written as SQL text: one parse instead of thousands of calls from Python.


def _typed_leaf(x: str, *have: str) -> str:
    fields = ", ".join(f"'{f}', {f'{x}.{f}' if f in have else 'cast(null as string)'}" for f in (*LEAF_FIELDS, "rest"))
    return f"if({x} is null, null, named_struct({fields}))"


def _typed_comment(x: str) -> str:
    fields = ", ".join(f"'{f}', cast({x}.{f} as string)" for f in COMMENT_FIELDS)
    lists = f"'images', transform({x}.images, i -> {_typed_leaf('i', 'mime', 'saved_path')}), 'attachments', transform({x}.attachments, a -> {_typed_leaf('a', 'label', 'saved_path')})"
    return f"if({x} is null, null, named_struct({fields}, 'rest', cast(null as string), {lists}))"


def typed_tickets(tickets: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """``src, row_id`` and the record of tickets whose columns are already typed, in the same shape."""
    resolution = f"""named_struct('text', resolution.text, 'rest', cast(null as string), 'comments', transform(resolution.comments, c -> {_typed_comment('c')}),
      'attachments', transform(resolution.attachments, a -> {_typed_leaf('a', 'label', 'saved_path')}))"""
    return tickets.selectExpr(
        "'ticket' as src",
        f"cast(`{id_col}` as bigint) as row_id",
        f"transform(comments, c -> {_typed_comment('c')}) as comments",
        f"if(resolution is null, null, {resolution}) as resolution",
        f"transform(attachments, a -> {_typed_leaf('a', 'filename', 'saved_path')}) as attachments",
    )


# ---------------------------------------------------------------- bottom-up hashing

_NODE = "struct<hash:string,canon:string,role:string,kind:string,ordinal:int>"
_PARENT = _NODE[:-1] + f",images:array<{_NODE}>,attachments:array<{_NODE}>>"


def _hashed(kind: str, fields: tuple[str, ...], x: str, ordinal: str, role: str, lists: dict[str, str]) -> str:
    """A hashed object: its canonical JSON holds its non-blank scalars and its children's hashes in order.

    Blank objects have no hash.  The JSON is bound once by a lambda, as every other use would compute it anew."""
    scalars = "".join(f", '{f}', if({x}.{f} rlike r'(?U)\\S', {x}.{f}, null)" for f in fields)
    kids = "".join(f", '{f}', if(exists({c}, k -> k.hash is not null), transform({c}, k -> k.hash), null)" for f, c in lists.items())
    canon = f"""if({x} is null, null, nullif(to_json(named_struct('kind', '{kind}'{scalars}{kids})), '{{"kind":"{kind}"}}'))"""
    kept = "".join(f", '{f}', {c}" for f, c in lists.items())
    return f"transform(array({canon}), j -> named_struct('hash', sha2(j, 256), 'canon', j, 'role', '{role}', 'kind', '{kind}', 'ordinal', {ordinal}{kept}))[0]"


def _leaves(xs: str, kind: str, role: str) -> str:
    return f"coalesce(transform({xs}, (l, m) -> {_hashed(kind, (*LEAF_FIELDS, 'rest'), 'l', 'm', role, {})}), cast(array() as array<{_NODE}>))"


def _comments(xs: str) -> str:
    # Two passes: the leaves of every comment are hashed once, then the comments over them.
    first = f"transform({xs}, (x, i) -> named_struct('x', x, 'i', i, 'images', {_leaves('x.images', 'image', 'images')}, 'attachments', {_leaves('x.attachments', 'attachment', 'attachments')}))"
    one = _hashed("comment", (*COMMENT_FIELDS, "rest"), "c.x", "c.i", "comments", {"images": "c.images", "attachments": "c.attachments"})
    return f"coalesce(transform({first}, c -> {one}), cast(array() as array<{_PARENT}>))"


def _occ(prefix: str, n: str, parent: str, indexed: bool = True) -> str:
    path = f"concat({prefix}, {n}.role, '[', {n}.ordinal, ']')" if indexed else f"{n}.role"
    return f"named_struct('path', {path}, 'parent_hash', cast({parent} as string), 'object_hash', {n}.hash, 'role', {n}.role, 'kind', {n}.kind, 'ordinal', {n}.ordinal, 'canon', {n}.canon)"


def _comment_occs(prefix: str, comments: str, parent: str) -> str:
    here = f"concat('{prefix}comments[', c.ordinal, '].')"
    kids = ", ".join(f"transform(c.{f}, n -> {_occ(here, 'n', 'c.hash')})" for f in CHILD_LISTS["comment"])
    return f"flatten(transform({comments}, c -> concat(array({_occ(repr(prefix), 'c', parent)}), {kids})))"


def occurrences(records: DataFrame) -> DataFrame:
    """The bridge: one row per object and place.

    ``src, row_id, path, parent_hash, object_hash, role, kind, ordinal, canon``; ``parent_hash`` is null for
    children of the ticket itself, ``ordinal`` is the position from 0 in stored order (0 for the resolution).
    """
    hashed = records.selectExpr(
        "src", "row_id", f"{_comments('comments')} as comments", f"{_leaves('attachments', 'attachment', 'attachments')} as attachments", "resolution as res",
        f"{_comments('resolution.comments')} as res_comments", f"{_leaves('resolution.attachments', 'attachment', 'attachments')} as res_attachments",
    )
    res = _hashed("resolution", ("text", "rest"), "res", "0", "resolution", {"comments": "res_comments", "attachments": "res_attachments"})
    whole = hashed.selectExpr("src", "row_id", "comments", "attachments", f"{res} as n")
    places = f"""concat({_comment_occs('', 'comments', 'null')}, transform(attachments, a -> {_occ("''", 'a', 'null')}), array({_occ("''", 'n', 'null', indexed=False)}),
      {_comment_occs('resolution.', 'n.comments', 'n.hash')}, transform(n.attachments, a -> {_occ("'resolution.'", 'a', 'n.hash')}))"""
    return whole.selectExpr("src", "row_id", f"explode(filter({places}, o -> o.object_hash is not null)) as o").select("src", "row_id", "o.*")


def objects(bridge: DataFrame) -> DataFrame:
    """Each distinct object once: ``object_hash, kind, canon`` and how often it occurs."""
    return bridge.groupBy("object_hash").agg(F.first("kind").alias("kind"), F.first("canon").alias("canon"), F.count(F.lit(1)).alias("n_occurrences"))


def bridge_rows(bridge: DataFrame) -> DataFrame:
    """The bridge without the objects' content."""
    return bridge.drop("canon")


# ---------------------------------------------------------------- flat tables

HEAD = ("ticket_id", "title", "url")


def heads(tickets: DataFrame, raw: DataFrame) -> DataFrame:
    """The tickets the bridge's rows belong to: ``src, row_id, ticket_id, title, url``; unusable payloads have no row.

    A ticket scraped twice has a row for each of its ids, as the bridge has."""

    @F.arrow_udf("struct<ok:boolean,ticket_id:string,title:string,url:string>")
    def head(payloads: pa.Array) -> pa.Array:
        got = [payload_ticket(p) for p in payloads.to_pylist()]
        return pa.array([{"ok": t is not None, **{f: text((t or {}).get(f)) for f in HEAD}} for t in got], type=pa.struct([("ok", pa.bool_()), *((f, pa.string()) for f in HEAD)]))

    typed = tickets.select(F.lit("ticket").alias("src"), F.col("rec_id").cast("bigint").alias("row_id"), *HEAD)
    parsed = raw.select(F.lit("ticket_raw").alias("src"), F.col("raw_id").cast("bigint").alias("row_id"), head("payload").alias("h")).where("h.ok")
    return typed.unionByName(parsed.select("src", "row_id", *(f"h.{f}" for f in HEAD)))


#: The flat tables of objects, their kinds and columns; ``rest`` holds what a record had beyond them.
TABLES = {
    "comments": (("comment",), (*COMMENT_FIELDS, "rest")),
    "resolutions": (("resolution",), ("text", "rest")),
    "files": (("image", "attachment"), (*LEAF_FIELDS, "rest")),
}


def flat(objects_of: DataFrame, name: str) -> DataFrame:
    """One of :data:`TABLES`, a row per distinct object: ``object_hash, kind``, the columns and ``n_occurrences``."""
    kinds, fields = TABLES[name]
    own = objects_of.where(F.col("kind").isin(*kinds))
    got = own.withColumn("_o", F.from_json("canon", ", ".join(f"`{f}` string" for f in fields)))
    return got.select("object_hash", "kind", *(F.col(f"_o.{f}").alias(f) for f in fields), "n_occurrences")
