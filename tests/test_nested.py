import json

from pyspark.sql import functions as F

from tarn.operators import nested as N

TICKET = (
    "rec_id bigint, hash string, canon string, comments array<struct<id:string,author:string,date:string,internal:boolean,body:string,images:array<struct<mime:string,saved_path:string>>,"
    "attachments:array<struct<label:string,saved_path:string>>>>, resolution struct<text:string,comments:array<struct<id:string,author:string,date:string,internal:boolean,body:string,"
    "images:array<struct<mime:string,saved_path:string>>,attachments:array<struct<label:string,saved_path:string>>>>,attachments:array<struct<label:string,saved_path:string>>>, attachments array<struct<filename:string,saved_path:string>>"
)


def paths(spark, payload):
    df = spark.createDataFrame([(1, payload)], "raw_id bigint, payload string")
    return sorted(r["path"] for r in N.occurrences(N.parse_payloads(df)).collect())


def test_typed_places_and_blanks(spark):
    img = ("", "i.png")
    comments = [("1", "a", None, False, "x", [img, None, (None, " ")], None), None, (None, " ", "", None, None, [], [None]), (None, None, None, False, None, None, None)]
    rows = [(1, "clash", "clash", comments, (None, [None], []), [None, ("f", None)]), (1, "", "", comments, ("t", [("9", None, None, None, None, None, [("l", "p")])], None), []), (2, None, None, None, None, None), (3, None, None, [], None, [])]
    got = [(r["row_id"], r["path"]) for r in N.occurrences(N.typed_tickets(spark.createDataFrame(rows, TICKET))).collect()]
    assert sorted(got) == sorted(
        [(1, "comments[0]"), (1, "comments[0].images[0]"), (1, "comments[3]"), (1, "attachments[1]")]
        + [(1, "comments[0]"), (1, "comments[0].images[0]"), (1, "comments[3]"), (1, "resolution"), (1, "resolution.comments[0]"), (1, "resolution.comments[0].attachments[0]")]
    )


def test_equal_objects_are_stored_once_and_linked(spark):
    c = ("1", "a", None, False, "x", [("m", "p")], None)
    b = N.occurrences(N.typed_tickets(spark.createDataFrame([(1, "", "", [c, c], None, None), (2, "", "", [c], None, None)], TICKET)))
    objs = {r["object_hash"]: r["n_occurrences"] for r in N.objects(b).collect()}
    assert sorted(objs.values()) == [3, 3]
    kids = b.where("role = 'images'").collect()
    assert all(k["parent_hash"] in objs and k["ordinal"] == 0 for k in kids)


def test_payload_shapes(spark):
    c = {"id": "1", "body": "x", "attachments": ["a.txt", None, " ", {"label": "b"}]}
    want = ["comments[0]", "comments[0].attachments[0]", "comments[0].attachments[3]"]
    assert paths(spark, json.dumps({"ticket_id": "1", "comments": [c]})) == want
    assert paths(spark, json.dumps({"ok": True, "data": {"ticket": {"ticket_id": 1, "comments": c}}})) == want
    assert paths(spark, json.dumps({"ticket": json.dumps({"ticket_id": "1", "comments": json.dumps([c])})})) == want
    assert paths(spark, json.dumps({"ticket_id": "1", "comments": {"17": None, "9": c}})) == [w.replace("[0]", "[1]", 1) for w in want]
    assert paths(spark, json.dumps({"ticket_id": "1", "resolution": "done", "attachments": "x.pdf", "comments": [{}, {"id": ""}]})) == ["attachments[0]", "resolution"]
    assert paths(spark, json.dumps({"ticket_id": "1", "resolution": json.dumps({"text": "t", "comments": [None, {"id": "5"}]})})) == ["resolution", "resolution.comments[1]"]


def test_unusable_payloads_have_no_rows(spark):
    for bad in (None, "", "  ", "null", "[]", "<html>x</html>", '{"ticket_id": "1", "comments": [{"id": "1"', '"text"', "7", '{"error": "x"}'):
        assert paths(spark, bad) == []


def test_equal_objects_hash_alike_in_both_sources(spark):
    typed = N.occurrences(N.typed_tickets(spark.createDataFrame([(1, "", "", [("1", "a", None, True, "x", None, None)], None, None)], TICKET))).first()
    raw = N.occurrences(N.parse_payloads(spark.createDataFrame([(1, json.dumps({"ticket_id": "1", "comments": [{"body": "x", "internal": True, "author": "a", "id": "1"}]}))], "raw_id bigint, payload string"))).first()
    assert typed["object_hash"] == raw["object_hash"]


def test_empty_tables_and_long_texts(spark):
    assert N.occurrences(N.typed_tickets(spark.createDataFrame([], TICKET))).count() == 0
    assert N.occurrences(N.parse_payloads(spark.createDataFrame([], "raw_id bigint, payload string"))).count() == 0
    big = json.dumps({"ticket_id": "1", "comments": [{"id": str(i), "body": "x" * 1000} for i in range(2000)]})
    df = spark.createDataFrame([(None, big)], "raw_id bigint, payload string")
    assert N.occurrences(N.parse_payloads(df)).where(F.col("row_id").isNull()).count() == 2000


def test_any_depth(spark):
    c = json.dumps({"ticket_id": "1", "comments": [{"id": "1"}]})
    for _ in range(12):
        c = json.dumps(c)
    assert paths(spark, c) == ["comments[0]"]
    deep = {"ticket_id": "1", "attachments": ["a"]}
    for i in range(30):
        deep = {f"k{i}": deep}
    assert paths(spark, json.dumps(deep)) == ["attachments[0]"]


def test_tickets_can_be_rebuilt_from_the_flat_tables(spark):
    """Bridge, heads and flat tables hold everything: each ticket's nesting comes out of them again."""
    leaf = lambda n: {"label": f"l{n}", "saved_path": f"p{n}"}
    one = {"ticket_id": "7", "title": "T", "url": "u", "comments": [{"id": "1", "author": "a", "body": "x", "attachments": [leaf(1), leaf(2)], "images": [{"mime": "m", "saved_path": "q"}]}, {"id": "2", "body": "y", "attachments": [leaf(1)]}], "resolution": {"text": "done", "comments": [{"id": "1", "author": "a", "body": "x"}], "attachments": [leaf(2)]}, "attachments": [{"filename": "f", "saved_path": "r"}]}
    two = {"ticket_id": "8", "title": None, "url": "v", "comments": [one["comments"][0]], "resolution": None, "attachments": []}
    raw = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, "junk")], "raw_id bigint, payload string")
    b = N.occurrences(N.parse_payloads(raw))
    objs = N.objects(b)
    content = {}
    for name in N.TABLES:
        for r in N.flat(objs, name).collect():
            content[r["object_hash"]] = {k: v for k, v in r.asDict().items() if k not in ("object_hash", "kind", "n_occurrences") and v is not None}
    assert len(content) == objs.count()
    built = {}
    for r in sorted(N.bridge_rows(b).collect(), key=lambda r: (r["row_id"], r["path"].count("."), r["role"], r["ordinal"])):
        at = built.setdefault(r["row_id"], {})
        *above, _ = r["path"].split(".")
        for step in above:
            name, _, n = step.partition("[")
            at = at[name][int(n[:-1])] if n else at[name]
        if r["role"] == "resolution":
            at["resolution"] = dict(content[r["object_hash"]])
        else:
            at.setdefault(r["role"], []).append(dict(content[r["object_hash"]]))
    empty = N.heads(spark.createDataFrame([], "rec_id bigint, ticket_id string, title string, url string"), raw)
    heads = {r["row_id"]: r for r in empty.collect()}
    assert sorted(heads) == [1, 2]
    full = lambda t: {k: v for k, v in t.items() if k not in ("ticket_id", "title", "url") and v}
    assert built == {1: full(one), 2: full(two)} and [heads[i]["ticket_id"] for i in (1, 2)] == ["7", "8"] and heads[2]["title"] is None
