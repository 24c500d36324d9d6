from pyspark.sql import functions as F

from tarn.operators import answering as A
from tarn.operators import portal as P

CONTEXT = "query_id bigint, doc_id bigint, rank int, kind string, ticket_id string, title string, url string, text string, created_at string, product string, category string"


def test_context(spark):
    ctx = spark.createDataFrame([(1, 10, 1, "ticket", "t", "T", "u", "frag b", None, "api", None), (1, 11, 2, "article", None, "A", "http://a", "art", None, "api", None), (1, 12, 3, "ticket", "t", "T", "u", "frag a", None, "api", None), (2, 10, 1, "ticket", "t", "T", "", "frag b", None, "api", None)], CONTEXT)
    chunks = spark.createDataFrame([("t", 0, "H\n\none"), ("t", 1, "H\n\ntwo"), ("z", 0, "no")], "ticket_id string, chunk_index int, text string")
    got = {(r["query_id"], r["doc_id"]): r["text"] for r in A.expand_tickets(ctx, chunks).collect()}
    assert got == {(1, 10): "H\n\none\n\ntwo", (1, 11): "art", (2, 10): "H\n\none\n\ntwo"}
    quick = spark.createDataFrame([(2, 20, 1, "article", None, "B", "", "x", None, "api", None), (2, 21, 2, "article", None, "C", "http://c", "y", None, "api", None), (3, 22, 1, "article", None, "D", "http://d", "z", None, "api", None)], CONTEXT)
    more = A.ensure_kind(ctx, quick, "article", F.trim("url") != "")
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in more.collect())[-1] == (2, 21, 2) and more.count() == 5
    want = "CONTEXT (the only facts you may use):\n\n1. [Ticket #t · API](u)\n   frag b\n\n2. [API · general · A](http://a)\n   art\n\n3. [Ticket #t · API](u)\n   frag a\n"
    assert A.context_text(ctx).where("query_id = 1").first()["context"] == want
    answers = spark.createDataFrame([(1, "see [A](http://a) and [B](http://b(1)) and [B](http://b(1))"), (2, "none"), (3, None)], "query_id bigint, answer string")
    v = {r["query_id"]: r for r in A.validate_citations(answers, ctx.select("query_id", "url")).collect()}
    assert (len(v[1]["verified"]), len(v[1]["unverified"]), v[1]["stripped_text"]) == (1, 2, "see [A](http://a) and [unverified] and [unverified]")
    assert v[2]["all_verified"] and v[3]["stripped_text"] == ""
    rel = spark.createDataFrame([(1, 30, 1, "ticket", "x", "", "", "", "2024-01-01", None, None), (1, 31, 2, "ticket", "y", "", "", "", "2024-03-01", None, None), (1, 32, 3, "ticket", "t", "", "", "", "2025-01-01", None, None), (1, 33, 4, "ticket", "z", "", "", "", None, "api", None)], CONTEXT)
    assert [r["ticket_id"] for r in A.related_tickets(ctx, rel).orderBy("place").collect()] == ["y", "x"]
    assert A.suggestions(ctx).where("query_id = 1").first()["suggestions"] == "• [T](u)  — API · \n• [A](http://a)  — API · "


def test_decisions_and_messages(spark):
    rows = [(0.5, False, False, False, True), (0.5, True, False, False, True), (0.5, True, True, False, True), (0.01, True, False, True, True), (0.03, True, False, False, True), (0.03, False, False, True, True), (0.03, False, False, False, True), (0.03, False, False, False, False)]
    df = spark.createDataFrame(rows, "a double, b boolean, c boolean, d boolean, e boolean")
    assert [r[0] for r in df.select(A.decision(*(F.col(c) for c in "abcde"))).collect()] == ["answer", "clarification", "answer", "out_of_scope", "clarification", "clarification", "suggestions", "abstain"]
    one = spark.createDataFrame([([1, 2, 3], [4, 5], ' "Find it"\nrest', "q", "x" * 30_000)], "p array<int>, t array<int>, r string, q string, att string")
    r = one.select(A.tail_labels(F.col("p"), F.col("t"), 4).alias("l"), A.clean_rewrite(F.col("r")).alias("r"), A.messages(F.lit(None).cast("array<struct<role:string,content:string>>"), F.col("q"), F.col("att")).alias("m")).first()
    assert r["l"]["ids"] == [2, 3, 4, 5] and r["l"]["labels"] == [-100, -100, 4, 5] and r["r"] == "Find it" and len(r["m"][0]["content"]) == 20_003
    ev = spark.createDataFrame([("r", 1, '{"type":"m","message":"a"}'), ("r", 2, "junk"), ("r", 3, '{"type":"m","message":"b","usage":{"input_tokens":2,"output_tokens":3,"reasoning_tokens":4}}')], "run string, seq int, line string")
    assert tuple(A.event_lines(ev, "run", "seq", "line").first()) == ("r", "b", 2, 7, None)
    f = spark.createDataFrame([("o", 1, "a.png", 10), ("o", 2, "b.exe", 1), ("o", 3, "c.txt", 2 << 20), ("o", 4, "d.txt", 5), ("o", 5, "e.png", 5)], "o string, i int, name string, bytes bigint")
    assert [r["name"] for r in A.admitted(f, "o", "i", 2, ["png", "txt"]).collect()] == ["a.png", "d.txt"]
    q = spark.createDataFrame([("a",), ("b",)], "question string")
    rec = spark.createDataFrame([([("user", "x"), ("user", "a"), ("assistant", "y")],)], "messages array<struct<role:string,content:string>>")
    assert [r[0] for r in A.undistilled(q, rec).collect()] == ["b"]


OLD = """<table><tr><td>Total Status:</td><td><select><option value="">-</option><option selected>Open</option></select></td></tr><tr><td>Status</td><td><input name=s value="New"></td></tr>
<tr><td>CSQA Owner:</td><td>Ann <a href="#">edit</a></td></tr><tr><td>Severity</td><td>N/A</td></tr><tr><td>Created by joe on 2024-01-02 10:00:00 AM</td><td></td></tr>
<tr><td><table><tr><td>Internal comment 12 posted by bob on 2024-01-03 11:00:00 PM</td></tr></table><table><tr><td>The file was <b>not found</b><img src="data:image/png;base64,AA=="></td></tr></table></td></tr>
<tr><td><table><tr><td>email 13 sent to a@b.example by eve on 2024-01-04 1:00:00 AM</td></tr></table><table><tr><td></td></tr></table></td></tr></table>"""
CARD = '<div class="p-2 rounded-lg border bg-white"><span>{head} </span><a>{who}</a> on Jan 3, 2024 at 4:05 PM {badge}<div class="comment-html-content"><p>{body}</p></div>{files}</div>'
NEW = (
    "<html><head><title>Ticket ID 77 - Rates are late</title></head><body><h1>Ticket #77</h1> Created 01/02/2024 by joe "
    '<button class="floating-dropdown-btn"><span class="floating-dropdown-label">Status<i>*</i></span><span class="floating-dropdown-value">Open</span></button>'
    '<button class="floating-dropdown-btn"><span class="floating-dropdown-label">Project</span><span class="floating-dropdown-value"> Trade  Desk </span></button><input type="checkbox" checked>'
    + CARD.format(head="comment 5 posted by", who="Bob", badge="<span>Internal</span>", body="It is done.</p><p>comment 9 posted by nobody", files='<div class="mt-3"><p class="text-sm">a.txt</p><button>Download</button></div>')
    + CARD.format(head="email 6 received from", who="Eve", badge="", body="internal words", files="")
    + "</body></html>"
)


def test_portal(spark):
    got = P.old_ticket(OLD, "9", "http://t/")
    assert (got["total_status"], got["status"], got["csqa_owner"], "severity" in got, got["created_by"], got["created_at"], got["url"]) == ("Open", "New", "Ann", False, "joe", "2024-01-02 10:00:00 AM", "http://t/edit_bug.aspx?id=9")
    assert [(c["id"], c["author"], c["internal"], c["body"], len(c["images"])) for c in got["comments"]] == [("12", "bob", True, "The file was not found", 1), ("13", "eve", False, "", 0)]
    assert P.old_ticket("<p>Ticket not found: 9</p>", "9", "u") == P.old_ticket(None, "9", "u") == P.new_ticket("<p>All tickets</p>", "9", "u") == {}
    assert P.old_resolution('<form name="resolutionForm"><textarea> it  works </textarea></form>')["text"] == "it works" and P.old_resolution("Ticket not found") == P.NO_RESOLUTION
    new = P.new_ticket(NEW, "70", "http://s")
    assert (new["ticket_id"], new["title"], new["status"], new["product"], new["created_at"], new["created_by"], new["awaiting_production_deployment"]) == ("77", "Rates are late", "Open", "Trade Desk", "01/02/2024", "joe", True)
    assert [(c["id"], c["author"], c["date"], c["internal"], c["attachments"]) for c in new["comments"]] == [("5", "Bob", "Jan 3, 2024 at 4:05 PM", True, [{"label": "a.txt"}]), ("6", "Eve", "Jan 3, 2024 at 4:05 PM", False, [])]
    assert new["comments"][0]["body"] == "It is done.\ncomment 9 posted by nobody"
    panel = '<div class="resolution-container"><div class="post-content">Use <b>it</b></div><div class="rounded-lg"><p class="break-words">r.pdf</p><button title="Download"></button></div></div>'
    assert P.new_resolution(panel) == {"text": "Use it", "comments": [], "attachments": [{"label": "r.pdf"}]} and P.new_files(panel) == [{"label": "r.pdf"}] and P.new_resolution(NEW) == P.NO_RESOLUTION
    pages = spark.createDataFrame([(NEW, "77", "http://s"), ("<p>x</p>", "1", "u"), (None, None, None)], "html string, ticket_id string, base string")
    recs = [r["record"] for r in P.ticket_records(pages).collect()]
    assert recs[0]["fields"] == {"status": "Open", "product": "Trade Desk"} and len(recs[0]["comments"]) == 2 and recs[1:] == [None, None]
    f = spark.createDataFrame([("d", "a.txt", 1), ("d", "a.txt", 2), ("d", "b", 3), ("d", "b", 4), ("e", "a.txt", 5)], "folder string, name string, i int")
    assert [r["unique_name"] for r in P.unique_names(f, "folder", "name", "i").orderBy("i").collect()] == ["a.txt", "a_1.txt", "b", "b_1", "a.txt"]
    v = spark.createDataFrame([("1.2.3", "x", 1), ("1.2.3", "Ext A", 2), ("1.2.3", "Ext A", 3)], "v string, t string, i int")
    assert [r["unique_version"] for r in P.unique_versions(v, "v", "t", "i").orderBy("i").collect()] == ["1.2.3", "1.2.3-ext_a", "1.2.3-ext_a-1"]
    d = spark.createDataFrame([('attachment; filename="x.pdf"', None, None, 1), (None, "r.csv", None, 2), (None, "no ending", "image/png", 3)], "d string, l string, m string, n int")
    assert [r[0] for r in d.select(P.attachment_name(*(F.col(c) for c in "dlmn"))).collect()] == ["x.pdf", "r.csv", "attachment_3.png"]
    assert spark.range(1).select(P.is_login(F.lit("Sign in")), P.is_old_login(F.lit('<input id="user"><input id="pw">')), P.is_browser_dead(F.lit("Page closed")), P.is_browser_dead(F.lit(None))).first()[:] == (True, True, True, False)


def test_small_forms(spark):
    blocks = spark.createDataFrame([([("text", "a"), ("image", None), ("text", "b"), ("text", None)],)], "b array<struct<type:string,text:string>>")
    assert blocks.select(A.flat_content(F.col("b"))).first()[0] == "a b"
    got = spark.range(1).select(A.hours_minutes(F.lit(59 * 60)), A.hours_minutes(F.lit(3700)), A.needs_footer(F.lit(0.2)), A.needs_footer(F.lit(0.5)), A.needs_footer(F.lit(0.01))).first()
    assert tuple(got) == ("59m", "1h 1m", True, False, False)
    labels = spark.createDataFrame([("a",), ("b",), (None,)], "filename string")
    down = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2), ("c", "p3", 3)], "filename string, saved_path string, seq int")
    assert {r["filename"]: r["saved_path"] for r in P.match_files(labels, down).collect()} == {"a": "p2", "b": None, None: None}
