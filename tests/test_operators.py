import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.operators import chunking, conversation, incremental, markup, reports
from tarn.operators import retrieval as ret
from tarn.streaming.state import Gate, gate_log

TOK = re.compile("[a-z0-9#]+")


def bm25(docs, query):
    toks = {i: TOK.findall((t or "").lower()) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if v < 0 else v for w, v in idf.items()}
    out = []
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in TOK.findall(query.lower()) if tf[w])
        if round(s, 6) > 0:
            out.append((-round(s, 6), i))
    return [i for _, i in sorted(out)]


def test_bm25_equals_brute_force(spark):
    docs = [(1, "red apple pie"), (2, "green apple"), (3, "blue sky and red sea"), (4, None), (5, ""), (6, "green apple"), (7, "sea " * 500)]
    qs = [(1, "red apple"), (2, "sea sea"), (3, "zzz"), (4, None), (5, "green")]
    got = ret.bm25_topk(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(qs, "query_id bigint, query string"), 10).collect()
    for q, text in qs:
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == bm25(docs, text or "")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ret.bm25_topk(none, spark.createDataFrame(qs, "query_id bigint, query string")).count() == 0


def test_dense_fusion_and_gate(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, None), (5, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id bigint, query_vec array<float>")
    got = ret.dense_topk(v, q, 3)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == [2, 5, 3]
    fused = ret.fuse(got, got.where("rank = 3").withColumn("rank", F.lit(1))).orderBy("rank").collect()
    assert fused[0]["doc_id"] == 3 and len(fused) == 3
    c = spark.createDataFrame([(1, i, "red apple", t) for i, t in enumerate(["red apple", "red", "zzz"])] + [(2, 7, "red apple", "zzz")], "query_id bigint, doc_id bigint, query string, text string")
    assert [(r["query_id"], r["doc_id"]) for r in ret.rerank(c).orderBy("rank").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)], "doc_id bigint, text string")
    qs = spark.createDataFrame([(i, f"w{i}") for i in range(7)], "query_id bigint, query string")
    whole = sorted(map(tuple, ret.bm25_topk(docs, qs, 5).collect()))
    monkeypatch.setattr(ret, "BLOCK", 2)
    assert sorted(map(tuple, ret.bm25_topk(docs, qs, 5).collect())) == whole


def test_parent_assembly(spark):
    c = spark.createDataFrame([("t", 1, "Head\n\nsecond"), ("t", 0, "Head\n\nfirst"), ("u", 0, None)], "k string, i int, text string")
    assert {r["k"]: r["text"] for r in ret.assemble(c, "k", "i", "text").collect()} == {"t": "Head\n\nfirst\n\nsecond", "u": ""}


def test_incremental(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, sig string")
    old = spark.createDataFrame([("b", "1"), ("c", None), ("d", "4")], "path string, sig string")
    assert {r["path"]: r["state"] for r in incremental.manifest_diff(cur, old).collect()} == {"a": "added", "b": "changed", "c": "unchanged", "d": "removed"}
    assert sorted(tuple(r) for r in incremental.upsert(old, cur, "path").collect() if r[1]) == [("a", "1"), ("b", "2"), ("d", "4")]
    assert [r[0] for r in incremental.delete(old, cur, "path").collect()] == ["d"]
    assert incremental.fetch(old, spark.createDataFrame([("",), ("b",), (None,)], "path string"), "path").count() == 1
    retry = incremental.retry_candidates([spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string"), spark.createDataFrame([("x", "3")], "k string, v string")], "k", "v")
    assert {tuple(r) for r in retry.collect()} == {("x", "3", 0), ("y", "2", 0)}
    log = spark.createDataFrame([("k", i, i % 2 == 0) for i in range(30)], "k string, i int, bad boolean")
    assert incremental.running_failure_share(log, "k", ["i"], "bad").where("i = 29").first()["failure_share"] == 0.5
    assert incremental.merge_first([spark.createDataFrame([("a", 0), ("b", 1)], "k string, pos int"), spark.createDataFrame([("b", 0), ("c", 1)], "k string, pos int")], "k", 2).count() == 2


def test_article_split():
    body = "# A\n" + "\n\n".join("w " * 30 for _ in range(4)) + "\n## B\nshort\n```\n# not a heading\n\nx\n```\n"
    got = chunking.split_article(body, 70)
    assert len(got) == 3 and got[0].startswith("# A\n") and got[1].startswith("# A\n") and got[2].startswith("## B") and "# not a heading\n\nx" in got[2]
    assert chunking.split_article(None) == chunking.split_article("  \n") == [] and len(chunking.split_article("w " * 2000, 500)) == 1


def test_ticket_chunks(spark):
    schema = (
        "rec_id bigint, ticket_id string, title string, organization string, csqa_owner string, assignee string, created_by string, created_at string, comments array<struct<author:string,internal:boolean,body:string>>, "
        "resolution struct<text:string,comments:array<struct<author:string,body:string>>>"
    )
    rows = [
        (1, "77", "It fails", "Acme", "ow", None, "req", "2024-08-22 6:37 AM", [("Sam", False, "Hi Jane\nThe thing " + "w " * 400), ("st", True, "Restarted it."), ("ST", True, ""), None], ("Fixed by Jane.", [("st", "done"), ("req", "x")])),
        (2, "78", "Open", None, None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None, [], (None, None)),
    ]
    got = chunking.ticket_chunks(spark.createDataFrame(rows, schema)).orderBy("rec_id", "chunk_index").collect()
    first = got[0]["text"]
    assert [(r["rec_id"], r["chunk_index"], r["resolved"]) for r in got] == [(1, 0, True), (1, 1, True), (2, 0, False)]
    assert first.startswith("Ticket #77 — It fails\nDate: 2024-08-22\nClient: Acme\nCSQA owner: ow · Handled by: st\n\nProblem: Hi [redacted]")
    assert "Fixed by [redacted]." in got[1]["text"] and "Restarted it." in got[1]["text"] and "[UNRESOLVED]" in got[2]["text"]
    assert len({r["chunk_id"] for r in got}) == 3


def test_conversation(spark):
    t = spark.createDataFrame([("c", i, r, x) for i, (r, x) in enumerate([("user", "how do I see #1234 today please"), ("assistant", "like so"), ("system", "-"), ("user", "and this?"), ("assistant", None)])], "c string, turn int, role string, content string")
    assert conversation.history(t, "c", "turn").count() == 4
    assert tuple(conversation.latest(t, "c", "turn", "content").first()) == ("c", "and this?", "assistant")
    assert conversation.titles(t, "c", "turn", "content").first()["title"] == "Ticket #1234"
    q = {r["turn"]: r["search_query"] for r in conversation.fused_query(t.where("role = 'user'"), "c", ["turn"], "content", F.lit(False)).collect()}
    assert q == {0: "how do I see #1234 today please", 3: "how do I see #1234 today please and this?"}
    d = spark.createDataFrame([("c", i, s) for i, s in enumerate([0.9, 0.1, 0.1])], "c string, turn int, s double")
    assert [r["drift"] for r in conversation.drift(d, "c", ["turn"], "s").orderBy("turn").collect()] == [False, True, False]


def test_reports(spark):
    cases = spark.createDataFrame(
        [(1, ["a", "a", "b"], ["Key"], ["a"], "has the KEY"), (2, ["a"], [], ["z"], "x"), (3, None, None, [], None), (4, [], ["q", None], [], None)],
        "id int, expected_sources array<string>, expected_keypoints array<string>, found_sources array<string>, answer string",
    )
    assert [r["accuracy"] for r in reports.eval_accuracy(cases).orderBy("id").collect()] == [0.8333, 0.0, 1.0, 0.5]
    runs = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b"]), (1, 3, []), (2, 1, []), (2, 2, [])], "c int, r int, s array<string>")
    assert {r["c"]: r["stability"] for r in reports.stability(runs, "c", "r", "s").collect()} == {1: round(0.5 / 3, 4), 2: 1.0}
    scores = spark.createDataFrame([("b", 0.5, 1.0), ("t", 0.6, 0.9)], "model string, accuracy double, safety double")
    assert reports.ship_gate(scores, "b", "t").first()["reason"] == "safety"
    log = spark.createDataFrame([("m", 10, None), ("M ", None, None), (None, 5, 5)], "model string, tokens_in int, tokens_out int").withColumn("ts", F.current_timestamp())
    u = reports.usage(log).first()
    assert (u["total_in"], u["total_out"], u["total_queries"]) == (15, 5, 2) and reports.usage(log.where("false")).first()["total_in"] == 0
    rates = spark.createDataFrame([("m", 1e6, 1e6)], "model string, rate_in double, rate_out double")
    assert sorted(r["cost"] for r in reports.cost(log, rates).collect()) == [0.0, 0.0, 10.0]


def test_gate(spark):
    g = Gate(4)
    for _ in range(20):
        g.record(False)
    assert g.permits == 1 and g.delay == 2.0 and g.tripped
    assert g.consume_trip() and not g.consume_trip() and not g.recent
    g.record(True)
    assert g.permits == 2 and g.delay == 1.0
    for _ in range(2):
        g.record(True)
    assert g.permits == 4 and g.delay == 0.0 and not g.tripped
    g.tune(95.0, 4000.0), g.tune(50.0, 500.0)
    assert g.permits == 2
    g.tune(80.0, 4000.0)
    assert g.permits == 2
    g.tune(50.0, 4000.0)
    assert g.permits == 3
    g.set_ceiling(1)
    assert g.permits == g.ceiling == 1
    g.set_ceiling(8)
    assert (g.permits, g.ceiling) == (1, 8)
    df = spark.createDataFrame([("a", i, i % 2 == 1) for i in range(30)] + [(None, 1, None), ("b", 1, True)], "k string, s bigint, ok boolean")
    rows = gate_log(df, "k", "s", "ok").collect()
    assert len(rows) == 32 and min(r["permits"] for r in rows if r["key"] == "a") == 1 and not any(r["tripped"] for r in rows)


HTML = """<html><head><script>x</script></head><body><nav>skip</nav><div id="main-content"><div class="toc-macro">toc</div><h1>Release</h1><p>Some <b>bold</b> and <a href="#f">frag</a> <a href="http://x.example">link</a><br>next
<ul><li>one<ol><li>sub</li></ol><li>two</ul><h2>Bug fixes in 2.1</h2><table><tr><th>ID</th><th>Risk Assessment: x</th><tr><td>7<td>a|b</td></tr><tr><td></td></tr></table>
<div class="confluence-information-macro confluence-information-macro-note">Mind it</div><pre>code
 x</pre><img src="/i.png" alt="i"></div></body>"""


@pytest.mark.parametrize("html", [HTML, HTML.replace("</div></body>", "")])
def test_markup(html):
    md = markup.to_markdown(html, "https://b.example")
    assert md.startswith("# Release\n\nSome **bold** and frag [link](http://x.example) next\n\n- one\n  1. sub\n- two\n\n## Bug fixes in 2.1\n\n| ID | Risk Assessment: x |\n| --- | --- |\n| 7 | a\\|b |")
    assert "> **Note:** Mind it" in md and "```\ncode\n x\n```" in md and "![i](https://b.example/i.png)" in md and "skip" not in md and "toc" not in md
    assert markup.sections(html, {"bugs": ["bug fixes"]}) == [("bugs", 0, {"id": "7", "risk": "a|b"})]
    assert markup.links(html) == [("#f", "frag"), ("http://x.example", "link")]


def test_markup_edges(spark):
    assert markup.to_markdown(None) == markup.to_markdown("") == "" and markup.to_markdown("<p>" * 5000 + "deep") == "deep"
    df = spark.createDataFrame([(HTML,), (None,)], "h string")
    assert [bool(r[0]) for r in df.select(markup.markdown(F.col("h"))).collect()] == [True, False]
    assert len(df.select(markup.page_links(F.col("h"))).first()[0]) == 2
