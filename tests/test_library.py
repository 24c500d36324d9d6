import pytest
from pyspark.sql import functions as F

from tarn.operators import evaluation as E
from tarn.operators import incremental as I
from tarn.operators import library as L
from tarn.operators import products as P


def test_names(spark):
    df = spark.createDataFrame([(" TD ", "Business Modeling", "api"), ("x", None, "new"), (None, "?", None)], "a string, b string, c string")
    assert [tuple(r) for r in df.select(P.resolve(F.col("a")), P.of_project(F.col("b")), P.display(F.col("c"))).collect()] == [("tradedesk", "tradedesk", "API"), (None, "other", "new"), (None, "other", "")]
    assert spark.range(1).select(P.provider_of(F.lit("m"), {"p": ["m"], "q": ["m"]}), P.provider_of(F.lit("z"), {})).first()[:] == ("p", None)


def test_records_are_gated(spark):
    df = spark.createDataFrame([(1, ["fine", None, "mail a@b.example"]), (2, None), (3, ["password: x1", ""])], "rec_id bigint, messages array<string>")
    assert sorted((r["rec_id"], r["message_no"], r["category"]) for r in E.scan_records(df, "rec_id", "messages").collect()) == [(1, 2, "email"), (3, 0, "password")]
    with pytest.raises(E.Leak):
        E.assert_clean(df, "rec_id", "messages")
    E.assert_clean(df.where("rec_id = 2"), "rec_id", "messages")


def test_stability_and_scores(spark):
    runs = spark.createDataFrame([("a", 1, "same words"), ("a", 2, "same words"), ("b", 1, "one"), ("c", 1, "abcd"), ("c", 2, None)], "c string, r int, t string")
    assert {r["c"]: r["stability"] for r in E.answer_stability(runs, "c", "r", "t").collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}
    cases = spark.createDataFrame([("m", 0.5), ("m", 1.0)], "model string, accuracy double")
    unsupported = spark.createDataFrame([("n", True), ("n", False)], "model string, safe boolean")
    assert {r["model"]: (r["accuracy"], r["abstain_safety"]) for r in E.model_scores(cases, unsupported).collect()} == {"m": (0.75, 1.0), "n": (0.0, 0.5)}
    assert tuple(E.means(cases.where("false"), ["accuracy"]).first()) == (0.0, 0)


def test_ingest(spark):
    index = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, text string")
    manifest = index.select("id", F.sha1("text").alias("sig"))
    source = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, text string").withColumn("sig", F.sha1("text"))
    rows, now, diff = I.ingest(index, manifest, source)
    assert sorted(map(tuple, rows.collect())) == [("a", "1"), ("b", "2"), ("d", "1")] and now.count() == 3
    assert tuple(I.ingest_report(diff).first()) == (2, 2, 1, 3)
    assert I.ingest(index, manifest, source, rebuild=True)[2].where("state = 'added'").count() == 3
    with pytest.raises(I.EmptySource):
        I.ingest(index, manifest, source.where("false"))
    empty = index.where("false")
    assert I.ingest(empty, manifest.where("false"), source.where("false"))[0].count() == 0
    state = spark.createDataFrame([("x",)], "key string")
    nested = spark.createDataFrame([("s", ["a", "b"]), ("t", None)], "space string, slugs array<string>")
    assert [r[0] for r in I.legacy_state(state, nested, "space", "slugs").collect()] == ["x"]
    assert sorted(r[0] for r in I.legacy_state(state.where("false"), nested, "space", "slugs").collect()) == ["s|a", "s|b"]


def test_version_pages(spark):
    item = "map<string,string>"
    rows = [("trade_desk", "10.2.1", "T", "u", "now", "s.png", '[{"id": "1", "details": "a|b"}, {"details": "c\\nd", "risk": "low"}]', "[]", None, None), ("trade_desk", "9.1", None, "u", None, None, None, '[{"id": "", "note": "n"}]', None, None)]
    df = spark.createDataFrame(rows, "product string, version string, title string, url string, scraped_at string, screenshot string, enhancements string, bugs string, tasks string, schema_changes string")
    df = df.withColumns({c: F.from_json(c, f"array<{item}>") for c in L.SECTIONS})
    md = {r["version"]: r["markdown"] for r in L.version_markdown(df).collect()}
    assert md["10.2.1"].startswith("# Trade Desk — T\n\n**Version:** 10.2.1  \n**URL:** u  \n**Scraped:** now  \n**Screenshot:** `s.png`\n\n## Enhancements and New Features\n\n| id | details | risk |\n|---|---|---|\n| 1 | a\\|b |  |\n|  | c d | low |\n")
    assert "# Trade Desk — Version 9.1" in md["9.1"] and "## Bugs" in md["9.1"]
    lines = df.select(F.explode(F.concat(F.coalesce("enhancements", F.array().cast(f"array<{item}>")), F.coalesce("bugs", F.array().cast(f"array<{item}>")))).alias("r")).select(L.item_line(F.col("r"))).collect()
    assert sorted(r[0] for r in lines) == ["- **1** — a|b", "- c\nd", "- n"]
    v = spark.createDataFrame([("p", f"1.{i}.0") for i in range(13)] + [("q", "2.0-x")], "product string, version string")
    m = {r["product"]: r for r in L.master_index(v).collect()}
    assert (m["p"]["versions"], m["p"]["more"], m["p"]["newest"][0], len(m["p"]["newest"])) == (13, 3, "1.12.0", 10) and m["q"]["more"] == 0


def test_chats(spark):
    old = spark.createDataFrame([("a", "Mine", "1"), ("b", "", "1")], "chat_id string, title string, payload string")
    new = spark.createDataFrame([("a", "Auto", "2"), ("b", "Auto", "2"), ("c", "Auto", "2")], "chat_id string, title string, payload string")
    assert sorted(map(tuple, L.saved_chats(old, new).collect())) == [("a", "Mine", "2"), ("b", "Auto", "2"), ("c", "Auto", "2")]
