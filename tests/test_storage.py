import json

from pyspark.sql import functions as F

from tarn.sources import files, sinks
from tarn.streaming import state


def test_library_files(spark, tmp_path):
    kb = tmp_path / "lib" / "kb"
    (kb / "api" / "calls").mkdir(parents=True)
    (kb / "api" / "calls" / "a.json").write_text(json.dumps({"title": "A", "body_md": "x", "product": "api"}))
    (kb / "api" / "bad.json").write_text("{oops")
    (kb / "api" / "none.json").write_text(json.dumps({"title": "B"}))
    (kb / "api" / "index.json").write_text(json.dumps({"title": "I", "body_md": "x"}))
    (kb / "root.json").write_text(json.dumps({"title": "R", "body_md": "x"}))
    rows = files.articles(spark, str(kb)).collect()
    assert [(r["title"], r["category"]) for r in rows] == [("A", "calls")]
    assert files.signatures(spark, str(kb)).count() == 5
    t = tmp_path / "lib" / "tickets"
    (t / "sub").mkdir(parents=True)
    (t / "ticket_1.json").write_text("{}")
    (t / "other.json").write_text("{}")
    (t / "sub" / "ticket_2.json").write_text("{}")
    assert files.tickets(spark, str(t)).count() == 1
    assert files.library_roots(lambda p: p == "/l/kb", "/l") == ("/l/kb", "/l/tickets") and files.library_roots(lambda p: False, "/l/kb", "/t") == ("/l/kb", "/t")
    u = tmp_path / "u.jsonl"
    u.write_text('{"kind": "answer", "tokens_in": 3}\n\n{broken\n{"kind": "learn_mode_failed_auth"}\n{"tokens_in": null}\n')
    assert files.usage(spark, str(u)).count() == 2
    e = tmp_path / "e.json"
    e.write_text('[{"question": "q", "expected_sources": ["a"]}]')
    assert files.eval_cases(spark, str(e)).first()["expected_sources"] == ["a"]
    assert files.manifest(spark, str(tmp_path / "no")).count() == 0


def test_listing(spark):
    page = json.dumps({"results": [{"id": "1", "title": "T", "_links": {"webui": "/a"}}, {"id": "2", "title": "U", "_links": {"webui": "/b"}}]})
    df = spark.createDataFrame([(0, page), (1, page), (2, "x"), (3, None)], "page_no int, payload string")
    assert sorted(map(tuple, files.listing_pages(df).collect())) == [("1", "T", "/a"), ("2", "U", "/b")]


def test_publish_and_upsert_stream(spark, tmp_path):
    table, src = str(tmp_path / "t"), tmp_path / "src"
    assert sinks.current(spark, table) is None
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.json(str(src), mode="append")
    for _ in range(2):  # the second run finds nothing new
        state.upsert_stream(spark.readStream.schema("k string, v int").json(str(src)), table, "k", str(tmp_path / "cp")).awaitTermination()
        assert sorted(map(tuple, sinks.current(spark, table).collect())) == [("a", 1), ("b", 1)]
    spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int").write.json(str(src), mode="append")
    state.upsert_stream(spark.readStream.schema("k string, v int").json(str(src)), table, "k", str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, sinks.current(spark, table).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_lost_between_the_steps_of_publishing(spark, tmp_path, monkeypatch):
    """Whatever step is the last one done, the table that was published is still there and the next job goes on from it."""
    table = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(v,)], "v int") for v in (1, 2))
    sinks.publish(one, table)

    class Lost(Exception):
        pass

    real = sinks._fs

    class Broken:
        def __init__(self, fs, at):
            self.fs, self.at = fs, at

        def __getattr__(self, name):
            def call(*a):
                if name == self.at:
                    raise Lost
                return getattr(self.fs, name)(*a)

            return call

    for at in ("create", "rename"):
        monkeypatch.setattr(sinks, "_fs", lambda s, p, at=at: (Broken(real(s, p)[0], at), *real(s, p)[1:]))
        try:
            sinks.publish(two, table)
            raise AssertionError("should be lost")
        except Lost:
            pass
        monkeypatch.setattr(sinks, "_fs", real)
        assert [r["v"] for r in sinks.current(spark, table).collect()] == [1]
    sinks.publish(two, table)
    assert [r["v"] for r in sinks.current(spark, table).collect()] == [2]


def test_a_repeated_batch_chooses_the_same_rows(spark, tmp_path):
    src, got = str(tmp_path / "src"), []
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "q")], "k string, at int, v string").write.json(src)
    for n in range(2):
        state.upsert_stream(spark.readStream.schema("k string, at int, v string").json(src), str(tmp_path / f"t{n}"), "k", str(tmp_path / f"c{n}"), "at").awaitTermination()
        got.append(sorted(map(tuple, sinks.current(spark, str(tmp_path / f"t{n}")).collect())))
    assert got[0] == got[1] == [("a", 3, "z"), ("b", None, "q")]


def test_no_folder_on_a_cluster(monkeypatch):
    import pytest

    from tarn.sources import tables

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(Conf)

    with pytest.raises(tables.NoSharedFolder):
        tables.ensure_checkpoint_dir(Session())


def test_once_and_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:12:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts")).write.parquet(src)
    got: list = []
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    state.drain(state.once(stream, ["k"], "ts"), lambda df, _: got.extend(df.collect()), str(tmp_path / "c1"))
    assert sorted(r["k"] for r in got) == ["a", "b"]
    counts: list = []
    q = state.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").foreachBatch(lambda df, _: counts.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"]) for r in counts} >= {("a", 2), ("b", 1)}


def test_writers(spark, tmp_path):
    a = spark.createDataFrame([(1, 'T "x"', None, "S", "api", "f", "body")], "art_no bigint, title string, url string, space_name string, product string, lib_folder string, body_md string")
    r = sinks.article_markdown(a).first()
    assert r["slug"] == "t_x" and 'title: "T \\"x\\""' in r["markdown"] and r["markdown"].endswith("body\n")
    sinks.jsonl(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
