"""Whole jobs: what an operator must not leave out."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.operators import answering, reports
from tarn.operators import retrieval as ret
from tarn.plans import reference

DATA = Path("/root/testdata/sf0.01")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_index_keeps_every_product(spark):
    rows = [(i, p, "s", f"t|{i}") for i, p in enumerate([*reference.PRODUCT_ORDER, "new", None])]
    items = spark.createDataFrame(rows, "art_no int, product string, space_name string, title string")
    got = reports.index_rows(items, reference.PRODUCT_ORDER, "product", F.col("space_name"), F.col("title"), F.lit("u")).orderBy("art_no").collect()
    assert [r["product_order"] for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert got[0]["line"] == "| t\\|0 | s | u |"


@tables
def test_snapshots_have_all_states(spark):
    states = {r["id"]: r["state"] for r in reference.manifest_diff(spark, str(DATA)).collect()}
    assert set(states.values()) == {"added", "changed", "removed", "unchanged"}
    now = reference._halves(spark, str(DATA))[0].count()
    removed = sum(x == "removed" for x in states.values())
    assert reference.upsert_chunks(spark, str(DATA)).count() == now + removed
    left = {r["id"] for r in reference.delete_chunks(spark, str(DATA)).collect()}
    assert left == {i for i, x in states.items() if x in ("changed", "unchanged")}


@tables
def test_usage_and_citations_meet_real_rows(spark):
    d = str(DATA)
    model = spark.read.parquet(f"{d}/usage_log.parquet").select("log_id", F.lower(F.trim("model")).alias("model"), "tokens_out")
    paid = reference.usage_cost(spark, d).join(model, "log_id").where("tokens_out > 0").groupBy("model").agg(F.min("cost").alias("low"), F.max("cost").alias("high")).collect()
    got = {r["model"]: (r["low"] > 0, r["high"] > 0) for r in paid}
    assert got["local-small"] == got["local-large"] == (True, True) and got["gateway-mid"] == (False, False)
    r = reference.usage_summary(spark, d).first()
    assert 0 < r["session_queries"] < r["total_queries"]
    assert reference.citation_validate(spark, d).agg(F.sum("n_verified"), F.sum("n_unverified")).first() > (0, 0)


def test_filter_comes_before_the_cut(spark):
    docs = spark.createDataFrame([(i, "red apple" if i < 5 else "red sky and sea " + "x " * i, "a" if i < 5 else "b") for i in range(9)] + [(i, "zzz", "a") for i in range(9, 40)], "doc_id bigint, text string, product string")
    q = spark.createDataFrame([(1, "red apple")], "query_id bigint, query string")
    every = {r["doc_id"]: r["score"] for r in ret.bm25_topk(docs, q, 40).collect()}
    got = ret.bm25_topk(docs, q, 3, keep=F.col("product") == "b").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [5, 6, 7] and [r["score"] for r in got] == [every[i] for i in (5, 6, 7)]
    v = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 0.0], 1), (3, [0.9, 0.1], 1), (4, [0.5, 0.5], 0)], "vec_id bigint, embedding array<float>, label int")
    qv = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, query_vec array<float>")
    assert [r["doc_id"] for r in ret.dense_topk(v, qv, 2, keep=F.col("label") == 0).orderBy("rank").collect()] == [4, 1]


@tables
def test_hybrid_has_hits_of_both_searches(spark):
    q, hits = reference._hybrid(spark, str(DATA))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = {(r["query_id"], r["doc_id"]) for r in ret.bm25_topk(docs, q).collect()}
    fused = {(r["query_id"], r["doc_id"]) for r in hits.collect()}
    assert words < fused
    assert {x for x, _ in fused} == {r["query_id"] for r in q.collect()}


def test_seeds_are_the_first_tickets(spark):
    rows = [(1, 10, 1, "article", None, "A", "x"), (1, 11, 2, "ticket", "t", "T", "y" * 300), (1, 12, 3, "ticket", "u", "U", "z"), (2, 13, 1, "article", None, "A", "x")]
    ctx = spark.createDataFrame(rows, "query_id int, doc_id int, rank int, kind string, ticket_id string, title string, text string")
    assert [tuple(r) for r in answering.ticket_seeds(ctx).collect()] == [(1, "T " + "y" * 200)]


@tables
def test_related_tickets_come_from_the_seed(spark):
    d = str(DATA)
    got = {(r["query_id"], r["ticket_id"]) for r in reference.related_tickets(spark, d).collect()}
    context = reference._context(spark, d).collect()
    assert {q for q, _ in got} <= {r["query_id"] for r in context if r["kind"] == "ticket"}
    assert not got & {(r["query_id"], r["ticket_id"]) for r in context}
    own = {(r["query_id"], r["ticket_id"]) for r in reference._context(spark, d, ret.TOP_K).collect()}
    assert got - own  # found by the seed only
