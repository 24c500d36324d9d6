import pytest

from tarn.llm import mix as M


def test_rates_hit_the_shares_or_the_caps():
    r = M.rates({"a": 1000, "b": 1000, "c": 10}, {"a": (1, 5), "b": (1, 5), "c": (1, 2), "none": (5, 1)})
    assert r["c"] == 2 and r["a"] == pytest.approx(r["b"]) and r["a"] * 2000 + 20 == pytest.approx(2010)
    assert M.rates({"a": 10}, {"a": (0, 5)}) == {} and M.rates({}, {"a": (1, 1)}) == {}
    all_capped = M.rates({"a": 10, "b": 10}, {"a": (1, 1), "b": (1, 1)}, total=1000)
    assert all_capped == {"a": 1, "b": 1}


def test_mix(spark):
    docs = [(i, f"word {i} and some more text", "Big-Source" if i % 2 else "big_source ", 0) for i in range(400)] + [(i, "tiny text", "tiny", 0) for i in range(1000, 1010)]
    docs += [(5000, "x", None, 0), (5001, None, "tiny", 0), (5002, "", "tiny", 0), (5003, "x", "untargeted", 0), (5004, "x", " ", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, rate int")
    targets = spark.createDataFrame([("big_source", 3.0, 1), ("TINY", 1.0, 4), ("absent", 2.0, 2), (None, 1.0, 1), ("zero", 0.0, 1), ("nul", None, None)], "source string, weight double, max_repeats int")
    sized = M.sized(d)
    plan = M.plan(sized, targets)
    mixed = M.emit(sized, plan)
    rows = mixed.collect()
    assert {r["source"] for r in rows} == {"big_source", "tiny"}
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    assert max(len(v) for i, v in per.items() if i >= 1000) == 4 and max(len(v) for i, v in per.items() if i < 1000) == 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.emit(sized, plan).collect()))
    sh = {r["source"]: r for r in M.shares(mixed, plan).collect()}
    assert sh["absent"]["actual_share"] == 0 and sum(r["actual_share"] for r in sh.values()) == pytest.approx(1)
    assert sh["big_source"]["mixed_tokens"] == sum(r["n_tokens"] for r in rows if r["source"] == "big_source")
    none = M.sized(d.where("false"))
    assert M.emit(none, M.plan(none, targets)).count() == 0
    assert M.shares(M.emit(sized, M.plan(sized, targets.where("false"))), M.plan(sized, targets.where("false"))).count() == 0
