import random

from tarn.llm import leak as L

ITEMS = "item_id bigint, question string, product string, expected_sources array<string>, expected_keypoints array<string>"
Q = "Why does the exposure figure lag when a weekend dealer archives one unconfirmed chain?"


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, ITEMS)
    return sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(d, i).collect())


def test_disguises(spark):
    eight = "exposure figure lag when a weekend dealer archives"
    docs = [
        (1, f"Before. {Q} After."), (2, eight.upper()), (3, eight.replace(" ", "\n> ")), (4, "ex​posure fig­ure lag when a weekend dealer archives"),
        (5, "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in eight)), (6, "exposure **figure** lag when <b>a</b> weekend&nbsp;dealer archives"),
        (7, eight.replace(" ", "_")), (8, " ".join(eight.split()[:7])), (9, eight.replace("when", "when then")), (10, None), (11, ""), (12, "x" * 300_000 + " " + eight), (1, f"Before. {Q} After."),
    ]
    items = [(7, Q, None, None, None), (8, None, None, [], [None, "short one", f"{Q}"]), (9, "", None, None, []), (7, Q, None, None, None)]
    got = run(spark, docs, items)
    assert sorted(set(got)) == sorted((d, i) for d in (1, 2, 3, 4, 5, 6, 7, 12) for i in (7, 8))
    assert got.count((1, 7)) == 2  # a repeated document has its own rows
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_places_are_in_the_original(spark):
    text = "Müll: «ex​posure **figure** lag when a weekend dealer archives» end"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = L.find_leaks(d, spark.createDataFrame([(7, Q, None, None, None)], ITEMS)).first()
    assert text[r["start_pos"] - 1 :].startswith("ex") and text[: r["end_pos"]].endswith("archives")


def test_places_with_broken_hyphens(spark):
    passage = "exposure figure lag when a weekend dealer archives"
    text = "one bro-\nken and ano-\nther and a thi-\nrd word before: " + passage + " and more"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = L.find_leaks(d, spark.createDataFrame([(7, Q, None, None, None)], ITEMS)).first()
    assert text[r["start_pos"] - 1 : r["end_pos"]] == passage and r["n_runs"] == 1
    inside = text.replace("weekend", "week-\nend")
    r = L.find_leaks(spark.createDataFrame([(1, inside)], "doc_id bigint, text string"), spark.createDataFrame([(7, Q, None, None, None)], ITEMS)).first()
    assert inside[r["start_pos"] - 1 : r["end_pos"]] == passage.replace("weekend", "week-\nend")


def test_tracking_is_the_same_normalising():
    rng = random.Random(5)
    bits = ["Straße", "ﬁne", "e\u0301", "가", "\u1100\u1161\u11a8", "\u09c7\u09be", "&amp;", "&nbsp", "&#233;", "&notit;", "<b>x</b>", "<br/>", "[a](http://x y)", "[t](u)", "w**o**rd", "co\u00adop", "\u200b", "ＡＢ", "Ⅷ", "İ", " ", "\n", "a_b", "q\u0323\u0307", "&lt;i&gt;"]
    for _ in range(600):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        t = L.tracked(text)
        assert t.text == L.folded(text) and len(t.first) == len(t.last) == len(t.text)
        assert t.first == sorted(t.first)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_CHARS", 60)
    items = [(i, Q.replace("lag", f"lag{i}"), None, None, None) for i in range(6)]
    docs = [(i, items[i][1]) for i in range(6)]
    got = run(spark, docs, items)
    assert {(i, i) for i in range(6)} <= set(got) and len(got) == len(set(got))


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 14))), None, None, [" ".join(rng.choices(words, k=9))]) for i in range(40)]
    docs = []
    for n in range(60):
        body = rng.choices(words, k=30)
        if n % 2:
            src = rng.choice(items)[1].split()
            body[10:10] = src[: rng.randint(4, 14)]
        docs.append((n, " ".join(body)))
    want = set()
    for d, t in docs:
        ws = t.split()
        have = {tuple(ws[i : i + 8]) for i in range(len(ws) - 7)}
        for i, q, _, _, k in items:
            if any(tuple(p.split()[j : j + 8]) in have for p in (q, *k) for j in range(len(p.split()) - 7)):
                want.add((d, i))
    assert set(run(spark, docs, items)) == want
