import random

import pytest

from tarn.llm import split as S


def text_of(rng, n):
    parts = ["# Head\n\n", "Some sentence here. ", "Another one, with a clause; and more! ", "word ", "\n\n", "\n", "```\ncode code\n# no heading\n```\n", "日本語の文。", "é", "\r\n", "x" * 40]
    out = ""
    while len(out) < n:
        out += rng.choice(parts)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_nothing_lost_within_limit_and_overlap(seed):
    rng = random.Random(seed)
    text = text_of(rng, rng.randint(0, 6000))
    limit = rng.randint(60, 500)
    overlap = rng.randint(0, limit // 4)
    got = S.pieces(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in got) == text
    assert all(e - s <= limit for s, _, e in got)
    for (_, _, e0), (s, c, _) in zip(got, got[1:], strict=False):
        assert c == e0 and c - s == min(overlap, c)


@pytest.mark.parametrize("seed", range(10))
def test_no_word_is_cut_while_a_boundary_is_there(seed):
    rng = random.Random(seed)
    text = "w " * 100 + "x" * 560 + " t" * 120
    assert all(text[a - 1].isspace() or text[a].isspace() for a, _ in S.cores(text, 600, 0)[1:])
    text = text_of(rng, 4000)
    limit = rng.randint(30, 200)
    legal = {p for p in S.boundaries(text) if S._whole(text, p)}
    got = S.cores(text, limit, 0)
    for (a, z), (_, z2) in zip(got, got[1:], strict=False):
        if z not in legal:  # only a run of characters without any boundary is cut elsewhere
            assert not any(a < p < z2 for p in legal if p - a <= limit // 2 and z2 - p <= limit // 2) or not [p for p in legal if a < p < z2]


def test_prefers_strong_boundaries():
    text = "a " * 300 + "\n# Middle\n" + "b " * 300
    cut = S.cores(text, 800, 50)
    assert text[cut[1][0] :].startswith("# Middle")


def test_no_boundary_and_line_breaks():
    assert [e - s for s, e in S.cores("x" * 1000, 300, 0)] == [250] * 4
    text = "\r\n" * 500
    assert all(not (text[c - 1] == "\r" and text[c] == "\n") for _, c, _ in S.pieces(text, 100, 10)[1:])
    with pytest.raises(ValueError):
        S.cores("x" * 100, 10, 10)


def test_table(spark):
    rows = [("f", 1, "word " * 100, "clash"), ("f", 2, "short", ""), ("f", 3, "", ""), ("f", 4, None, ""), ("g", 5, "y" * 10_000, ""), (None, 6, "z", ""), ("f", 1, "word " * 100, "clash"), ("f", None, "w" * 300, "")]
    df = spark.createDataFrame(rows, "field string, row_id bigint, text string, piece_no string")
    limits = spark.createDataFrame([("f", 120, 20, 1)], "field string, max_chars int, overlap_chars int, text int")
    got = S.split_texts(df, limits).collect()
    by = {}
    for r in got:
        by.setdefault(r["row_id"], []).append(r)
    assert len(by[1]) == 2 * by[1][0]["n_pieces"] > 2 and 4 not in by
    assert by[2][0]["n_pieces"] == by[3][0]["n_pieces"] == by[5][0]["n_pieces"] == by[6][0]["n_pieces"] == 1
    assert len(by[None]) > 1
    assert S.split_texts(df.where("false"), limits).count() == 0
    assert S.split_texts(df, limits.where("false")).count() == 7
