import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import tokenizer as T

PATH = os.path.join(T.TOKENIZER_DIR, T.RANKS)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    blob = T.read_ranks(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return T.Encoder(ranks), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "Hello world's end", "<|endoftext|>", "日本語のテキスト。", "a" * 5000, "\n\n  x\t\r\n", "é 👩🏽‍💻 🇨🇦", "x" * 159 + "é" * 90, "\u0000​﻿"])
def test_equal_to_the_public_encoder(pair, text):
    own, ref = pair
    assert own.encode(text) == ref.encode_ordinary(text)
    assert own.count(text) == len(ref.encode_ordinary(text))


def test_short_and_long_words_merge_alike(pair):
    own, _ = pair
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choices("abcdetionsr é日", k=rng.randint(1, 300))).encode()
        assert own.merge_short(w) == own.merge_long(w)


def test_any_text_round_trips(pair):
    own, ref = pair

    @settings(max_examples=60, deadline=None)
    @given(st.text(max_size=300))
    def run(text):
        got = own.encode(text)
        assert got == ref.encode_ordinary(text)
        assert ref.decode(got) == text

    run()


def test_column_with_nulls_empties_and_repeats(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "same", 3), (3, "same", 3), (None, "x", 4)], "doc_id bigint, text string, ids int")
    rows = df.select("doc_id", T.ids(spark, F.col("text")).alias("out"), T.n_tokens(spark, F.col("text")).alias("n")).collect()
    assert [r["out"] for r in rows[:2]] == [[], []] and rows[2]["out"] == rows[3]["out"] != []
    assert [r["n"] for r in rows] == [len(r["out"]) for r in rows]
    assert df.where("false").select(T.ids(spark, F.col("text")).alias("ids")).count() == 0
