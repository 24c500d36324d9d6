import re

import pytest
from pyspark.sql import functions as F

from tarn.functions import redaction as R
from tarn.functions import text as X


@pytest.fixture(scope="module")
def ev(spark):
    def run(make, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]

    return run


def test_text(ev):
    assert ev(X.tokens, "Ab-C #12 é", None, "") == [["ab", "c", "#12"], [], []]
    assert ev(X.words, " a  b\tc ", None, "  ") == [["a", "b", "c"], [], []]
    assert ev(lambda c: X.normalise_query(c, [("web 2 5", "web2"), ("td", "tradedesk")]), "How, in Web 2.5?  #7 td!", None) == ["how in web2 #7 tradedesk", ""]
    assert ev(X.issue_type, "incident and error", "it fails", "how to add", "settings", "hello", None) == ["incident", "error", "how_to", "config", "general", "general"]
    assert ev(X.ticket_refs, "ticket 123, bug #4567 and #123; 99999 alone", None) == [["123", "4567"], []]
    assert ev(lambda c: X.slug(c, "general"), "Ä Title / 2.0!", "", None) == ["title_2_0", "general", "general"]
    assert ev(X.version, "since 4.0 and 2.4.0.10-EXT", "4.0") == ["2.4.0.10", ""]
    assert ev(X.iso_date, "2024-08-22 6:37 AM", " 2024-08-22", "x", None, "2024-08-22T01:00Z") == ["2024-08-22", "2024-08-22", "", "", "2024-08-22"]
    assert ev(X.id_ranges, "7-9, 12 8", "12-10", "1 - 3", "junk", "5–6") == [[7, 8, 9, 12], [10, 11, 12], [1, 3], [], [5, 6]]
    assert ev(X.token_estimate, "", "x" * 9, None) == [1, 2, 1]
    assert ev(X.path_category, "a/b/c.json", "a/b") == ["b", ""]
    assert ev(lambda c: X.absolute_url(c, "https://h.example"), "/x", "https://y.example/z") == ["https://h.example/x", "https://y.example/z"]
    assert ev(lambda c: X.sigmoid(c.cast("double")), "0", "-1000", "1000") == [0.5, 0.0, 1.0]
    assert ev(lambda c: X.version_key(c), "2.10.1", "2.9-1", "2.x") == [[2, 10, 1], [2, 9, 1], [-1]]
    assert ev(lambda c: X.data_uri(c)["payload"], "data:image/png;base64,AAA=", "x.png") == ["AAA=", None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail jo@a.example or call 416-555-0134 today", "Mail [redacted] or call [redacted] today"),
        ("Seen on 2024-08-22 at noon", "Seen on 2024-08-22 at noon"),
        ("password: hunter2; rest", "password: [redacted]; rest"),
        ("please reset the password today", "please reset the password today"),
        ("see https://x.example/y?token=abc&z=1", "see [link]"),
        ("key AbCdEfGhIjKlMnOpQrSt123 end", "key [redacted] end"),
        ("version 1.2.3.4 of order 123456", "version 1.2.3.4 of order 123456"),
        ("ping @Dana please", "ping @[redacted] please"),
        ("Hi Sam, asked Priya Patel (Robin)", "Hi [redacted], asked [redacted] ([redacted])"),
        ("From: a\nText stays.\nRegards\nJane Doe\nmore", "Text stays.\nRegards\nmore"),
        ("a  b\r\n\r\n\tc", "a b\n\tc"),
        (None, ""),
        ("", ""),
    ],
)
def test_redact(ev, text, want):
    assert ev(R.redact, text) == [want]


def test_redact_terms_and_scrub(ev, spark):
    df = spark.createDataFrame([("Acme and acme.co, not Acmeish; (x)", ["Acme", "x", "", "a.b"]), ("t", None)], "v string, t array<string>")
    assert [r[0] for r in df.select(R.redact(F.col("v"), F.coalesce("t", F.array().cast("array<string>")))).collect()] == ["[redacted] and [redacted].co, not Acmeish; (x)", "t"]
    assert ev(R.leaks, "jo@a.example password: x sk-abcdefghijklmnop1", "password: [redacted]", None) == [["email", "secret", "password"], [], []]
    assert ev(R.scrub, "a jo@a.example b") == ["a [redacted] b"]
    assert ev(R.scrub_answer, "see [T](https://x.example/a@b.example) or jo@a.example") == ["see [T](https://x.example/a@b.example) or [redacted]"]


def test_secret_runs_agree_with_the_rule_in_words(ev):
    def secret(tok):
        core = tok.strip("=")
        if len(core) < 20:
            return False
        mixed = any(c.islower() for c in core) and any(c.isupper() for c in core) and any(c.isdigit() for c in core)
        return (len(core) >= 32 and re.fullmatch(r"[A-Za-z0-9+/]+", core) is not None) or mixed

    toks = ["a" * 19, "a" * 31, "a" * 32, "aB1" * 7, "aB1" * 6, "=" * 10 + "aB1" * 6, "a-" * 20, "aB1_" * 6, "AB12" * 8, "ab/+" * 8 + "==", "x" * 40 + "-"]
    got = ev(lambda c: F.regexp_replace(c, R.SECRET_RUN, "!"), *toks)
    assert [g != t for g, t in zip(got, toks, strict=True)] == [secret(t) for t in toks]
