import itertools
import random

import pytest

from tarn.llm import email as E


def labels(text, author=None):
    return "".join(x or "." for x in E.label_lines(text, author))


CASES = [
    ("Hello,\nIt is broken.\n\nKind regards,\nJane Doe\nHead of Payments\n+1 212 555 0171", None, "AA.SSSS"),
    ("It works now, thank you for that.\n-- \nJane Doe\nBack Office | Some Bank", None, "ASSS"),
    ("Fixed.\n\nOn Mon, Jan 3, 2022 at 4:00 PM Joe Bloggs <joe@a.example> wrote:\n> It is broken.\n>\n> Joe", None, "A.MMMM"),
    ("On Mon, Jan 3, 2022 at 4:00 PM Joe Bloggs\nwrote:\n> First question is here.\n\nYes, that is right.\n\n> Second question is here.\n\nNo, it is not.", None, "MMM.A.M.A"),
    ("See below.\n\n-----Original Message-----\nFrom: Joe <joe@a.example>\nSent: Monday, 3 January 2022 16:00\nTo: Jane\nSubject: RE: x\n\nThe old text.\n\nMore of the old text.", None, "A.UUUUU.U.U"),
    ("Voir plus bas.\n\nDe : Joe <joe@a.example>\nEnvoyé : 3.1.2022 16:00\nÀ : Jane\nObjet : x\n\nAncien texte.", None, "A.UUUU.U"),
    ("[EXTERNAL] This message came from outside the company.\nHi team,\nThe new text goes here.\n\nCONFIDENTIAL - this mail is intended for the person it is\naddressed to; delete it if it reached you by mistake.", None, "DAA.DD"),
    ("The new text goes here.\n\nSent from my phone", None, "A.D"),
    ("> The rate feed was moved to another server over the weekend and now\nanswers faster.\n\nGood to hear that it does.", None, "MM.A"),
    ("The new text goes here.\nJane", "Jane Doe <jane@a.example>", "AS"),
    ("Thanks for the quick fix, it works again.\nSubject: line of the alert mail is empty since 6.0.6.\nFrom: and To: dates on the report are swapped.\nSent: 72 / Received: 28 messages.", None, "AAAA"),
    ("-- MSG-1 -- repeated 34 times\n--> result in the queue\n>= 500 is refused, the rest goes through.\n| EUR/USD | 500 | rejected |\nThe words Best regards are missing in the template.\nRegards to the amount, nothing changed.", None, "AAAAAA"),
    ("Intro line here, as always.\n\n----------\n\nSecond part of the text, after a rule.", None, "A.A.A"),
    ("Many thanks Jane", None, "S"),
]


@pytest.mark.parametrize(("text", "author", "want"), CASES)
def test_spans(text, author, want):
    assert labels(text, author) == want
    assert labels(text.replace("\n", "\r\n"), author) == want


def test_new_text_and_defined_results():
    assert E.new_text("Hello,\nIt is broken.\n\nKind regards,\nJane Doe") == "Hello,\nIt is broken."
    assert E.new_text(None) is None and E.new_text("") == "" and E.label_lines("  \n ") == []
    long = "\n\n".join(["> a quoted line of some length that goes on", "A new line of text that was written just now."] * 4000)
    assert labels(long).replace(".", "") == "MA" * 4000
    assert set(labels("word " * 200_000)) == {"A"}


SCHEMA = "rec_id bigint, created_by string, body string, comments array<struct<author:string,body:string>>, label string"


def test_table(spark):
    rows = [(1, "x", "Text.\nSent from my phone", [None, ("a", None), (None, "Hi,\nBest,\nJo")], "clash"), (2, None, None, None, ""), (1, "x", "Text.\nSent from my phone", None, ""), (None, None, "> q", [], "")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["rec_id"] or 0), r["comment_no"], r["line_no"]) for r in E.other_lines(d).collect())
    assert got == [(0, 0, 1), (1, 0, 2), (1, 0, 2), (1, 3, 2), (1, 3, 3)]
    assert sorted((r["rec_id"] or 0, r["comment_no"], r["new_text"]) for r in E.reduced(d).where("rec_id = 1").collect())[0] == (1, 0, "Text.")
    assert E.other_lines(d.where("false")).count() == 0


@pytest.mark.parametrize("n", [58, 61, 120])
def test_rule_of_a_long_notice_is_not_authored(n):
    notice = "\n".join(["CONFIDENTIAL - this mail is intended for the person it is"] + ["addressed to; delete it if it reached you by mistake."] * n)
    assert labels("The new text goes here.\n\n----------\n" + notice) == "A." + "D" * (n + 2)


def score(kinds, labs):
    """What one division of a message earns, by the rules; null if a span may not open as it does."""
    rows = [(i, k) for i, k in enumerate(kinds) if k]
    total, i = 0.0, 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and labs[j + 1] == labs[i]:
            j += 1
        lab, first, end, lines = labs[i], rows[i][1], j + 1 == len(rows), j + 1 - i
        if lab != "A" and first not in E._OPENS[lab]:
            return None
        total += sum(E._EARNS[k][E.LABELS.index(lab)] for _, k in rows[i : j + 1]) + (E._OPENS[lab][first] if lab != "A" else 0.0)
        total -= E._MOVE[labs[i - 1], lab] if i else 0.0
        if lab == "U":
            total += 3.0 if end else -6.0
        if lab == "S":
            total -= max(0, lines - 8) * 0.7
            total -= 2.0 if first in ("short", "name", "contact") and i and rows[i][0] == rows[i - 1][0] + 1 else 0.0
            total -= 2.0 if i == 0 and first not in ("close", "rule") else 0.0
            total += 0.8 if end else 0.0
        if lab in "SD" and first == "rule" and lines == 1:
            total -= 3.0
        i = j + 1
    return total


def test_decoding_is_exact():
    rng = random.Random(4)
    some = ["short", "close", "name", "rule", "disc", "contact", "intro", "mark", "greet", "mobile", None]
    for _ in range(40):
        kinds = rng.choices(some, k=6)
        n = sum(k is not None for k in kinds)
        best = max(s for labs in itertools.product(E.LABELS, repeat=n) if (s := score(kinds, labs)) is not None)
        assert score(kinds, [x for x in E.decode(kinds) if x]) == pytest.approx(best, abs=1e-6)


def test_long_signatures_are_decoded_exactly():
    """Two labels only, as all divisions into authored and signature spans of longer messages can be tried."""
    rng = random.Random(8)
    for _ in range(30):
        kinds = ["plain", *rng.choices(["short", "short", "close", "contact"], k=11)]
        best = max(s for labs in itertools.product("AS", repeat=12) if (s := score(kinds, labs)) is not None)
        got = [x for x in E.decode(kinds) if x]
        assert score(kinds, got) >= best - 1e-6
