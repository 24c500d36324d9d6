import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import pii as P

LEX = P.Lexicon(["Rose Miller-Kahn", "Mark van der Berg", "Oskar Lindqvist", "April O'Hara", "Will Tennant"])


def found(text):
    return [(text[a:z], k) for a, z, k in P.find(text, LEX)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail jo.x+y@mail.a-b.example, or jo [at] a (dot) example.", [("jo.x+y@mail.a-b.example", "email"), ("jo [at] a (dot) example", "email")]),
        ("mailto:JO@A.EXAMPLE and jo＠a.example and drew.x @ a.example.", [("JO@A.EXAMPLE", "email"), ("jo＠a.example", "email"), ("drew.x @ a.example", "email")]),
        ("The field @author is empty; sold 5 @ 1.0845 and bought", []),
        ("Call (604) 555-0115 or +44 20 7946 0640, 0049 30 55507167.", [("(604) 555-0115", "phone"), ("+44 20 7946 0640", "phone"), ("0049 30 55507167", "phone")]),
        ("Deal number 4165917890 has reference 2024-08-82-0017. Order id 0049 946968 118 from 10.20.30.40, build 3.0.39.1180", []),
        ("SIN 037 639 118, passport number is X0Z456020, NINO=QQ009949D", [("037 639 118", "id_number"), ("X0Z456020", "id_number"), ("QQ009949D", "id_number")]),
        ("Steuer-ID 00 946 126 636; SSN: 666252357; DNI 00039640-T; tax number: 00-5213934", [("00 946 126 636", "id_number"), ("666252357", "id_number"), ("00039640-T", "id_number"), ("00-5213934", "id_number")]),
        ("lives at 853 Juniper Crescent, Pellmont, NY 00103", [("853 Juniper Crescent, Pellmont, NY 00103", "address")]),
        ("Flat 17, 1903 Harrow Row,\nWick QQ8 4ZZ", [("Flat 17, 1903 Harrow Row,\nWick QQ8 4ZZ", "address")]),
        ("Obere Gerberstraße 98, 00083 Altbrück / Am Kupfertor 118, 00783 Altbrück", [("Obere Gerberstraße 98, 00083 Altbrück", "address"), ("Am Kupfertor 118, 00783 Altbrück", "address")]),
        ("Calle del Molino 57, 2º B, 00040 Vill et 73 bis rue des Tanneurs, 00799 Orvain", [("Calle del Molino 57, 2º B, 00040 Vill", "address"), ("73 bis rue des Tanneurs, 00799 Orvain", "address")]),
        ("Template 79 Broadgate Layout prints the wrong branch.", []),
        ("Dear Oskar, according to mark van der berg's notes and Miller-Kahn, Rose", [("Oskar", "name"), ("mark van der berg", "name"), ("Miller-Kahn, Rose", "name")]),
        ("T. Lindqvist and ROSE K. MILLER-KAHN and Will\nTennant", [("T. Lindqvist", "name"), ("ROSE K. MILLER-KAHN", "name"), ("Will\nTennant", "name")]),
        ("Will the rate change in April? Mark the deal. Rose chart colours. > Will retry.", []),
        ("Please call Nadia Unheard on 01 99 00 98 25", [("Nadia Unheard", "name"), ("01 99 00 98 25", "phone")]),
        ("born 1980-02-03 in town", [("1980-02-03", "date")]),
        (None, []),
        ("", []),
    ],
)
def test_finds(text, want):
    assert found(text) == want


KEY = b"k"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([10, 26]), min_size=1, max_size=14).flatmap(lambda rs: st.tuples(*(st.tuples(st.integers(0, r - 1), st.just(r)) for r in rs))))
def test_feistel_is_a_permutation_of_the_format(symbols):
    out = P.permute(list(symbols), KEY, "t")
    assert all(0 <= v < r for v, (_, r) in zip(out, symbols, strict=True))
    back = P.permute([(v, r) for v, (_, r) in zip(out, symbols, strict=True)], KEY, "t", back=True)
    assert back == [v for v, _ in symbols]


def test_small_formats_are_permuted_one_to_one():
    assert len({tuple(P.permute([(a, 10), (b, 10), (c, 10)], KEY, "t")) for a in range(10) for b in range(10) for c in range(10)}) == 1000


def test_pseudonyms_keep_format_checks_and_links():
    sin = "046 454 286"
    got = P.pseudonym(sin, "id_number", KEY)
    digits = [int(c) for c in got if c.isdigit()]
    assert got[3] == got[7] == " " and P._luhn(digits[:8]) == digits[8] and got == P.pseudonym(sin, "id_number", KEY) != sin
    assert P.pseudonym("+1 (604) 555-0115 ext. 12", "phone", KEY).startswith("+1 (604) ") and P.pseudonym("+1 (604) 555-0115 ext. 12", "phone", KEY).endswith(" ext. 12")
    days = {P.pseudonym(f"1980-{m:02d}-{d:02d}", "date", KEY) for m in range(1, 13) for d in range(1, 29)}
    assert len(days) == 336 and all(x[4] == "-" for x in days)
    assert P.pseudonym("x0z", "id_number", KEY) != P.pseudonym("x0z", "id_number", b"other")


SCHEMA = "rec_id bigint, title string, text string, body string, comments array<struct<author:string,body:string>>, kind string"


def test_check_digits_stay_right():
    cpf, pesel, tax, bsn, fiscal = "111.444.777-35", "44051401359", "86095742719", "111222333", "RSSMRA85T10A562S"
    for value, n, f in ((cpf, 2, lambda c: P._mod11(P._digits(c))), (pesel, 1, lambda c: P._pesel(P._digits(c))), (tax, 1, lambda c: P._iso7064(P._digits(c))), (bsn, 1, lambda c: P._eleven_test(P._digits(c))), (fiscal, 1, P._codice)):
        core = "".join(c for c in value if c.isalnum())
        assert f(core[:-n]) == core[-n:]
        got = P.pseudonym(value, "id_number", KEY)
        new = "".join(c for c in got if c.isalnum())
        assert got != value and f(new[:-n]) == new[-n:] and [c.isdigit() for c in got] == [c.isdigit() for c in value]
    made = {P.pseudonym(f"{n:08d}{P._eleven_test(P._digits(f'{n:08d}'))}", "id_number", KEY) for n in range(3000) if P._eleven_test(P._digits(f"{n:08d}")) != "x"}
    assert len(made) == sum(P._eleven_test(P._digits(f"{n:08d}")) != "x" for n in range(3000))


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_names_the_lexicon_lacks(spark):
    """Names of the test tickets are exchanged for ones no author bears; the classifier has to find them by what stands around them."""
    strange = ["Zanele Mbeki", "Oluwaseun Adeyemi", "Tuomas Kivelä", "Ngozi Ekwueme", "Ragnhild Sørby", "Thandiwe Nkosi", "Xiomara Quispe", "Bogumil Drzewiecki"]
    tickets = spark.read.parquet("/root/testdata/sf0.01/ticket.parquet")
    names = P.fit_names(tickets)
    lex = P.Lexicon.of(names)
    got = all_of = more = 0
    for r in tickets.select("rec_id", "text", "body").collect():
        for text in filter(None, (r["text"], r["body"])):
            whole = [(a, z) for a, z, k in P.find(text, lex) if k == "name" and " " in text[a:z] and text[a].isupper() and not text[a:z].isupper() and "\n" not in text[a:z] and "." not in text[a:z] and "," not in text[a:z]]
            out, at, places = "", 0, []
            for n, (a, z) in enumerate(whole):
                new = strange[(r["rec_id"] + n) % len(strange)]
                out += text[at:a]
                places.append((len(out), len(out) + len(new)))
                out, at = out + new, z
            out += text[at:]
            found = {(a, z) for a, z, k in P.find(out, lex) if k == "name"}
            got += len(found & set(places))
            all_of += len(places)
            more += len(found) - len({(a, z) for a, z, k in P.find(text, lex) if k == "name"})
    print("found", got, "of", all_of, "others", more)
    assert all_of > 500 and got >= 0.9 * all_of
    for text, name in (("Zanele Mbeki has not received the confirmation.", "Zanele Mbeki"), ("I spoke with Oluwaseun Adeyemi yesterday.", "Oluwaseun Adeyemi")):
        assert [text[a:z] for a, z, k in P.find(text, lex) if k == "name"] == [name]
    address = "Office at 12 King St W, Toronto; bring the form."
    assert [address[a:z] for a, z, k in P.find(address, lex) if k == "address"] == ["12 King St W, Toronto"]


def test_more_names_than_are_broadcast(spark):
    rows = [(1, "For Ada Quist", "Ask Vera Holm and Ada", None, [("Ada Quist", None), ("Vera Holm", None)], ""), (2, None, "Dear Vera, Ada Holm called", "", None, ""), (None, "Ada Quist", None, None, None, "")]
    d = spark.createDataFrame(rows, SCHEMA)
    few, many = P.fit_names(d), P.fit_names(d, max_parts=2)
    assert few.own is None and many.own is not None and many.given == ()
    as_rows = lambda names: sorted(map(repr, P.find_details(d, names).collect()))
    assert as_rows(few) == as_rows(many) != []


def test_the_classifier_counts_all_tickets(spark):
    """30,000 tickets: a word used four times, wherever that is, is in use, one used twice is not; every pair is counted."""
    n = 30_000
    text = "concat('note often', rec_id % 7500, if(rec_id % 15000 < 50, concat(' seldom', rec_id % 15000), ''), '; asked Ada Quist now')"
    d = spark.range(n).selectExpr("id rec_id").selectExpr("rec_id", "cast(null as string) title", f"{text} text", "'' body", "array(named_struct('author', 'Ada Quist', 'body', '')) comments")
    context = P.fit_names(d).context
    assert context.words == {"note", "asked", "now", *(f"often{k}" for k in range(7500))}
    assert (context.named, context.pairs) == (n, n)


def test_more_words_than_are_broadcast(spark):
    texts = [
        *["Ada Quist has called, says Ada Quist today"] * 4, *["Open Rate Desk now"] * 4, *["use Rate-Desk Window, then Open it"] * 4,
        "Zanele Mbeki has no access", "I asked Oluwaseun Adeyemi today", "says Rate Desk today", "use Window Nkosi then", "Thandiwe-Rate Nkosi has it", "Ngozi O'Rate has it",
    ]
    d = spark.createDataFrame([(k, None, t, "", [("Ada Quist", None), ("Vera Holm", None)], "") for k, t in enumerate(texts)] + [(None, None, texts[-4], None, None, ""), (0, None, texts[0], None, None, "")], SCHEMA)
    whole = P.fit_names(d)
    as_rows = lambda names: sorted(map(repr, P.find_details(d, names).collect()))
    found = as_rows(whole)
    assert whole.own is None and len(found) == 12 and any("rec_id=12," in r for r in found) and not any("rec_id=16," in r for r in found)
    few = P.fit_names(d, max_words=12)
    assert few.own is not None and 0 < len(few.context.words) + len(few.context.before) + len(few.context.after) <= 12
    assert as_rows(few) == found
    none = P.fit_names(d, max_parts=1, max_words=0)
    assert none.own is not None and none.given == () and (none.context.named, none.context.pairs) == (whole.context.named, whole.context.pairs)
    assert as_rows(none) == found


def test_table(spark):
    rows = [(1, "For Ada Quist", None, "", [("Ada Quist <a@b.example>", None), None], "clash"), (2, None, None, None, None, ""), (1, "For Ada Quist", None, "", None, ""), (3, "y" * 400_000, "SIN 037 639 118 and SIN 037 639 118", "555", [], "")]
    d = spark.createDataFrame(rows, SCHEMA)
    names = P.fit_names(d)
    assert (names.given, names.last) == (("ada",), ("quist",))
    got = sorted((r["rec_id"], r["field"], r["kind"], r["start_pos"]) for r in P.find_details(d, names).collect())
    assert got == [(1, "title", "name", 5), (1, "title", "name", 5), (3, "text", "id_number", 5), (3, "text", "id_number", 25)]
    red = {r["rec_id"]: r for r in P.redact(d, names, KEY).collect()}
    assert red[1]["title"].startswith("For [NAME ") and red[2]["title"] is None and red[1]["body"] == ""
    a, b = red[3]["text"].split(" and ")
    assert a == b and a.startswith("SIN [ID_NUMBER ")
    assert P.find_details(d.where("false"), P.fit_names(d.where("false"))).count() == 0
