import random

import pytest

from tarn.llm import lang as L


@pytest.fixture(scope="module")
def profiles():
    return L.Profiles(L.fit([]))


HELD_OUT = {
    "en": ["The meeting will take place on the second floor after lunch.", "Please tell them that we are still waiting for an answer."],
    "de": ["Die Besprechung findet nach dem Mittagessen im zweiten Stock statt.", "Bitte sagen Sie ihnen, dass wir noch auf eine Antwort warten."],
    "fr": ["La réunion aura lieu au deuxième étage après le déjeuner.", "Dites-leur que nous attendons toujours une réponse de leur part."],
    "es": ["La reunión tendrá lugar en el segundo piso después del almuerzo.", "Dígales que todavía estamos esperando una respuesta de su parte."],
    "it": ["La riunione si terrà al secondo piano dopo il pranzo.", "Dite loro che stiamo ancora aspettando una risposta dagli altri."],
    "pt": ["A reunião será no segundo andar depois do almoço, não antes.", "Diga a eles que ainda não recebemos a resposta que você prometeu."],
    "nl": ["De vergadering vindt na de lunch op de tweede verdieping plaats.", "Zeg hun dat wij nog steeds op een antwoord wachten."],
    "pl": ["Spotkanie odbędzie się po obiedzie na drugim piętrze.", "Proszę im powiedzieć, że wciąż czekamy na odpowiedź."],
    "ru": ["Встреча состоится на втором этаже после обеда.", "Скажите им, что мы всё ещё ждём ответа."],
    "ja": ["会議は昼食のあとに二階で行われます。", "まだ返事を待っていると伝えてください。"],
}


def test_held_out_sentences(profiles):
    right = sum(L.stretches([t], profiles)[0][0][2] == lang for lang, ts in HELD_OUT.items() for t in ts)
    assert right >= 18  # of 20, from the seeds alone


def test_fitting_survives_wrong_labels():
    rng = random.Random(1)
    sample = []
    for lang, ts in HELD_OUT.items():
        sample += [(lang if rng.random() > 0.15 else rng.choice(list(HELD_OUT)), " ".join(ts))] * 20
    p = L.Profiles(L.fit(sample))
    assert all([s[2] for s in L.stretches([t], p)[0]] == [lang] for lang, ts in HELD_OUT.items() for t in ts)


def test_stretches_code_and_places(profiles):
    en, de = " ".join(HELD_OUT["en"]), " ".join(HELD_OUT["de"])
    text = f"## {en}\n```\nSELECT a FROM b\n```\n[5.1.2] WARN X-1 retry=3\n* {de}\n"
    got = L.stretches([text], profiles)[0]
    assert [(g[2], text[g[0] - 1 : g[0] + 2]) for g in got] == [("en", "The"), ("de", "Die")]
    assert L.stretches([f"{en} {de}"], profiles)[0][1][0] == len(en) + 2
    for empty in ("", "  \n", "SELECT a FROM b WHERE c = 1", '{"deal": 1, "err": "X"}', "123 456", "```\nfoo\n```"):
        assert L.stretches([empty, en, empty], profiles)[::2] == [[], []]


def test_labels():
    assert [L.label_code(x) for x in ("de-AT", "GER", "Deutsch", "français", "en_US", " EN ", "jpn")] == ["de", "de", "de", "fr", "en", "en", "ja"]
    assert [L.label_code(x) for x in (None, "", " ", "und", "unknown", "n/a", "xx")] == [None] * 7
    odd = ("British English", "Brazilian Portuguese", "en;q=0.9", "[en]", "lang=fr", "ISO: de", "jp", "English (US)", "pt_BR.UTF-8", "zh-DE", "German/French", "de facto")
    assert [L.label_code(x) for x in odd] == ["en", "pt", "en", "en", "fr", "de", "ja", "en", "pt", None, None, "de"]


def brute_distances(profiles, ranked, words):
    """By the book: own ranking with ties sharing their middle rank, absent n-grams at the profiles' length."""
    from collections import Counter

    cut = {lang: {g: r for r, g in enumerate(gs[: profiles.length])} for lang, gs in ranked.items()}
    known = set().union(*cut.values())
    own = Counter(g if g in known else "?" for w in words for g in L.grams(w))
    out = []
    for lang in profiles.langs:
        total = 0
        for g, c in own.items():
            mine = sum(d > c for d in own.values()) + sum(d == c for d in own.values()) / 2
            total += c * (min(abs(cut[lang][g] - mine), profiles.length) if g in cut[lang] else profiles.length)
        out.append(total / (sum(own.values()) * profiles.length))
    return out


def test_distances_equal_brute_force():
    ranked = L.fit([])
    p = L.Profiles(ranked)
    texts = [L.words_of(t) for ts in HELD_OUT.values() for t in ts] + [[], ["xq" * 500], ["a"], L.words_of(HELD_OUT["en"][0] * 30)]
    got = p.distances(texts)
    for words, d in zip(texts, got, strict=True):
        assert d == pytest.approx(brute_distances(p, ranked, words) if words else [1.0] * len(p.langs), abs=1e-5)


def test_sample_of_one_language_does_not_draw_texts_to_others():
    """Only English is labelled: its profile learns, those of the others stay short, and still nobody else's text turns English."""
    english = [("en", " ".join(HELD_OUT["en"] + [f"The person who opened case {w} asked whether it should be there." for w in ("one", "two", "three")]))] * 100
    p = L.Profiles(L.fit(english))
    right = sum([s[2] for s in L.stretches([t], p)[0]] == [lang] for lang, ts in HELD_OUT.items() for t in ts)
    assert right >= 18


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_draws_agree(spark):
    """Whatever documents the hash draws, the same stretches come out but for a few."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for k in range(3):
        moved = docs.withColumn("doc_id", F.col("doc_id") + k * 1_000_003)
        got = L.identify(docs, L.fit_profiles(moved, 40)).where("not label_ok")
        found.append({(r["doc_id"], r["start_pos"], r["lang"]) for r in got.collect()})
    assert all(len(a & b) >= 0.97 * max(len(a), len(b)) for a in found for b in found)


def test_table(spark):
    docs = [(1, HELD_OUT["en"][0], "en", 1), (2, HELD_OUT["en"][0], "de", 1), (3, HELD_OUT["de"][0], None, 1), (4, None, "en", 1), (5, "", "en", 1), (2, HELD_OUT["en"][0], "de", 1), (None, HELD_OUT["ru"][0], "ru", 1), (6, HELD_OUT["en"][1] * 3000, "en", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, confidence int")
    rows = L.identify(d, L.fit_profiles(d)).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in rows if not r["label_ok"]) == [(2, "en"), (2, "en"), (3, "de")]
    assert all(0.5 <= r["confidence"] <= 1 for r in rows) and len(rows) == 6
    e = d.where("false")
    assert L.identify(e, L.fit_profiles(e)).count() == 0
