"""Language of documents and of the stretches of mixed ones, by rank-order profiles.

A profile is the list of a language's n-grams from the most frequent down.  A unit of text (a sentence or line) is
compared to each profile by the out-of-place distance between its own n-gram ranking and the profile's; n-grams a
profile lacks count as its length.  All profiles are cut to the same length, that of the shortest, as a longer one
would be charged less for the same text.  The distances of a document's units, weighted by their letters, are decoded
together with a charge for every change of language, so short headings and names follow their neighbours while
real changes, even within a line, are kept.

Profiles are fitted on a bounded sample of labelled documents, drawn by hash language by language (``SAMPLE`` documents
of each, and at most ``UNITS`` units) after seeding them with a few sentences per language; units whose nearest seeded
profile disagrees with their document's label are left out, so wrong labels do no harm.  A language nobody labelled
keeps its seeds.  Everything else runs over all documents.

Defined results: null, empty and blank texts, and texts with code or log lines only, have no stretches; such lines
between prose belong to the stretch before them.  A label is right if any notation of it names the one language of
the text; repeated documents each get their rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.tables import spread

#: Labelled documents of each language the profiles are fitted on, at most.
SAMPLE = 300
#: Units a language is fitted on, at most.
UNITS = 800
#: N-grams of a profile, at most.
PROFILE = 3000
GRAMS = (1, 2, 3, 4)
#: What a change of language costs, in letters fully out of place.
SWITCH = 5.0

# The languages with the codes and names labels use for them.
NAMES = {
    "en": "eng english englisch anglais inglés inglese inglês engels angielski английский 英語",
    "de": "deu ger german deutsch allemand alemán tedesco alemão duits niemiecki немецкий ドイツ語",
    "fr": "fra fre french français francais französisch francés francese francês frans francuski французский フランス語",
    "es": "spa spanish español espanol castellano spanisch espagnol spagnolo espanhol spaans hiszpański испанский スペイン語",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portoghese portugees portugalski португальский ポルトガル語",
    "it": "ita italian italiano italienisch italien italiaans włoski итальянский イタリア語",
    "nl": "nld dut dutch nederlands niederländisch néerlandais neerlandés olandese holandês holenderski нидерландский オランダ語",
    "pl": "pol polish polski polnisch polonais polaco polacco polonês pools польский ポーランド語",
    "ru": "rus russian русский russisch russe ruso russo rosyjski ロシア語",
    "ja": "jpn japanese 日本語 japanisch japonais japonés giapponese japonês japans japoński японский jp",
}
# Seed sentences, only to start the fitting from.
SEEDS = {
    "en": "The first page shows what has changed since the last version and how you can use it. If you do not see the list, ask the person who is responsible for it. They will have to check that all of these are right before they send it with the other one. It was not there when we looked, but this is where it should be. Which of them would you like to open?",
    "de": "Die erste Seite zeigt, was sich seit der letzten Version geändert hat und wie man es benutzt. Wenn Sie die Liste nicht sehen, fragen Sie bitte die Person, die dafür zuständig ist. Sie muss prüfen, ob alles richtig ist, bevor es mit den anderen gesendet wird. Es war nicht da, als wir nachgesehen haben, aber hier sollte es sein. Welche davon möchten Sie öffnen?",
    "fr": "La première page montre ce qui a changé depuis la dernière version et comment vous pouvez l'utiliser. Si vous ne voyez pas la liste, demandez à la personne qui en est responsable. Elle devra vérifier que tout est juste avant de l'envoyer avec les autres. Ce n'était pas là quand nous avons regardé, mais c'est ici que cela devrait être. Lequel voulez-vous ouvrir ?",
    "es": "La primera página muestra lo que ha cambiado desde la última versión y cómo se puede usar. Si usted no ve la lista, pregunte a la persona que es responsable de ella. Tendrá que comprobar que todo está bien antes de enviarlo con los otros. No estaba allí cuando miramos, pero aquí es donde debería estar. ¿Cuál de ellos quiere abrir?",
    "pt": "A primeira página mostra o que mudou desde a última versão e como você pode usá-la. Se você não vê a lista, pergunte à pessoa que é responsável por ela. Ela terá de verificar se tudo está certo antes de enviá-lo com os outros. Não estava lá quando nós olhamos, mas é aqui que deveria estar. Qual deles você quer abrir? As informações não são enviadas.",
    "it": "La prima pagina mostra che cosa è cambiato dall'ultima versione e come si può usarla. Se non vedete l'elenco, chiedete alla persona che ne è responsabile. Dovrà controllare che tutto sia giusto prima di inviarlo con gli altri. Non c'era quando abbiamo guardato, ma è qui che dovrebbe essere. Quale di questi volete aprire? Gli utenti della banca non possono più.",
    "nl": "De eerste pagina toont wat er sinds de laatste versie is veranderd en hoe u het kunt gebruiken. Als u de lijst niet ziet, vraag het dan aan de persoon die er verantwoordelijk voor is. Die moet controleren of alles juist is voordat het met de andere wordt verstuurd. Het was er niet toen we keken, maar hier hoort het te zijn. Welke daarvan wilt u openen?",
    "pl": "Pierwsza strona pokazuje, co zmieniło się od ostatniej wersji i jak można z tego korzystać. Jeśli nie widzisz listy, zapytaj osobę, która jest za nią odpowiedzialna. Musi ona sprawdzić, czy wszystko jest w porządku, zanim zostanie wysłane z innymi. Nie było tego, kiedy patrzyliśmy, ale tutaj powinno być. Który z nich chcesz otworzyć?",
    "ru": "Первая страница показывает, что изменилось с последней версии и как это можно использовать. Если вы не видите список, спросите человека, который за него отвечает. Он должен проверить, что всё правильно, прежде чем отправить это с другими. Этого не было, когда мы смотрели, но здесь это должно быть. Какой из них вы хотите открыть?",
    "ja": "最初のページには、前の版から何が変わったか、どのように使えるかが書いてあります。一覧が見えないときは、担当の人に聞いてください。ほかのものと一緒に送る前に、すべてが正しいかどうかを確かめる必要があります。見たときにはありませんでしたが、ここにあるはずです。どれを開きますか。",
}

LANGS = tuple(NAMES)
_BY_NAME = {name: code for code, names in NAMES.items() for name in (code, *names.split())}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]*_]*(?=\s)|[。！？]+[」』”）]*|(?<=\s)/(?=\s)|(?<=\s)\|(?=\s)")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_CODE = re.compile(
    r"""^\s*(?:
      (?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/\S*
    | (?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH|MERGE)\s.*\b(?:FROM|INTO|SET|TABLE|VALUES|WHERE|USING)\b
    | \[?[\d.:,\-T/\s]{3,}Z?\]?\s*\[?(?:WARN(?:ING)?|INFO|ERROR|DEBUG|TRACE|FATAL|NOTICE)\b
    | \[?(?:WARN(?:ING)?|INFO|ERROR|DEBUG|TRACE|FATAL)\]?[\s:]+\S*[=\[]
    | [{\[].*["'\]}]\s*[:,].*[}\]],?\s*$
    | \{.*\}\s*;?\s*$
    | \d+=[^|\s]+\|
    | at\s+[\w.$<>]+\([^)]*\)\s*$
    | Traceback\s\(most\srecent
    | (?:\$|>>>|\#!)\s*\S+
    | (?:import|from)\s+[\w.]+(?:\s+import\s.*|;)?$
    | (?:def|class|function|var|let|const|return|public|private)\s+[\w$]+.*[({=;:]\s*$
    | </?\w+[^>]*>\s*(?:[^<]*</\w+>)?\s*$
    | (?:[\w.\-]+=\S+\s*){2,}$
    )""",
    re.VERBOSE,
)


_SIGN = re.compile(r"[^\w\s.,!?\-'\"’“”()*:#>…。、，]|_")
_TAG = re.compile(r"(?:(?:lang(?:uage)?|locale|iso(?:[ _-]?639(?:-[1-3])?)?)\s*[:=]\s*)?([^\W\d_]{2,3})(?:[-_.@;(,/ ].*)?", re.DOTALL)
_NAME = re.compile(r"[^\W\d_]+")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, in any notation; null if it names none of the languages, or several.

    Codes may carry a region, a script, a weight or a prefix (``en-GB``, ``en;q=0.9``, ``[fr]``, ``lang=fr``); names may
    stand among other words (``British English``)."""
    name = (label or "").strip(" \t\r\n[](){}<>\"'").casefold()
    if name in _BY_NAME:
        return _BY_NAME[name]
    tag = _TAG.fullmatch(name)
    if tag:
        return _BY_NAME.get(tag[1])
    named = {_BY_NAME[w] for w in _NAME.findall(name) if len(w) > 3 or not w.isascii() if w in _BY_NAME}
    return named.pop() if len(named) == 1 else None


@dataclass(slots=True)
class Unit:
    """A stretch of prose to be compared: where it starts and ends, its first letter and its words."""

    start: int
    end: int
    letter: int
    words: list[str]
    letters: int


def is_code(line: str) -> bool:
    if _CODE.match(line):
        return True
    body = line.strip()
    return len(body) >= 12 and len(_SIGN.findall(body)) > 0.18 * len(body)


def words_of(text: str) -> list[str]:
    """Words as compared, in lower case: without codes in capitals and, where enough others are left, words that begin
    with a capital within the text, which are mostly names and belong to no language."""
    texts = _WORD.findall(text)
    if not texts:
        return []
    if text.isupper():
        return [w.lower() for w in texts]
    plain = [w for i, w in enumerate(texts) if i == 0 or not w[0].isupper()]
    if sum(map(len, plain)) >= 4:
        texts = plain
    return [w.lower() for w in texts if len(w) > 5 or len(w) == 1 or not w.isupper() or not w.isascii()]


def units(text: str) -> list[Unit]:
    """The prose of a text in units, in order; fences, code and log lines are left out."""
    out: list[Unit] = []
    at, fenced = 0, False
    for line in text.splitlines(keepends=True):
        here, at = at, at + len(line)
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or is_code(line):
            continue
        cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            letter = _LETTER.search(line, a, z)
            if letter is None:
                continue
            first = letter.start()
            ws = words_of(line[a:z])
            letters = sum(map(len, ws))
            if len(cuts) == 2 and line.rstrip()[-1:].isalnum():  # a heading: names weigh heavily in it
                letters //= 2
            out.append(Unit(here + a, here + z, here + first, ws, letters))
    return out


class Profiles:
    """Ranks of n-grams in every language, all lists cut to the length of the shortest."""

    def __init__(self, ranked: dict[str, list[str]]) -> None:
        self.langs = sorted(ranked)
        self.length = min(map(len, ranked.values()))
        grams = sorted({g for gs in ranked.values() for g in gs[: self.length]})
        self.row = {g: i + 1 for i, g in enumerate(grams)}
        self.ranks = np.full((len(grams) + 1, len(self.langs)), 4 * self.length, dtype=np.float32)
        for k, lang in enumerate(self.langs):
            for r, g in enumerate(ranked[lang][: self.length]):
                self.ranks[self.row[g], k] = r
        self.known: dict[str, bytes] = {}

    def rows(self, word: str) -> bytes:
        """The rows of a word's n-grams, as 32-bit numbers; those of recent words are remembered."""
        get = self.row.get
        got = array("i", [get(g, 0) for g in grams(word)]).tobytes()
        if len(word) <= 40:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got

    def distances(self, texts: list[list[str]]) -> np.ndarray:
        """The mean out-of-place distance of each list of words to each profile, from 0 to 1; without words, 1.

        All lists are compared at once: (list, n-gram) pairs are counted by one sort, and each list's n-grams get
        their own ranks from the most frequent down, equal counts sharing their middle rank."""
        out = np.ones((len(texts), len(self.langs)))
        known, rows = self.known.get, self.rows
        parts: list[bytes] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, words in enumerate(texts):
            own = b"".join([known(w) or rows(w) for w in words])
            parts.append(own)
            sizes[i] = len(own) // 4
        found = np.frombuffer(b"".join(parts), dtype=np.int32)
        if not len(found):
            return out
        width = len(self.ranks)
        pairs, counts = np.unique(np.repeat(np.arange(len(texts)) * width, sizes) + found, return_counts=True)
        at = pairs // width
        order = np.lexsort((-counts, at))
        at, ids, counts = at[order], (pairs % width)[order], counts[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        tie = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (counts[1:] != counts[:-1])])
        shared = np.diff(np.r_[tie, len(at)])
        own = np.repeat(tie + shared / 2, shared) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        place = self.ranks[ids]
        place -= own[:, None].astype(np.float32)
        np.abs(place, out=place)
        np.minimum(place, self.length, out=place)
        place *= counts[:, None].astype(np.float32)
        out[at[first]] = np.add.reduceat(place, first, axis=0) / (sizes[at[first]][:, None] * self.length)
        return out


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]


def ranked(counts: Counter[str]) -> list[str]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]


def fit(samples: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Profiles from (language, text) pairs whose languages may be wrong."""
    counts = {lang: Counter(g for w in words_of(t) for g in grams(w)) for lang, t in SEEDS.items()}
    parts: list[tuple[str, list[str]]] = []
    seen: Counter[str] = Counter()
    for lang, text in samples:
        for u in units(text) if seen[lang] < UNITS else ():
            if u.letters >= 20 and seen[lang] < UNITS:
                seen[lang] += 1
                parts.append((lang, u.words))
    for slack in (0.08, 0.02):  # first by the seeds, which know few words, then by what they taught
        now = Profiles({lang: ranked(c) for lang, c in counts.items()})
        at = {lang: k for k, lang in enumerate(now.langs)}
        fresh = {lang: Counter(g for w in words_of(t) for g in grams(w)) for lang, t in SEEDS.items()}
        for (lang, ws), far in zip(parts, now.distances([ws for _, ws in parts]), strict=True):
            if far[at[lang]] <= far.min() + slack:
                fresh[lang].update(g for w in ws for g in grams(w))
        counts = fresh
    return {lang: ranked(c) for lang, c in counts.items()}


def _codes(labels: pd.Series) -> pd.Series:
    return labels.map(label_code, na_action="ignore")


def fit_profiles(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Profiles from at most ``sample`` labelled documents of each language, drawn by the hash of their ids.

    The labels are counted first, from their column alone; then each language's documents pass by a share that leaves
    about four times the sample, so what is ranked and collected is bounded whatever the size or balance of the input."""
    _code = F.pandas_udf(_codes, T.StringType())
    labels = docs.where("text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("code", _code("lang"))
    counts = {r["code"]: r["n"] for r in labels.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")).collect()}  # a row a language
    if not counts:
        return fit([])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profiles")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    share = F.create_map(*(F.lit(x) for code, n in counts.items() for x in (code, min(1.0, 4.0 * sample / n))))
    few = docs.where("text is not null").select("doc_id", "lang", "text", draw.alias("draw")).where(F.col("draw") < max(min(1.0, 4.0 * sample / n) for n in counts.values()))
    few = few.withColumn("code", _code("lang")).where(F.col("draw") < share[F.col("code")])
    nth = F.row_number().over(Window.partitionBy("code").orderBy("draw", "doc_id"))
    rows = few.withColumn("nth", nth).where(F.col("nth") <= sample).select("code", "draw", "doc_id", "text").collect()
    return fit([(r["code"], r["text"]) for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"], r["text"]))])


def _path(costs: np.ndarray) -> np.ndarray:
    """The cheapest sequence of languages; where all units are nearest to the same one, that one."""
    nearest = costs.argmin(axis=1)
    if (nearest == nearest[0]).all():
        return nearest
    same = np.arange(costs.shape[1])
    best, back = costs[0], []
    for c in costs[1:]:
        least = int(np.argmin(best))
        stay = best <= best[least] + SWITCH
        back.append(np.where(stay, same, least))
        best = np.where(stay, best, best[least] + SWITCH) + c
    path = [int(np.argmin(best))]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def stretches(texts: list[str], profiles: Profiles) -> list[list[tuple[int, int, str, float]]]:
    """(place of the first letter from 1, last place, language, confidence) of each stretch of each text."""
    parts = [units(t) for t in texts]
    flat = [u for us in parts for u in us]
    if not flat:
        return [[] for _ in texts]
    costs = profiles.distances([u.words for u in flat]) * np.maximum([u.letters for u in flat], 1)[:, None]
    out: list[list[tuple[int, int, str, float]]] = []
    at = 0
    for text, us in zip(texts, parts, strict=True):
        own, at = costs[at : at + len(us)], at + len(us)
        got: list[tuple[int, str, float]] = []
        if us:
            path = _path(own)
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            for i, total in zip(starts.tolist(), np.add.reduceat(own, starts, axis=0), strict=True):
                least = total[path[i]]
                total[path[i]] = np.inf
                margin = min(float(total.min() - least), 50.0)
                got.append((us[i].letter + 1, profiles.langs[path[i]], 1.0 / (1.0 + math.exp(-max(margin, -50.0)))))
        ends = [a - 1 for a, _, _ in got[1:]] + [len(text)]
        out.append([(a, z, lang, conf) for (a, lang, conf), z in zip(got, ends, strict=False)])
    return out


@lru_cache(maxsize=2)
def _profiles(key: tuple[tuple[str, tuple[str, ...]], ...]) -> Profiles:
    return Profiles({lang: list(gs) for lang, gs in key})


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None], list[str]]]:
    """A batch in parts of about a quarter million characters, so that a part's arrays stay small."""
    ids, labels, texts = ([], [], [])
    size = 0
    for doc, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        ids.append(doc), labels.append(label), texts.append(text)
        size += len(text)
        if size >= 250_000:
            yield ids, labels, texts
            ids, labels, texts, size = [], [], [], 0
    if ids:
        yield ids, labels, texts


STRETCHES = "doc_id bigint, label string, stretch_no int, n_stretches int, start_pos int, end_pos int, lang string, confidence double, label_ok boolean"


def identify(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Every stretch of every document, with its language and confidence and whether the label is right."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple((lang, tuple(gs)) for lang, gs in sorted(profiles.items())))  # at most 10 x PROFILE n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _profiles(shared.value)
        types = (pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.float64(), pa.bool_())
        names = [c.split()[0] for c in STRETCHES.split(", ")]
        for batch in batches:
            out = []
            for ids, labels, texts in _slices(batch):
                for doc, label, got in zip(ids, labels, stretches(texts, own), strict=True):
                    ok = len(got) == 1 and label_code(label) == got[0][2]
                    out += [(doc, label, n + 1, len(got), a, z, lang, conf, ok) for n, (a, z, lang, conf) in enumerate(got)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return spread(docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text")).mapInArrow(run, STRETCHES)
