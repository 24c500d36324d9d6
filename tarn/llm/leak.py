"""Evaluation texts leaking into a corpus.

All runs of ``WORDS`` consecutive words of every question and keypoint go into one Aho-Corasick automaton over
normalised text; each document is normalised and scanned once.  For the automaton every word of the items is a code of
``CODE`` characters, all other words are one code more: that keeps the automaton small whatever the words' lengths, and
the place of a match tells its words.  Where offsets are wanted, the normalising of a document with matches is repeated
with the original place of every character kept through each of the same steps, and the places are read off there.

Normalising: HTML entities are resolved, tags, Markdown link targets and emphasis marks and invisible characters
dropped, compatibility forms folded (NFKC), case folded; words are runs of letters and digits.  A text with words
broken by a hyphen at a line end is scanned both as it is and with those words joined.

Defined results: null, empty or shorter items have no patterns and are never reported; repeated questions are
reported under each of their ids; null and empty documents leak nothing; repeated documents each get their rows.
Items of more than ``MAX_CHARS`` characters in all are scanned in blocks of about that size, one automaton and one scan
of the corpus each.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Characters of items per automaton. Measured: 1,372,000 characters in 98,000 runs of words take 140 MB in a worker; items of
#: many sentences have up to twice as many runs a character.
MAX_CHARS = 1_200_000
#: Characters that stand for a word in the automaton, and how many different ones there are.
CODE, SIGNS = 3, 256

_WORD = re.compile(r"[^\W_]+")
_TAG_BREAK = re.compile(r"<(?:/?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*|!--.*?--)>", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"(?<=\])\((?:<[^<>\n]*>|[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_EMPHASIS = re.compile(r"(?<=\w)(?:\*{1,3}|~~|`+|__+)(?=\w)")
_MARK = re.compile(r"[̀-ͯ]")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_BREAK_HYPHEN = re.compile(r"(?<=[^\W\d_])[‐­-][ \t]*\r?\n[ \t>]*(?=[^\W\d_])")


def _invisible() -> re.Pattern[str]:
    """Format characters, variation selectors and the grapheme joiner."""
    ranges = ["­", "͏", "؜", "ᅟ-ᅠ", "឴-឵", "᠋-᠏", "​-‏", "‪-‮", "⁠-⁯", "ㅤ", "︀-️", "﻿", "ﾠ", "\U000e0000-\U000e0fff"]
    return re.compile("[" + "".join(ranges) + "]")


_INVISIBLE = _invisible()


def folded(text: str) -> str:
    """The text without markup and invisible characters, in one case and compatibility form."""
    if "&" in text:
        text = html.unescape(text)
    text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub("", _TAG_BREAK.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    text = _EMPHASIS.sub("", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKC", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    return _WORD.findall(folded(text)) if text else []


def runs(items: list[tuple[int, list[str | None]]]) -> dict[tuple[str, ...], list[int]]:
    """Every run of WORDS words of the items' texts, with the ids of the items that have it."""
    out: dict[tuple[str, ...], set[int]] = {}
    for item, texts in items:
        for t in texts:
            ws = words(t)
            for i in range(len(ws) - WORDS + 1):
                out.setdefault(tuple(ws[i : i + WORDS]), set()).add(item)
    return {p: sorted(ids) for p, ids in sorted(out.items())}


class Searcher:
    """The automaton and the codes of its words."""

    def __init__(self, items: tuple[tuple[int, tuple[str | None, ...]], ...]) -> None:
        self.codes: dict[str, str] = {}
        self.auto = ahocorasick.Automaton()
        for run, ids in runs([(i, list(t)) for i, t in items]).items():
            self.auto.add_word("".join(map(self._code, run)), tuple(ids))
        self.other = "\x00" * CODE
        if len(self.auto):
            self.auto.make_automaton()

    def _code(self, word: str) -> str:
        got = self.codes.get(word)
        if got is None:
            n = len(self.codes) + 1
            if n >= SIGNS**CODE:
                raise ValueError("more different words than codes")
            got = self.codes[word] = "".join(chr(n // SIGNS**k % SIGNS) for k in range(CODE))
        return got

    def matches(self, ws: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(number of the first word, items) of every run found in a list of words."""
        get, other = self.codes.get, self.other
        for end, ids in self.auto.iter("".join([get(w, other) for w in ws])):
            if end % CODE == CODE - 1:  # else it lies across the codes
                yield end // CODE - WORDS + 1, ids


@lru_cache(maxsize=2)
def searcher(items: tuple[tuple[int, tuple[str | None, ...]], ...]) -> Searcher | None:
    """Built once per Python worker; null if no item is long enough."""
    made = Searcher(items)
    return made if len(made.auto) else None


class Tracked:
    """A text under change, with the first and last original place of every character."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first = list(range(len(text)))
        self.last = list(range(len(text)))

    def sub(self, rx: re.Pattern[str], by: Callable[[str], str]) -> None:
        parts: list[str] = []
        first: list[int] = []
        last: list[int] = []
        at = 0
        for m in rx.finditer(self.text):
            a, z = m.span()
            new = by(m.group())
            parts += (self.text[at:a], new)
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[z - 1]] * len(new)
            at = z
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.first = first + self.first[at:]
            self.last = last + self.last[at:]


# Characters that may combine with the ones before them never start a cluster; plain ASCII never combines backwards.
_CLUSTER = re.compile(r"[^\x00-\x7f][^\x00-\x7f]*|[\x00-\x7f][^\x00-\x7f]+")


def _cluster_by(text: str) -> re.Pattern[str]:
    """How to normalise a text piece by piece with the result of normalising it whole: by characters and what combines
    with them, or where that differs (jamo and the like) by whole runs that are not ASCII."""
    fine = re.compile(rf".[{_COMBINING}]+|[^\x00-\x7f]", re.DOTALL)
    return fine if fine.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text) == unicodedata.normalize("NFKC", text) else _CLUSTER


_COMBINING = "".join(re.escape(chr(c)) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)))


def tracked(text: str, joined: bool = False) -> Tracked:
    """``folded`` step by step with places kept; ``joined`` undoes hyphens at line ends first."""
    t = Tracked(text)
    nothing, space = lambda _: "", lambda _: " "
    if joined:
        t.sub(_BREAK_HYPHEN, nothing)
    t.sub(_ENTITY, html.unescape)
    t.sub(_INVISIBLE, nothing)
    if "<" in t.text:
        t.sub(_TAG_BREAK, space)
        t.sub(_TAG, nothing)
    if "](" in t.text:
        t.sub(_LINK, space)
    t.sub(_EMPHASIS, nothing)
    if not t.text.isascii():
        t.sub(_cluster_by(t.text), lambda c: unicodedata.normalize("NFKC", c))
        t.sub(_MARK, nothing)
    t.sub(_CASED, str.casefold)
    return t


_CASED = re.compile(r"[^a-z\W\d_]")


def leaks(text: str | None, find: Searcher | None, with_places: bool = True) -> dict[int, set[tuple[int, int]]]:
    """The items a text leaks, with the original places (first and last character, from 0) of their runs; without
    ``with_places`` the runs' words only."""
    if find is None or not text:
        return {}
    found: dict[int, set[tuple[int, int]]] = {}
    for joined in (False, True) if _BREAK_HYPHEN.search(text) else (False,):
        got = list(find.matches(words(_BREAK_HYPHEN.sub("", text) if joined else text)))
        if got and with_places:
            t = tracked(text, joined)
            at = [(t.first[m.start()], t.last[m.end() - 1]) for m in _WORD.finditer(t.text)]
            for first, ids in got:
                for item in ids:
                    found.setdefault(item, set()).add((at[first][0], at[first + WORDS - 1][1]))
        else:
            for first, ids in got:
                for item in ids:
                    found.setdefault(item, set()).add((first, first))
    return found


SPANS = "doc_id bigint, item_id bigint, start_pos int, end_pos int, n_runs int"


def find_leaks(docs: DataFrame, items: DataFrame, with_places: bool = True) -> DataFrame:
    """``doc_id, item_id, start_pos, end_pos, n_runs``: each leaked item of a document, where its first matching run
    starts and its last one ends, and how many runs match."""
    spark = docs.sparkSession
    rows = items.select("item_id", F.array_union(F.array("question"), F.coalesce("expected_keypoints", F.array().cast("array<string>"))).alias("t")).where("item_id is not null")
    parts = []
    n = rows.agg(F.sum(F.length(F.concat_ws(" ", "t")))).first()[0] or 0
    blocks = max(1, -(-n // MAX_CHARS))
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        got = tuple(sorted((r["item_id"], tuple(r["t"])) for r in mine.collect()))
        parts.append(_scan(docs, spark.sparkContext.broadcast(got), with_places))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scan(docs: DataFrame, block, with_places: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = searcher(block.value)
        for batch in batches:
            out: list[tuple[int, int, int | None, int | None, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for item, spans in sorted(leaks(text.as_py(), find, with_places).items()):
                    start, end = (min(a for a, _ in spans) + 1, max(z for _, z in spans) + 1) if with_places else (None, None)
                    out.append((doc, item, start, end, len(spans)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start_pos", "end_pos", "n_runs"])

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(scan, SPANS)
