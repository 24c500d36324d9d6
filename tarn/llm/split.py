"""Cutting oversized texts at natural boundaries.

Recursive bisection: a stretch longer than the limit less the overlap is cut at the strongest boundary near its
midpoint (heading, paragraph, line, sentence, clause, word), and its halves likewise.  Near is a quarter of the stretch
to either side, and where no boundary lies there, twice as far and so on; only a stretch without any boundary is cut
between characters.  Afterwards each piece but the first is given exactly the last ``overlap`` characters of what comes
before it, as the limits state a length; so an overlap may begin within a word.  Pieces record where their own text (the
core) starts, so the cores in order are the text again.

Defined results: null texts have no pieces; a text within the limit, the empty one too, is one piece; a text
without any boundary is cut between characters, but never within a line break or before a combining mark;
repeated rows are cut independently.  An overlap must be below the limit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.tables import bounded_rows, spread

# Boundaries, strongest first: each match ends where a piece may start.
_STRENGTHS = [
    (6, re.compile(r"\n(?=#{1,6} )")),
    (5, re.compile(r"\n[ \t]*\r?\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…][\"'”’)\]*_]*\s+|[。！？]\s*")),
    (2, re.compile(r"[,;:、，；：]\s*|\s[–—-]\s")),
    (1, re.compile(r"\s+")),
]
_FENCE = re.compile(r"^(?:```|~~~).*?(?:^(?:```|~~~)[ \t]*$|\Z)", re.MULTILINE | re.DOTALL)


def boundaries(text: str) -> dict[int, int]:
    """Places a piece may start at, with their strength; within fenced code only line ends and less."""
    found: dict[int, int] = {}
    for strength, rx in reversed(_STRENGTHS):
        for m in rx.finditer(text):
            found[m.end()] = strength
    for m in _FENCE.finditer(text):
        for i in range(m.start() + 1, m.end()):
            if found.get(i, 0) > 4:
                found[i] = 3
            elif found.get(i, 0) > 1:
                found[i] = 2 if text[i - 1] == "\n" else 1
    found.pop(0, None)
    found.pop(len(text), None)
    return found


def _whole(text: str, i: int) -> bool:
    return not (text[i - 1] == "\r" and text[i] == "\n") and not unicodedata.combining(text[i]) and text[i] not in "‍️" and text[i - 1] != "‍"


def cores(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces' own stretches: [start, end) in order, without gaps."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    room = limit - overlap
    marks = boundaries(text)
    places = sorted(p for p in marks if _whole(text, p))
    out: list[tuple[int, int]] = []
    stack = [(0, len(text))]
    while stack:
        a, z = stack.pop()
        if z - a <= room:
            out.append((a, z))
            continue
        mid, reach = (a + z) // 2, max(1, (z - a) // 4)
        while True:  # wider and wider until there is a boundary
            near = places[bisect_left(places, max(a + 1, mid - reach)) : bisect_right(places, min(z - 1, mid + reach))]
            if near or reach >= z - mid:
                break
            reach *= 2
        if near:
            at = max(near, key=lambda p: (marks[p], -abs(p - mid), -p))
        else:
            at = next((p for p in range(mid, z) if _whole(text, p)), mid)
        stack += [(at, z), (a, at)]
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core start, end) of each piece, from 0; a piece's text is text[start:end]."""
    return [(max(0, a - overlap) if k else 0, a, z) for k, (a, z) in enumerate(cores(text, limit, overlap))]


PIECES = "field string, row_id bigint, piece_no int, n_pieces int, start_pos int, core_pos int, end_pos int, text string"


def split_texts(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """``texts`` (field, row_id, text) cut to the limits (field, max_chars, overlap_chars).

    Texts of fields without a limit stay whole.  Texts within their limit never leave the JVM.  Positions are code
    points from 1; ``end_pos`` is the last character.  The limits, one row per field, are checked to be few.
    """
    rows = bounded_rows(limits.where("field is not null and max_chars is not null"), 1000, "split limits")
    by = {r["field"]: (r["max_chars"], r["overlap_chars"] or 0) for r in rows}
    if not by:
        by = {"": (1, 0)}
    cap = F.create_map(*(x for f, (m, _) in by.items() for x in (F.lit(f), F.lit(m))))[F.col("field")]
    base = texts.where("text is not null").select("field", F.col("row_id").cast("bigint").alias("row_id"), "text", (F.length("text") > cap).alias("over"))
    fits = base.where(~F.coalesce("over", F.lit(False))).select(
        "field", "row_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(1).alias("start_pos"), F.lit(1).alias("core_pos"), F.length("text").alias("end_pos"), "text"
    )
    return fits.unionByName(cut_oversized(base.where("over").select("field", "row_id", "text"), by))


def cut_oversized(over: DataFrame, by: dict[str, tuple[int, int]]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string())
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # small output batches, whatever the texts' sizes
                part = batch.slice(lo, 256)
                out = []
                for field, row, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    got = pieces(text, *by[field])
                    out += [(field, row, k + 1, len(got), s + 1, c + 1, e, text[s:e]) for k, (s, c, e) in enumerate(got)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return spread(over).mapInArrow(cut, PIECES)
