"""Scalar text functions as JVM column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
TOKEN = r"[a-z0-9#]+"
ERROR_WORDS = r"(?i)\b(error|errors|issue|issues|fail(?:s|ed|ing|ure)?|null|exception|crash(?:e[ds])?|bug|broken|wrong|incorrect|discrepan\w*|duplicat\w*|missing|not working|doesn'?t|cannot|can'?t|unable)\b"
INCIDENT_WORDS = r"(?i)\bincidents?\b"
HOWTO_WORDS = r"(?i)\b(how (?:do|to|can|would)|steps?|guide|walk ?through|set ?up|configure|create|add|enable|book|post)\b"
CONFIG_WORDS = r"(?i)\b(config\w*|settings?|install\w*|permission|enable|disable|toggle)\b"
TICKET_REF = r"(?i)(?:ticket|tickets|bug|incident|#)\s*#?\s*(\d{3,7})"
FOLLOW_UP_WORDS = r"(?i)\b(this|that|these|those|it|its|they|them|their|same|above|prior|previous|who|owner|owned|handle[ds]?|handling|work(?:s|ed|ing)?|assigned|assignee|client|escalat\w*|contact|resource|sign[\s-]?off)\b"
CITATION = r"\[([^\]]+)\]\((https?://(?:[^()\s]|\([^()\s]*\))+)\)"
VERSION = r"\d+\.\d+(?:\.\d+)+"
FOLLOW_UP_LIMIT = 5
SHORT_LIMIT = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, where lambdas would compute it for every element."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Search tokens: runs of a-z, 0-9 and # in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; none for null and blank."""
    t = collapse(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def normalise_query(text: Column, synonyms: list[tuple[str, str]]) -> Column:
    """Lower case, signs but # and _ as blanks, synonyms folded from the longest down."""
    q = collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s#]", " "))
    for name, to in sorted(synonyms, key=lambda s: (-len(s[0]), s[0])):
        if name != to:
            q = F.regexp_replace(q, rf"\b{name}\b", to)
    return collapse(q)


def is_error(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ERROR_WORDS)


def issue_type(text: Column) -> Column:
    """incident, error, how_to, config or general, in this precedence."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(INCIDENT_WORDS), "incident").when(t.rlike(ERROR_WORDS), "error").when(t.rlike(HOWTO_WORDS), "how_to").when(t.rlike(CONFIG_WORDS), "config").otherwise("general")


def ticket_refs(text: Column) -> Column:
    """Distinct ticket numbers that follow a reference word, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TICKET_REF), F.lit(1)))


def mentions(text: Column, names: list[tuple[str, str]]) -> Column:
    """Distinct targets of the names that occur as whole words, in the order of ``names``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.filter(F.array(*(F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){n}(?![\p{{L}}\p{{N}}_])"), F.lit(to)) for n, to in names)), lambda x: x.isNotNull()))


def slug(text: Column, empty: str = "untitled", limit: int = 120) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", empty).otherwise(F.substring(s, 1, limit))


def safe_name(text: Column) -> Column:
    return F.trim(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-")))


def version(text: Column) -> Column:
    """The first version with at least two dots; empty if none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), VERSION, 0)


def version_key(v: Column) -> Column:
    """Sorts versions by their numbers, others after them when descending."""
    parts = F.split(F.replace(v, F.lit("-"), F.lit(".")), r"\.")
    numeric = F.forall(parts, lambda p: p.rlike(r"^\d+$"))
    return F.when(numeric, F.transform(parts, lambda p: p.cast("int"))).otherwise(F.array(F.lit(-1)))


def iso_date(raw: Column) -> Column:
    """The date of a ticket stamp: three formats, else a leading ISO date, else empty."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    tried = [F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd h:mm a", "yyyy-MM-dd H:mm", "yyyy-MM-dd")]
    day = reduce(lambda a, b: F.coalesce(a, b), tried)
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}", 0))


def stable_id(prefix: str, *parts: Column, sep: str = "|") -> Column:
    """prefix + the first 16 digits of the SHA-1 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16))


def path_category(path: Column) -> Column:
    """The second of at least three segments of a path, else empty."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, parts[1]).otherwise("")


def absolute_url(src: Column, base: str) -> Column:
    """Plain concatenation for everything that is not http already."""
    return F.when(src.startswith("http"), src).otherwise(F.concat(F.lit(base), src))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def id_ranges(spec: Column) -> Column:
    """The ids of a list such as ``7-9, 12``: ranges in either direction, distinct, in order of first mention."""
    parts = F.regexp_extract_all(F.regexp_replace(spec, "–", "-"), F.lit(r"(?<![\d-])(\d+(?:-\d+)?)(?![\d-])"), F.lit(1))
    pairs = F.transform(parts, lambda p: F.split(p, "-"))

    def expand(p: Column) -> Column:
        a, b = p[0].cast("bigint"), F.when(F.size(p) > 1, F.get(p, F.lit(1)).cast("bigint")).otherwise(p[0].cast("bigint"))
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_distinct(F.flatten(F.transform(pairs, expand)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


# File endings by media type.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp"}


def extension(mime: Column) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))))[mime], F.lit("bin"))


def data_uri(src: Column) -> Column:
    """(mime, payload) of a base64 data URI; nulls for other sources."""
    hit = src.rlike(r"^data:[^;,]+;base64,")
    return F.struct(F.when(hit, F.regexp_extract(src, r"^data:([^;,]+);base64,", 1)).alias("mime"), F.when(hit, F.regexp_extract(src, r"(?s)^data:[^;,]+;base64,(.*)$", 1)).alias("payload"))
