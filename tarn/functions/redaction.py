"""Rule-based redaction of ticket text as JVM column expressions: line by line, each rule over the last one's result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import CITATION, let

# The patterns of each rule, in the order they apply.
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
CRED_PAIR = r"(?i)\b(pass(?:word)?|pwd|secret|token|api[_-]?key|access[_-]?key|user(?:name)?|login)(=)([^\s&]+)"
CRED_LABEL = (
    r"(?i)\b(pass(?:word|phrase)?|pwd|user\s?name|username|login|api[\s_-]?key|secret(?:\s*key)?|access[\s_-]?key|private[\s_-]?key|decrypt\s*key|auth[\s_-]?token|token|credentials?|"
    r"client[\s_-]?id|customer[\s_-]?id|gateway(?:\s*customer)?(?:\s*id)?|sk|client[\s_-]?secret|bearer)\b([\"']?\s*(?:for[^:=\n]*)?[:=]\s*)(?:([\"'])[^\"'\n]*\2|[^\n;,]+)"
)
JWT = r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
HEX = r"\b0x[0-9a-fA-F]{16,}\b"
# A run of token characters that, without = at its ends, is 32 or more of base64 or 20 or more with lower, upper and digit.
SECRET_RUN = (
    r"(?<![A-Za-z0-9+/=_\-])(?:=*[A-Za-z0-9+/]{32,}=*(?![A-Za-z0-9+/=_\-])"
    r"|(?==*[A-Za-z0-9+/_\-](?:[A-Za-z0-9+/=_\-]{18,})[A-Za-z0-9+/_\-]=*(?![A-Za-z0-9+/=_\-]))(?=[A-Za-z0-9+/=_\-]*[a-z])(?=[A-Za-z0-9+/=_\-]*[A-Z])(?=[A-Za-z0-9+/=_\-]*\d)[A-Za-z0-9+/=_\-]{20,})"
)
MENTION = r"(?U)@[A-Za-z][\w.\-]*"
BARE_DOMAIN = r"(?U)@[\w.\-]+\.\w{2,}"
URL = r"https?://\S+"
PHONE = r"(?<!\d)(?!(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}(?![\d\s().\-]*\d))\+?\d[\d\s().\-]{6,}\d"
GREETING = r"\b((?i:Hi|Hello|Dear|Thanks|Thank you|Regards|Cheers|Best|Kind regards|Hey))\b([,\s]+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})(?=[\s,.!?]|$)"
ACTION = r"\b((?i:messaged|message|asked|told|emailed|email|called|contacted|spoke to|spoke with|pinged|notified|informed|advised|reached out to))\s+(?:the\s+(?:user|customer|client)\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"
IN_BRACKETS = r"\(([A-Z][a-z]+)\)"
DROP_LINE = r"(?i)^\s*(subject:|to:|cc:|bcc:|from:|sent:|date:|attachment:|registered|authorised by|authorized by|privacy policy|important this email|confidential|view our|connect on linkedin|t:|e:|w:|tel:|phone:|mobile:|fax:)"
SIGN_OFF = r"^\s*(?i:regards|thanks|thank you|best|kind regards|cheers|sincerely|br|warm regards)\b"
NAME_ONLY = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}$"
LEAKS = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?<!\d)(?:\+?\d{1,2}[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?!\d)"),
    ("secret", r"\b(?:sk-[A-Za-z0-9\-]{16,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|gh[pousr]_[A-Za-z0-9]{20,})\b"),
    ("password", r"(?i)\bpassword\s*[:=]\s*(?!\[redacted\])\S+"),
)
GONE = "[redacted]"


def term_pattern(terms: Column) -> Column:
    """One pattern for all terms of two or more characters, as whole words in any case, in their order; null if none."""
    usable = F.filter(terms, lambda t: F.length(t) >= 2)
    return F.when(F.size(usable) > 0, F.concat(F.lit(r"(?i)\b(?:"), F.array_join(F.transform(usable, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"), F.lit(r")\b")))


def redact_line(line: Column, pattern: Column | None = None) -> Column:
    """One line through all rules, last what matches ``pattern``."""
    x = F.regexp_replace(line, EMAIL, r"[redacted]")
    x = F.regexp_replace(x, CRED_PAIR, r"$1$2[redacted]")
    x = F.regexp_replace(x, CRED_LABEL, r"$1$2[redacted]")
    for p in (JWT, HEX, SECRET_RUN):
        x = F.regexp_replace(x, p, GONE)
    x = F.regexp_replace(x, MENTION, "@[redacted]")
    x = F.regexp_replace(x, BARE_DOMAIN, GONE)
    x = F.regexp_replace(x, URL, "[link]")
    x = F.regexp_replace(x, PHONE, GONE)
    x = F.regexp_replace(x, GREETING, "$1$2[redacted]")
    x = F.regexp_replace(x, ACTION, "$1 [redacted]")
    x = F.regexp_replace(x, IN_BRACKETS, "([redacted])")
    return x if pattern is None else F.regexp_replace(x, pattern, F.lit(GONE))


def redact(text: Column, terms: Column | None = None) -> Column:
    """Text without personal details: header and boilerplate lines and the name under a sign-off go, the rest is redacted."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "\n")

    def keep(r: Column) -> Column:
        name = r["bare"].rlike(NAME_ONLY) & r["before"].rlike(SIGN_OFF)
        return ~r["bare"].rlike(DROP_LINE) & ~name

    def whole(ls: Column, pattern: Column | None) -> Column:
        rows = F.transform(ls, lambda x, i: F.struct(x.alias("line"), F.trim(x).alias("bare"), F.when(i > 0, F.trim(F.get(ls, i - 1))).otherwise("").alias("before")))
        kept = F.transform(F.filter(rows, keep), lambda r: redact_line(r["line"], pattern))
        full = F.filter(kept, lambda x: F.trim(x) != "")
        return F.trim(F.regexp_replace(F.array_join(full, "\n"), "[ \t]{2,}", " "))

    if terms is None:
        return let(lines, lambda ls: whole(ls, None))
    # A pattern that never matches stands for no terms, so that one expression serves all rows.
    return let(F.coalesce(term_pattern(terms), F.lit(r"(?!)")), lambda p: let(lines, lambda ls: whole(ls, p)))


def leaks(text: Column) -> Column:
    """The kinds of leaks a text has, in order."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in LEAKS)), lambda x: x.isNotNull())


def scrub(text: Column) -> Column:
    for _, p in LEAKS:
        text = F.regexp_replace(text, p, GONE)
    return text


def scrub_answer(text: Column) -> Column:
    """Like the inline rules without names, but citation links stay as they are."""
    t = F.coalesce(text, F.lit(""))
    links = F.regexp_extract_all(t, F.lit(CITATION), F.lit(0))
    parts = F.split(F.regexp_replace(t, CITATION, "\u0001"), "\u0001")

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, EMAIL, GONE)
        x = F.regexp_replace(x, CRED_PAIR, r"$1$2[redacted]")
        x = F.regexp_replace(x, CRED_LABEL, r"$1$2[redacted]")
        for p in (JWT, HEX, SECRET_RUN, PHONE):
            x = F.regexp_replace(x, p, GONE)
        return x

    return F.array_join(F.transform(F.arrays_zip(parts.alias("part"), links.alias("link")), lambda z: F.concat(clean(z["part"]), F.coalesce(z["link"], F.lit("")))), "")
