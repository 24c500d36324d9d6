"""Retrieval chunks of articles and tickets.

Defined results: null and blank texts have no chunks; repeated rows are chunked independently.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import redaction
from tarn.functions import text as X

# Chunk sizes in words.
ARTICLE_WORDS, TICKET_WORDS = 500, 350
# Single words that never become redaction terms.
STOPWORDS = """the and our for this that update of to support team please thanks thank you with from is are was were in on at it we i a an be as or but not your my
customer client user hi hello dear regards cheers now me let get sent received could would should also however therefore moreover additionally furthermore regarding""".split()
# Where names stand in mails.
NAME_PATTERNS = (
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\s*<[\w.+-]+@[\w.-]+>",
    r"(?:(?i:received from|sent to))\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})",
    r"\b(?i:Hi|Hello|Dear|Thanks|Thank you|Regards|Cheers|Best|Kind regards|Hey)\b[,\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})",
    r"\b(?i:cc):\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\s*[<,]",
)


def split_article(body: str | None, target: int = ARTICLE_WORDS) -> list[str]:
    """Sections at headings of level 1 to 3; a section over the target is packed from paragraphs, each piece under the
    section's heading.  Fenced code is never split and counts as one word."""
    if not body or not body.strip():
        return []
    fences: list[str] = []

    def hide(m: re.Match[str]) -> str:
        fences.append(m.group())
        return f"\x00{len(fences) - 1}\x00"

    masked = re.sub(r"^```.*?^```[^\n]*$", hide, body, flags=re.MULTILINE | re.DOTALL)
    show = lambda s: re.sub(r"\x00(\d+)\x00", lambda m: fences[int(m[1])], s)
    out: list[str] = []
    for section in re.split(r"^(?=#{1,3} )", masked, flags=re.MULTILINE):
        if not section.strip():
            continue
        if len(section.split()) <= target:
            out.append(show(section.strip()))
            continue
        head, rest = ("", section)
        if section.startswith("#"):
            head, _, rest = section.partition("\n")
        pieces, size = [[]], 0
        for p in (p for p in re.split(r"\n\s*\n", rest) if p.strip()):
            n = len(p.split())
            if pieces[-1] and size + n > target:
                pieces.append([])
                size = 0
            pieces[-1].append(p.strip())
            size += n
        out += [show("\n\n".join([head.strip(), *ps] if head else ps)) for ps in pieces if ps]
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def article_parts(bodies: pa.Array) -> pa.Array:
    return pa.array([split_article(b) for b in bodies.to_pylist()], pa.list_(pa.string()))


def article_chunks(articles: DataFrame) -> DataFrame:
    """``art_no, chunk_index, chunk_id, text, ...`` of articles; each chunk leads with product, category and title."""
    space = F.coalesce(F.nullif(F.col("space_key"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.col("title"))
    crumb = F.concat_ws(" · ", F.coalesce("product_label", "product", F.lit("")), F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")), F.coalesce("title", F.lit("")))
    parts = articles.select("*", F.posexplode(article_parts(F.col("body_md"))).alias("chunk_index", "part"))
    return parts.select(
        "art_no",
        "chunk_index",
        X.stable_id("art_", space, F.col("title"), F.col("chunk_index")).alias("chunk_id"),
        "product",
        "category",
        "title",
        "space_key",
        "url",
        F.concat(crumb, F.lit("\n\n"), F.col("part")).alias("text"),
    )


def word_windows(text: Column, size: int = TICKET_WORDS) -> Column:
    """Windows of ``size`` words; a text that fits keeps its own white space."""
    none = F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))
        return F.when(F.size(w) == 0, none).when(F.size(w) <= size, F.array(F.regexp_replace(text, r"^\s+|\s+$", ""))).otherwise(many)

    return X.let(X.words(text), cut)


def is_staff(c: Column) -> Column:
    return F.coalesce(c["internal"], F.lit(False))


def distinct_ci(values: Column) -> Column:
    """Trimmed, non-blank values in order, the first of those that differ in case only."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    pairs = F.transform(clean, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))
    return X.let(pairs, lambda ps: X.let(ps["k"], lambda ks: F.transform(F.filter(ps, lambda p, i: F.array_position(ks, p["k"]) == i + 1), lambda p: p["v"])))


def known_terms(comments: Column, resolution: Column, *fields: Column) -> Column:
    """Names to redact: the given fields and what stands where names stand in the thread, whole and by word."""
    bodies = F.concat(F.coalesce(F.transform(comments, lambda c: c["body"]), F.array().cast("array<string>")), F.array(resolution["text"]), F.coalesce(F.transform(resolution["comments"], lambda c: c["body"]), F.array().cast("array<string>")))
    full = F.filter(bodies, lambda b: b.isNotNull())
    names = F.flatten(F.transform(full, lambda b: F.concat(*(F.regexp_extract_all(b, F.lit(p), F.lit(1)) for p in NAME_PATTERNS))))
    both = F.flatten(F.transform(names, lambda n: F.concat(F.array(n), F.split(n, r"\s+"))))
    stop = F.array(*(F.lit(s) for s in STOPWORDS))
    every = distinct_ci(F.concat(F.array(*fields), both))
    return F.filter(every, lambda t: ~F.forall(F.split(F.lower(t), " "), lambda w: F.array_contains(stop, w)))


def resolution_text(comments: Column, resolution: Column, terms: Column) -> Column:
    """The redacted resolution: its text, its thread, then the staff comments."""
    none = F.array().cast("array<string>")
    raw = F.concat(F.array(resolution["text"]), F.coalesce(F.transform(resolution["comments"], lambda c: c["body"]), none), F.coalesce(F.transform(F.filter(comments, is_staff), lambda c: c["body"]), none))
    red = F.transform(F.filter(raw, lambda x: x.isNotNull()), lambda x: redaction.redact(x, terms))
    return F.trim(F.array_join(F.filter(red, lambda x: x != ""), "\n"))


def problem_text(comments: Column, title: Column, terms: Column) -> Column:
    """The first customer comment with anything left after redaction, else the redacted title."""
    mine = F.transform(F.filter(comments, lambda c: ~is_staff(c)), lambda c: redaction.redact(c["body"], terms))
    return F.coalesce(F.get(F.filter(mine, lambda x: x != ""), F.lit(0)), redaction.redact(title, terms))


def handled_by(comments: Column, resolution: Column, created_by: Column) -> Column:
    none = F.array().cast("array<string>")
    names = distinct_ci(F.concat(F.coalesce(F.transform(F.filter(comments, is_staff), lambda c: c["author"]), none), F.coalesce(F.transform(resolution["comments"], lambda c: c["author"]), none)))
    return F.filter(names, lambda n: F.lower(n) != F.lower(F.trim(F.coalesce(created_by, F.lit("")))))


def staff_block(organization: Column, owner: Column, assignee: Column, handled: Column) -> Column:
    """The header lines of a ticket: client, then staff."""
    has = lambda c: F.nullif(F.trim(c), F.lit(""))
    people = F.concat_ws(" · ", F.concat(F.lit("CSQA owner: "), has(owner)), F.concat(F.lit("Assignee: "), has(assignee)), F.when(F.size(handled) > 0, F.concat(F.lit("Handled by: "), F.array_join(handled, ", "))))
    return F.concat_ws("\n", F.concat(F.lit("Client: "), has(organization)), F.nullif(people, F.lit("")))


def ticket_chunks(tickets: DataFrame) -> DataFrame:
    """``rec_id, ticket_id, chunk_index, chunk_id, resolved, text``: windows of problem and resolution under the title line."""
    base = tickets.withColumn("_terms", known_terms(F.col("comments"), F.col("resolution"), F.col("created_by"), F.col("assignee")))
    base = base.withColumn("_res", resolution_text(F.col("comments"), F.col("resolution"), F.col("_terms"))).withColumn("_prob", problem_text(F.col("comments"), F.col("title"), F.col("_terms")))
    base = base.where((F.col("_res") != "") | (F.col("_prob") != ""))
    resolved = F.col("_res") != ""
    tid = F.coalesce("ticket_id", F.lit(""))
    raw_title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Ticket "), tid))
    body = F.concat(F.lit("Problem: "), F.col("_prob"), F.lit("\n\nResolution: "), F.when(resolved, F.col("_res")).otherwise("(no recorded resolution yet — unresolved)"))
    head = F.concat(F.lit("Ticket #"), tid, F.lit(" — "), F.coalesce(F.nullif(redaction.redact(raw_title, F.col("_terms")), F.lit("")), F.concat(F.lit("Ticket "), tid)), F.when(resolved, "").otherwise(" [UNRESOLVED]"))
    staff = staff_block(F.col("organization"), F.col("csqa_owner"), F.col("assignee"), handled_by(F.col("comments"), F.col("resolution"), F.col("created_by")))
    day = X.iso_date(F.col("created_at"))
    rows = base.select("rec_id", "ticket_id", raw_title.alias("_raw"), head.alias("_head"), staff.alias("_staff"), day.alias("_day"), resolved.alias("resolved"), F.posexplode(word_windows(body)).alias("chunk_index", "_seg"))
    first = F.concat(F.when(F.col("_day") != "", F.concat(F.lit("\nDate: "), F.col("_day"))).otherwise(""), F.when(F.col("_staff") != "", F.concat(F.lit("\n"), F.col("_staff"))).otherwise(""))
    return rows.select(
        "rec_id", "ticket_id", "chunk_index", X.stable_id("ticket_", F.col("ticket_id"), F.col("_raw"), F.col("chunk_index"), sep=":").alias("chunk_id"), "resolved",
        F.concat(F.col("_head"), F.when(F.col("chunk_index") == 0, first).otherwise(""), F.lit("\n\n"), F.col("_seg")).alias("text"),
    )
