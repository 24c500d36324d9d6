"""From ranked hits to an answer: context assembly, the ladder of decisions, messages and payloads, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import CITATION
from tarn.operators.products import DISPLAY, display, looked_up
from tarn.operators.retrieval import CONFIDENCE_FLOOR, assemble, first_per

# Scores under which a question is out of scope, or an answer gets a footer, and the longest attached text.
OUT_OF_SCOPE, LOW_CONFIDENCE = 0.02, 0.35
ATTACHED_CHARS = 20_000
RELATED = 2
SEED_CHARS, SEED_K = 200, 12


def expand_tickets(context: DataFrame, chunks: DataFrame) -> DataFrame:
    """``context`` (query_id, doc_id, rank, ticket_id, text) with each ticket's fragments replaced by the whole ticket, once,
    where its first fragment stood; only the tickets in the context are assembled."""
    wanted = context.where("ticket_id is not null").select("ticket_id").distinct()
    whole = assemble(chunks.join(wanted, "ticket_id", "left_semi"), "ticket_id", "chunk_index", "text").select("ticket_id", F.col("text").alias("_whole"))
    tickets = first_per(context.where("ticket_id is not null"), ["query_id", "ticket_id"], [F.col("rank"), F.col("doc_id")])
    return context.where("ticket_id is null").unionByName(tickets).join(whole, "ticket_id", "left").withColumn("text", F.coalesce("_whole", "text")).drop("_whole")


def ensure_kind(context: DataFrame, quick: DataFrame, kind: str, usable: Column | None = None) -> DataFrame:
    """Adds the best quick hit of a kind to the contexts that have none of it."""
    have = context.where(F.col("kind") == kind).select("query_id").distinct()
    fit = quick.where((F.col("kind") == kind) & (F.lit(True) if usable is None else usable))
    best = first_per(fit, ["query_id"], [F.col("rank"), F.col("doc_id")]).join(have, "query_id", "left_anti").join(context.select("query_id").distinct(), "query_id", "left_semi")
    last = context.groupBy("query_id").agg(F.max("rank").alias("_last"))
    return context.unionByName(best.join(last, "query_id").withColumn("rank", F.col("_last") + 1).select(*context.columns))


def ticket_seeds(context: DataFrame) -> DataFrame:
    """``query_id, query``: title and first characters of the first ticket of each context; contexts without a ticket have none."""
    first = first_per(context.where("kind = 'ticket'"), ["query_id"], [F.col("rank"), F.col("doc_id")])
    return first.select("query_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, SEED_CHARS)).alias("query"))


def related_tickets(context: DataFrame, quick: DataFrame) -> DataFrame:
    """The two newest other tickets among the hits of a context's seed: ``query_id, ticket_id, created_at, place``."""
    present = context.where("ticket_id is not null").select("query_id", "ticket_id").distinct()
    others = quick.where("ticket_id is not null").join(present, ["query_id", "ticket_id"], "left_anti")
    once = first_per(others, ["query_id", "ticket_id"], [F.col("rank"), F.col("doc_id")])
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "rank", "doc_id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= RELATED).select("query_id", "ticket_id", "created_at", "place")


def linked(label: Column, url: Column) -> Column:
    """``[label](url)``, or ``[label]`` without a url."""
    return F.concat(F.lit("["), label, F.when(url != "", F.concat(F.lit("]("), url, F.lit(")"))).otherwise("]"))


def cite() -> Column:
    """How an entry is cited: a ticket by number and product, an article by product, category and title."""
    text = lambda c: F.coalesce(c, F.lit(""))
    product = display(F.col("product"))
    dot = F.lit(" · ")
    label = F.when(F.col("kind") == "ticket", F.concat(F.lit("Ticket #"), text("ticket_id"), dot, product)).otherwise(F.concat(product, dot, F.coalesce(F.nullif("category", F.lit("")), F.lit("general")), dot, text("title")))
    return linked(label, text("url"))


NO_CONTEXT = "CONTEXT (the only facts you may use):\n\n(no relevant articles found)\n"


def context_text(context: DataFrame) -> DataFrame:
    """The numbered context of each question; questions without hits get :data:`NO_CONTEXT` from the caller's outer join."""
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    rows = context.withColumn("_n", F.row_number().over(w))
    entry = F.concat(F.col("_n").cast("string"), F.lit(". "), cite(), F.lit("\n   "), F.coalesce("text", F.lit("")), F.lit("\n"))
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), entry.alias("e")))).alias("p"))
    return got.select("query_id", F.size("p").alias("n_entries"), F.concat(F.lit(NO_CONTEXT.split("(no")[0]), F.array_join(F.transform("p", lambda x: x["e"]), "\n")).alias("context"))


def suggestions(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Cited titles per question, each title once, only such with a url; at most k if given (a feature's limit)."""
    once = first_per(hits.where("coalesce(url, '') <> ''").withColumn("title", F.coalesce("title", F.lit(""))), ["query_id", "title"], [F.col("rank"), F.col("doc_id")])
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    top = once.withColumn("_n", F.row_number().over(w)).where(F.lit(True) if k is None else F.col("_n") <= k)
    shown = F.coalesce(looked_up(F.col("product"), DISPLAY), F.lit(""))
    line = F.concat(F.lit("• "), linked(F.col("title"), F.col("url")), F.lit("  — "), shown, F.lit(" · "), F.coalesce("category", F.lit("")))
    got = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("c")))).alias("p"))
    return got.select("query_id", F.array_join(F.transform("p", lambda x: x["c"]), "\n").alias("suggestions"))


def validate_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``query_id, verified, unverified, all_verified, stripped_text``: the links of each answer (query_id, answer) whose address is
    among those retrieved for it (query_id, url), and the others, which the text loses to ``[unverified]``."""
    urls = retrieved.where("url is not null").groupBy("query_id").agg(F.collect_set("url").alias("_urls"))
    text = F.coalesce("answer", F.lit(""))
    links = F.arrays_zip(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)).alias("raw"), F.regexp_extract_all(text, F.lit(CITATION), F.lit(2)).alias("url"))
    rows = answers.join(urls, "query_id", "left").select("query_id", text.alias("_text"), F.coalesce("_urls", F.array().cast("array<string>")).alias("_urls"), links.alias("_links"))
    good = lambda x: F.array_contains(F.col("_urls"), x["url"])
    rows = rows.select("query_id", "_text", F.filter("_links", good).alias("verified"), F.filter("_links", lambda x: ~good(x)).alias("unverified"))
    stripped = F.aggregate("unverified", F.col("_text"), lambda a, x: F.replace(a, x["raw"], F.lit("[unverified]")))
    return rows.select("query_id", "verified", "unverified", (F.size("unverified") == 0).alias("all_verified"), stripped.alias("stripped_text"))


def decision(score: Column, clarify: Column, named: Column, short: Column, suggested: Column) -> Column:
    """What kind of turn answers a question.

    ``score``: best rerank score; ``clarify``: no product dominates; ``named``: a product is known; ``short``: under four
    words without a product; ``suggested``: there are suggestions."""
    answered = F.when(clarify & ~named, "clarification").otherwise("answer")
    ladder = F.when(score < OUT_OF_SCOPE, "out_of_scope").when(clarify & ~named, "clarification").when(short, "clarification").when(suggested, "suggestions").otherwise("abstain")
    return F.when(F.coalesce(score, F.lit(0.0)) >= CONFIDENCE_FLOOR, answered).otherwise(ladder)


def needs_footer(score: Column) -> Column:
    return (score >= CONFIDENCE_FLOOR) & (score < LOW_CONFIDENCE)


def messages(history: Column, question: Column, attached: Column) -> Column:
    """The history and the new user turn, with attached text cut at its longest, as role and content."""
    extra = F.when(F.trim(attached) != "", F.concat(F.lit("\n\n"), F.substring(attached, 1, ATTACHED_CHARS))).otherwise("")
    now = F.struct(F.lit("user").alias("role"), F.concat(F.coalesce(question, F.lit("")), extra).alias("content"))
    return F.concat(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(now))


def flat_content(blocks: Column) -> Column:
    """The text blocks of a multimodal message, joined by blanks."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " ")


def clean_rewrite(text: Column) -> Column:
    """The first line of a rewritten query without quotes; null if nothing is left."""
    line = F.trim(F.split(F.coalesce(text, F.lit("")), "\n")[0])
    return F.nullif(F.trim(F.regexp_replace(line, "^[\"'`“”]+|[\"'`“”]+$", "")), F.lit(""))


def event_lines(lines: DataFrame, run: str, seq: str, line: str) -> DataFrame:
    """Per run of a command-line model: its last message and its tokens (output with reasoning); other lines are skipped."""
    schema = "struct<type:string,message:string,usage:struct<input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint>,error:struct<message:string>>"
    rows = lines.select(run, seq, F.from_json(line, schema).alias("e")).where("e.type is not null")
    said = F.col("e.message").isNotNull()
    return rows.groupBy(run).agg(
        F.max_by("e.message", F.when(said, F.col(seq))).alias("content"),
        F.coalesce(F.sum("e.usage.input_tokens"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.coalesce("e.usage.output_tokens", F.lit(0)) + F.coalesce("e.usage.reasoning_tokens", F.lit(0))), F.lit(0)).alias("tokens_out"),
        F.max("e.error.message").alias("error"),
    )


def tail_labels(prompt: Column, target: Column, limit: int) -> Column:
    """The last ``limit`` tokens of prompt and target, with labels of -100 on the prompt."""
    ids = F.concat(prompt, target)
    labels = F.concat(F.transform(prompt, lambda _: F.lit(-100)), target)
    cut = lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - limit + 1), limit)
    return F.struct(cut(ids).alias("ids"), cut(labels).alias("labels"))


def admitted(files: DataFrame, owner: str, order: str, most: int, endings: list[str], image_bytes: int = 4 << 20, text_bytes: int = 1 << 20) -> DataFrame:
    """Attachments that may ride along: known endings, within their size, the first ``most`` of each owner (a feature's limit)."""
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    cap = F.when(ending.isin("png", "jpg", "jpeg", "gif", "webp"), image_bytes).otherwise(text_bytes)
    ok = files.where(ending.isin(*endings) & (F.col("bytes") <= cap))
    return ok.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(order, "name"))).where(F.col("_n") <= most).drop("_n")


def hours_minutes(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    return F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))


def undistilled(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Questions no training record has yet: records hold messages, and the last user message is the question."""
    done = records.select(F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"].alias("question")).where("question is not null").distinct()
    return questions.join(done, "question", "left_anti")
