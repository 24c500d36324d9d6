"""Conversations as rows (conversation, turn, role, content): what a session would remember, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X

# History length in turns, and the scores between which a topic has drifted.
HISTORY = 6
DRIFT_FROM, DRIFT_TO = 0.85, 0.20


def history(turns: DataFrame, conv: str, turn: str, role: str = "role") -> DataFrame:
    """The last 2 x HISTORY turns, of which only users' and assistants' stay."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * HISTORY).where(F.col(role).isin("user", "assistant")).drop("_n")


def latest(turns: DataFrame, conv: str, turn: str, content: str, role: str = "role") -> DataFrame:
    """Per conversation the newest question, and the newest turn of any role."""
    at = F.struct(F.col(turn))
    return turns.groupBy(conv).agg(F.max_by(F.when(F.col(role) == "user", F.col(content)), F.when(F.col(role) == "user", at)).alias("last_question"), F.max_by(F.col(role), at).alias("last_role"))


def drift(turns: DataFrame, conv: str, order: list[str], score: str) -> DataFrame:
    w = Window.partitionBy(conv).orderBy(*order)
    prev = F.lag(score).over(w)
    return turns.withColumn("drift", F.coalesce((prev >= DRIFT_FROM) & (F.col(score) < DRIFT_TO), F.lit(False)))


def recent_mention(turns: DataFrame, conv: str, order: list[str], flag: Column) -> DataFrame:
    """Whether any of the last six turns, this one included, has the flag."""
    w = Window.partitionBy(conv).orderBy(*order).rowsBetween(-5, 0)
    return turns.withColumn("recent", F.max(flag.cast("int")).over(w) == 1)


def fused_query(turns: DataFrame, conv: str, order: list[str], content: str, clarifies: Column, role: str = "role") -> DataFrame:
    """The users' turns with what they are searched with: a reply under five words, or one after a clarification by the last
    assistant, together with the last question of the user before it. ``clarifies`` says which assistant turns ask back."""
    w = Window.partitionBy(conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce(content, F.lit(""))
    prev = F.last(F.when(F.col(role) == "user", text), ignorenulls=True).over(w)
    asked = F.coalesce(F.last(F.when(F.col(role) == "assistant", F.coalesce(clarifies, F.lit(False))), ignorenulls=True).over(w), F.lit(False))
    short = F.size(X.words(F.col(content))) < X.FOLLOW_UP_LIMIT
    rows = turns.withColumn("search_query", F.when((F.coalesce(prev, F.lit("")) != "") & (asked | short), F.concat(prev, F.lit(" "), text)).otherwise(text))
    return rows.where(F.col(role) == "user")


def refers_back(text: Column) -> Column:
    """Whether a message is a follow-up: under five words or with a word that points back."""
    t = F.coalesce(text, F.lit(""))
    return (F.size(X.words(t)) < X.FOLLOW_UP_LIMIT) | t.rlike(X.FOLLOW_UP_WORDS)


def titles(turns: DataFrame, conv: str, turn: str, content: str, role: str = "role", width: int = 60) -> DataFrame:
    """A title per conversation: the first ticket any question refers to, else the first question, shortened, else ``New chat``."""
    mine = F.col(role) == "user"
    ref = F.get(X.ticket_refs(F.col(content)), F.lit(0))
    text = X.collapse(F.col(content))
    g = turns.groupBy(conv).agg(F.min_by(ref, F.when(mine & ref.isNotNull(), F.col(turn))).alias("_ref"), F.min_by(text, F.when(mine & (text != ""), F.col(turn))).alias("_first"))
    short = F.when(F.length("_first") > width, F.concat(F.rtrim(F.substring("_first", 1, width - 1)), F.lit("…"))).otherwise(F.col("_first"))
    return g.select(conv, F.when(F.col("_ref").isNotNull(), F.concat(F.lit("Ticket #"), F.col("_ref"))).otherwise(F.coalesce(short, F.lit("New chat"))).alias("title"))


def search(turns: DataFrame, conv: str, turn: str, content: str, needle: str) -> DataFrame:
    """Conversations with the needle in their title or any turn, in any case."""
    has = lambda c: F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    named = titles(turns, conv, turn, content).where(has(F.col("title"))).select(conv)
    return turns.where(has(F.col(content))).select(conv).union(named).distinct()


def cache_key(norm: Column, product: Column, model: Column, version: str) -> Column:
    return F.sha1(F.concat_ws("|", F.coalesce(norm, F.lit("")), F.coalesce(product, F.lit("")), F.coalesce(model, F.lit("")), F.lit(version)))
