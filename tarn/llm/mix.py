"""Mixing sources to target weights.

Tokens are aggregated per source, a repetition rate is derived for each, and every document is emitted
floor(rate) times plus one more with a probability equal to the rate's fraction, drawn from a hash of its id and
the seed, so a rerun or a lost executor draws the same.

Rates: the mix is to hold ``total`` tokens (by default, as many as the weighted sources have) in the shares of
their weights among sources that have tokens.  A source that would need more than its ``max_repeats`` is held at
it, and what it cannot give is spread over the others by their weights, again and again until none exceeds its cap
or all are at it; the report shows target and actual shares.

Source names are compared after trimming, lower-casing and turning runs of blanks, hyphens and dots to ``_``.
Defined results: sources that have no target, or a null or non-positive weight or cap, and documents without a
source or without tokens are not in the mix; targets without documents get an actual share of 0; of targets whose
names coincide the weights add up and the largest cap holds; repeated documents are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import tokenizer
from tarn.sources.tables import bounded_rows, cut

#: Most sources a target table may have.
MAX_SOURCES = 100_000


def source_key(source: Column) -> Column:
    key = F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-._/]+", "_")
    return F.when(key != "", key)


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``, computed once and kept in the shared checkpoint folder."""
    df = docs.select("doc_id", source_key(F.col("source")).alias("source"), tokenizer.n_tokens(docs.sparkSession, F.col("text"), path).alias("n_tokens"))
    return cut(df)


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, float]], total: float | None = None) -> dict[str, float]:
    """The repetition rate of each source with tokens, a weight and a cap."""
    live = {s: (w, cap) for s, (w, cap) in targets.items() if tokens.get(s, 0) > 0 and w > 0 and cap > 0}
    if not live:
        return {}
    left = float(sum(tokens[s] for s in live)) if total is None else float(total)
    out: dict[str, float] = {}
    while live:
        weight = sum(w for w, _ in live.values())
        over = [s for s, (w, cap) in live.items() if left * w / weight >= cap * tokens[s]]
        if not over:
            out |= {s: left * w / weight / tokens[s] for s, (w, _) in live.items()}
            break
        for s in over:
            out[s] = float(live.pop(s)[1])
            left -= out[s] * tokens[s]
        left = max(left, 0.0)
    return out


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source of either table: ``source, n_docs, n_tokens, weight, max_repeats, target_share, rate``.

    Only per-source sums of targeted sources, at most ``MAX_SOURCES`` rows, reach the driver.
    """
    spark = docs.sparkSession
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    goal = targets.select(source_key(F.col("source")).alias("source"), "weight", "max_repeats").where(F.col("source").isNotNull())
    goal = goal.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").cast("double").alias("max_repeats"))
    both = goal.join(sums, "source", "left").select("source", "n_docs", "n_tokens", "weight", "max_repeats")
    rows = bounded_rows(both, MAX_SOURCES, "mix targets")
    want = {r["source"]: (r["weight"] or 0.0, r["max_repeats"] or 0.0) for r in rows}
    got = rates({r["source"]: r["n_tokens"] or 0 for r in rows}, want, total)
    weight = sum(max(w, 0.0) for w, _ in want.values())
    out = [
        (r["source"], r["n_docs"] or 0, r["n_tokens"] or 0, float(want[r["source"]][0]), float(want[r["source"]][1]), max(want[r["source"]][0], 0.0) / weight if weight else 0.0, float(got.get(r["source"], 0.0)))
        for r in rows
    ]
    return spark.createDataFrame(out, "source string, n_docs bigint, n_tokens bigint, weight double, max_repeats double, target_share double, rate double")


def emit(docs: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """The mix: ``doc_id, source, copy_no, n_tokens``, one row per copy of a document."""
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    fits = F.broadcast(rated.where("rate > 0").select("source", "rate"))  # at most MAX_SOURCES short rows
    copies = F.floor("rate").cast("int") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    some = docs.where(F.col("n_tokens") > 0).join(fits, "source").withColumn("copies", copies).where("copies > 0")
    return some.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def shares(mix: DataFrame, rated: DataFrame) -> DataFrame:
    """Target and actual share of every targeted source."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"))
    total = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(_all())
    out = rated.join(got, "source", "left").withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))
    return out.select("source", "n_docs", "n_tokens", "weight", "max_repeats", "rate", F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), "target_share", "actual_share")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # at most MAX_SOURCES rows
