"""Aggregated reports: usage, dominance, pace, indexes, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.tables import cut

# The share of one product above which no clarification is asked.
DOMINANT = 0.60


def usage(log: DataFrame, since: Column | None = None, *by: str) -> DataFrame:
    """Tokens in and out and answered queries, in all and since a time, per group or as one row."""
    i, o = F.coalesce("tokens_in", F.lit(0)), F.coalesce("tokens_out", F.lit(0))
    new = F.coalesce(F.col("ts") >= since, F.lit(False)) if since is not None else F.lit(False)
    asked = (i + o) > 0
    g = log.groupBy(*by) if by else log.groupBy()
    return g.agg(
        F.coalesce(F.sum(i), F.lit(0)).alias("total_in"), F.coalesce(F.sum(o), F.lit(0)).alias("total_out"), F.count_if(asked).alias("total_queries"),
        F.coalesce(F.sum(F.when(new, i)), F.lit(0)).alias("session_in"), F.coalesce(F.sum(F.when(new, o)), F.lit(0)).alias("session_out"), F.count_if(asked & new).alias("session_queries"),
    )


def cost(log: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """The log with ``cost``: tokens per million at the rates of the model, 0 for unknown models."""
    key = F.lower(F.trim(F.col(model)))
    r = rates.select(F.lower(F.trim("model")).alias("_m"), "rate_in", "rate_out").dropDuplicates(["_m"])
    c = F.coalesce("tokens_in", F.lit(0)) * F.coalesce("rate_in", F.lit(0.0)) + F.coalesce("tokens_out", F.lit(0)) * F.coalesce("rate_out", F.lit(0.0))
    return log.join(r, key == F.col("_m"), "left").withColumn("cost", c / 1e6).drop("_m", "rate_in", "rate_out")


def dominance(hits: DataFrame, query: str, product: str) -> DataFrame:
    """Per query the share of its most frequent product and whether to ask back."""
    per = hits.groupBy(query, product).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(query).agg(F.count(F.lit(1)).alias("products"), F.max("n").alias("top"), F.sum("n").alias("total"))
    share = F.col("top") / F.col("total")
    return g.select(query, "products", F.round(share, 6).alias("share"), ((F.col("products") > 1) & (share < DOMINANT)).alias("clarify"))


def pace(log: DataFrame, group: str, ts: str, done: str, points: int = 90) -> DataFrame:
    """Items per minute over the last ``points`` samples."""
    w = Window.partitionBy(group).orderBy(ts, done).rowsBetween(-(points - 1), 0)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    dt = seconds - F.first(seconds).over(w)
    return log.withColumn("pace", F.when(dt > 0, F.round((F.col(done) - F.first(done).over(w)) / dt * 60, 6)).otherwise(0.0))


def alert(failed: Column, total: Column) -> Column:
    """More failures than 50 and than a tenth of all."""
    return failed > F.greatest(F.lit(50), F.floor(total / 10))


def eval_accuracy(cases: DataFrame) -> DataFrame:
    """Half source recall, half keypoint coverage; nothing if sources were expected and none was found.

    ``cases`` has expected_sources, expected_keypoints, found_sources, answer; repeated expectations count again."""
    src = F.filter(F.coalesce("expected_sources", F.array().cast("array<string>")), lambda x: x.isNotNull())
    pts = F.filter(F.coalesce("expected_keypoints", F.array().cast("array<string>")), lambda x: x.isNotNull())
    found = F.size(F.filter(src, lambda s: F.array_contains(F.col("found_sources"), s)))
    said = F.size(F.filter(pts, lambda p: F.lower(F.coalesce("answer", F.lit(""))).contains(F.lower(p))))
    recall = F.when(F.size(src) > 0, found / F.size(src)).otherwise(1.0)
    cover = F.when(F.size(pts) > 0, said / F.size(pts)).otherwise(1.0)
    return cases.withColumn("accuracy", F.when((F.size(src) > 0) & (found == 0), 0.0).otherwise(F.round(0.5 * recall + 0.5 * cover, 4)))


def stability(runs: DataFrame, case: str, run: str, sources: str) -> DataFrame:
    """Mean pairwise Jaccard similarity of the sources of a case's runs, 1 for a single run; runs of a case are few, pairs are per case."""
    a, b = runs.alias("a"), runs.alias("b")
    both = a.join(b, (F.col(f"a.{case}") == F.col(f"b.{case}")) & (F.col(f"a.{run}") < F.col(f"b.{run}")))
    union = F.size(F.array_union(f"a.{sources}", f"b.{sources}"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(f"a.{sources}", f"b.{sources}")) / union)
    pairs = both.groupBy(F.col(f"a.{case}").alias(case)).agg(F.round(F.avg(j), 4).alias("stability"))
    return runs.select(case).distinct().join(pairs, case, "left").withColumn("stability", F.coalesce("stability", F.lit(1.0)))


def refused(answer: Column, markers: list[str]) -> Column:
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    hit = low == ""
    for m in markers:
        hit = hit | low.contains(m)
    return hit


def ship_gate(scores: DataFrame, base: str, tuned: str) -> DataFrame:
    """Whether the tuned model is at least as accurate and as safe as the base."""
    b = scores.where(F.col("model") == base).select(F.col("accuracy").alias("ba"), F.col("safety").alias("bs"))
    t = scores.where(F.col("model") == tuned).select(F.col("accuracy").alias("ta"), F.col("safety").alias("ts"))
    reason = F.when(F.col("ta") < F.col("ba"), "accuracy").when(F.col("ts") < F.col("bs"), "safety").otherwise("ok")
    return t.join(b, F.lit(True)).select("ta", "ba", "ts", "bs", (reason == "ok").alias("ship"), reason.alias("reason"))


def index_rows(items: DataFrame, order: dict[str, int], product: str, space: Column, title: Column, url: Column) -> DataFrame:
    """Index lines by product order, space and title, with pipes escaped; null and unlisted products share the place after the last."""
    places = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))
    rank = F.coalesce(places[F.col(product)], F.lit(max(order.values()) + 1))
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), cell(title), F.lit(" | "), cell(space), F.lit(" | "), F.coalesce(url, F.lit("")), F.lit(" |"))
    return items.withColumn("product_order", rank).withColumn("line", line)


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rows with their ``place`` in their group. The order is made by one range-partitioned sort; only the number of rows of each
    group in each partition, a few per partition, is gathered to number them, so no group is ever in one task."""
    # the order's values travel as columns, so that the window below runs over small counts alone
    cols = [f"_o{i}" for i in range(len(order))]
    tagged = rows.withColumns(dict(zip(cols, order, strict=True))).repartitionByRange(group, *cols).sortWithinPartitions(group, *cols).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    tagged = cut(tagged)
    counts = tagged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_low"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = tagged.join(F.broadcast(before.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_low", "_before")), (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("place", (F.col("_before") + F.col("_seq") - F.col("_low") + 1).cast("int")).drop("_g", "_p", "_low", "_before", "_part", "_seq", *cols)


def holdout(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``part`` eval for the ``n`` rows first by seeded hash, train for the others (a top-n, no full sort)."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    first = rows.select(key, h.alias("_h")).orderBy("_h", key).limit(n).select(key).withColumn("part", F.lit("eval"))
    return rows.join(first, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))
