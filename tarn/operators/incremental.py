"""Incremental maintenance: diffs, upserts, audits and state kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.retrieval import first_per


def manifest_diff(current: DataFrame, manifest: DataFrame, key: str = "path", sig: str = "sig") -> DataFrame:
    """``key, state`` with state added, changed, removed or unchanged; a null signature differs from none but null."""
    c = current.select(key, F.col(sig).alias("_c"), F.lit(True).alias("_in_c"))
    m = manifest.select(key, F.col(sig).alias("_m"), F.lit(True).alias("_in_m"))
    state = F.when(F.col("_in_m").isNull(), "added").when(F.col("_in_c").isNull(), "removed").when(F.col("_c").eqNullSafe(F.col("_m")), "unchanged").otherwise("changed")
    return c.join(m, key, "full_outer").select(key, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key; of repeated new keys all rows stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def fetch(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``; blank keys fetch nothing."""
    return rows.join(keys.where(F.trim(F.col(key).cast("string")) != "").select(key).distinct(), key, "left_semi")


def completeness(expected: DataFrame, present: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per group of ``expected``: how many keys are expected, present and missing."""
    have = present.select(*group, key).distinct().withColumn("_have", F.lit(1))
    both = expected.select(*group, key).distinct().join(have, [*group, key], "left")
    return both.groupBy(*group).agg(F.count(F.lit(1)).alias("expected"), F.count("_have").alias("present"), F.sum(F.when(F.col("_have").isNull(), 1).otherwise(0)).alias("missing"))


def merge_first(parts: list[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """Parts one after another, the first row of each key; parts carry ``pos`` as their own order."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    got = first_per(out, [key], [F.col("part"), F.col("pos")])
    return got.orderBy("part", "pos").limit(limit) if limit else got


def retry_candidates(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of sources by key: the value of the last source that has it, at the place of the first (``first_source``)."""
    tagged = [s.select(key, value, F.lit(i).alias("src")) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.max_by(value, F.struct("src", value)).alias(value), F.min("src").alias("first_source"))


def replay(compacted: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """The keys of a compacted state and its journal."""
    return compacted.select(key).union(journal.select(key)).distinct()


def newest_cached(cache: DataFrame, key: str, put: str, limit: int) -> DataFrame:
    """The ``limit`` entries put last: a limit of the cache, not of the data (one top-k, no full sort)."""
    last = cache.groupBy(key).agg(F.max(put).alias(put))
    return last.orderBy(F.col(put).desc(), key).limit(limit)


def attempts(log: DataFrame, key: str, ok: str, limit: int = 3) -> DataFrame:
    """Per key the attempts, whether any of the first ``limit`` succeeded, and whether it was retried."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max(ok).alias("ok")).withColumn("retried", F.col("attempts") > 1).withColumn("exhausted", ~F.col("ok") & (F.col("attempts") >= limit))


def running_failure_share(log: DataFrame, key: str, order: list[str], failed: str, window: int = 20) -> DataFrame:
    """The share of failures among the last ``window`` outcomes of each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    return log.withColumn("failure_share", F.round(F.avg(F.col(failed).cast("double")).over(w), 6))


def ingest_report(diff: DataFrame) -> DataFrame:
    """What a run does by its diff, as one row: ``embedded`` (added or changed), ``deleted`` (changed or removed), ``unchanged`` and
    the ``total`` left after it."""
    state = F.col("state")
    return diff.agg(
        F.count_if(state.isin("added", "changed")).alias("embedded"), F.count_if(state.isin("changed", "removed")).alias("deleted"), F.count_if(state == "unchanged").alias("unchanged"), F.count_if(state != "removed").alias("total"),
    )


class EmptySource(ValueError):
    """A source without rows, which would wipe a populated index."""


def ingest(index: DataFrame, manifest: DataFrame, source: DataFrame, key: str = "id", sig: str = "sig", rebuild: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, manifest, diff) after a run: rows of changed and removed keys leave the index, those of added and changed ones enter.

    ``source`` has the index's columns and ``sig``. An empty source for an index with rows is refused before anything is done;
    ``rebuild`` (after a change of schema or model) takes every row anew."""
    if source.isEmpty() and not index.isEmpty():
        raise EmptySource("the source is empty; the index is left as it is")
    now = source.groupBy(key).agg(F.max(sig).alias(sig))
    diff = manifest_diff(now, manifest.where("false") if rebuild else manifest, key, sig)
    if rebuild:
        return source.select(*index.columns), now, diff
    kept = delete(index, diff.where("state in ('changed', 'removed')"), key)
    fresh = fetch(source, diff.where("state in ('added', 'changed')"), key)
    return kept.unionByName(fresh.select(*index.columns)), now, diff


def validate_groups(groups: DataFrame, items: DataFrame, key: str, count: str) -> DataFrame:
    """Each group with how many items it has, whether it has any, and whether all have (``passed``)."""
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    rows = groups.join(n, key, "left").withColumn(count, F.coalesce(count, F.lit(0))).withColumn("ok", F.col(count) > 0)
    return rows.join(F.broadcast(rows.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"))))


def legacy_state(state: DataFrame, nested: DataFrame, group: str, slugs: str) -> DataFrame:
    """``key``: the state, or, if it has no keys, those of the older nested one, flattened to ``group|slug``."""
    if not state.isEmpty():
        return state.select("key")
    return nested.select(group, F.explode(slugs).alias("_slug")).select(F.concat_ws("|", group, "_slug").alias("key")).distinct()


def worklist(items: DataFrame, retry: DataFrame, keys: list[str]) -> DataFrame:
    """The items among those to retry, each once."""
    return items.join(retry.select(*keys).distinct(), keys, "left_semi")
