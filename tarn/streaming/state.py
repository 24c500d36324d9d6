"""State that follows a stream: exactly-once accounting, incremental upserts, adaptive permits, windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.incremental import upsert
from tarn.sources import sinks

# The permit controller's thresholds and steps.
WINDOW, BAD, TRIP = 20, 0.40, 0.85
DELAY_MIN, DELAY_MAX = 0.5, 8.0
CPU_HIGH, CPU_LOW, FREE_LOW, FREE_OK = 90.0, 75.0, 800.0, 1500.0


def once(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; state is dropped when the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, table: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Applies each micro-batch to a published table; a repeated batch changes nothing, as rows replace their keys.

    Of a key's rows in a batch the one latest by ``order`` counts, ties and batches without it by the whole row as JSON, so a
    repeated batch chooses the same one."""

    def apply(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        row = F.struct(*rest)
        by = F.struct(*([F.col(order)] if order else []), F.to_json(row))
        new = batch.groupBy(key).agg(F.max_by(row, by).alias("_r")).select(key, "_r.*").select(*batch.columns)
        old = sinks.current(batch.sparkSession, table)
        sinks.publish(new if old is None else upsert(old, new, key), table)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: event counts per tumbling window and group, with late data up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


class Gate:
    """Permits that shrink while outcomes fail and grow while they succeed, a delay before each item, and a breaker."""

    def __init__(self, ceiling: int = 8, floor: int = 1) -> None:
        self.ceiling = max(1, ceiling)
        self.floor = max(1, min(floor, self.ceiling))
        self.permits = self.ceiling
        self.delay = 0.0
        self.recent: deque[bool] = deque(maxlen=WINDOW)
        self.tripped = False

    def failing(self) -> float:
        return self.recent.count(False) / len(self.recent) if self.recent else 0.0

    def record(self, ok: bool) -> None:
        """One outcome: bad times take a permit while there is one to take and double the delay; clean ones give one back and halve
        it, to nothing once all are back. A full window of failures with no permit left to take trips the breaker."""
        self.recent.append(ok)
        share = self.failing()
        if share >= BAD and self.permits > self.floor:
            self.permits -= 1
            self.delay = min(DELAY_MAX, max(DELAY_MIN, 2 * self.delay))
        elif share <= 0:
            self.permits = min(self.ceiling, self.permits + 1)
            self.delay = 0.0 if self.permits == self.ceiling else self.delay / 2
        if len(self.recent) == WINDOW and self.permits <= self.floor and share >= TRIP:
            self.tripped = True

    def consume_trip(self) -> bool:
        """Whether the breaker has tripped since this was last asked; a trip that is taken starts a fresh window."""
        had, self.tripped = self.tripped, False
        if had:
            self.recent.clear()
        return had

    def tune(self, cpu: float, free_mb: float) -> None:
        """One step by resources: down when either is short, up when both are ample and outcomes are not bad."""
        if cpu >= CPU_HIGH or free_mb <= FREE_LOW:
            self.permits = max(self.floor, self.permits - 1)
        elif cpu <= CPU_LOW and free_mb >= FREE_OK and self.failing() < BAD:
            self.permits = min(self.ceiling, self.permits + 1)

    def set_ceiling(self, n: int) -> None:
        """A new ceiling: lower ones hold at once, higher ones are grown into."""
        self.ceiling = max(1, n)
        self.floor = min(self.floor, self.ceiling)
        self.permits = min(self.permits, self.ceiling)


GATE = "key string, seq bigint, permits int, delay double, tripped boolean"


def gate_log(outcomes: DataFrame, key: str, seq: str, ok: str, ceiling: int = 8) -> DataFrame:
    """The gate's state after every outcome of each key.

    A key's outcomes are a sequence, so each key is one state machine; rows come sorted and in batches, and only the
    machine's few numbers are held, so a key with a third of all rows streams through its task."""
    rows = outcomes.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(seq).cast("bigint").alias("seq"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gate = None, Gate(ceiling)
        for pdf in batches:
            out = []
            for k, s, good in pdf.itertuples(index=False):
                if k != now:
                    now, gate = k, Gate(ceiling)
                gate.record(bool(good))
                out.append((k, s, gate.permits, gate.delay, gate.tripped))
            yield pd.DataFrame(out, columns=["key", "seq", "permits", "delay", "tripped"])

    return ordered.mapInPandas(run, GATE)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything a source holds now, through a sink, then stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
