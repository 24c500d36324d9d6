"""Table access and the size-checked handling of small dimension tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than there are, as from a single small file.

    For work that is heavy per row; inputs with enough partitions, so all large ones, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class TooLarge(ValueError):
    """A table that should be small exceeds its documented bound."""


def bounded_rows(df: DataFrame, bound: int, what: str) -> list[Row]:
    """All rows of a small table; raises :class:`TooLarge` past ``bound`` rows.

    Only one row more than the bound ever reaches the driver.
    """
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise TooLarge(f"{what} has more than {bound} rows")
    return rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], bound: int = 10_000, how: str = "left") -> DataFrame:
    """Join a dimension: broadcast if it has at most ``bound`` rows, else a shuffled join that AQE may split on skew."""
    fits = len(small.limit(bound + 1).select(on[0]).collect()) <= bound
    return big.join(F.broadcast(small) if fits else small, on, how)


class NoSharedFolder(RuntimeError):
    """A cluster whose session names no folder that all its machines share."""


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local session, where everything is one machine, gets a folder of its own
    if it names none; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tarn-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder, so that later stages reread it instead of recomputing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
