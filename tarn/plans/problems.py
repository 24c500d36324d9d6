"""Queries of the general problems (nested records, timestamps) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import nested, timestamps
from tarn.sources.tables import bounded_rows, join_small, table


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    typed = nested.typed_tickets(table(spark, d, "ticket"))
    parsed = nested.parse_payloads(table(spark, d, "ticket_raw"))
    return nested.occurrences(typed.unionByName(parsed))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per object of every ticket and payload."""
    return nested.bridge_rows(_bridge(spark, d)).where(F.col("object_hash").isNotNull()).select("src", "row_id", "path")


def p1_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Parent-child rows with ordinals."""
    return nested.bridge_rows(_bridge(spark, d))


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct object once."""
    return nested.objects(_bridge(spark, d))


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Every timestamp spelling: ``field, row_id, value, portal, ingested_at``."""
    field = lambda name: F.struct(F.lit(f"ticket.{name}").alias("field"), F.col(name).alias("value"))
    tickets = table(spark, d, "ticket").select(F.col("rec_id").alias("row_id"), "portal", "ingested_at", F.explode(F.array(field("created_at"), field("date"))).alias("v"))
    deals = table(spark, d, "booking_spot_deal").select(F.lit("booking_spot_deal.scraped_at").alias("field"), F.col("art_no").alias("row_id"), F.col("scraped_at").alias("value"), "portal", F.lit(None).cast("timestamp").alias("ingested_at"))
    return tickets.select("v.field", "row_id", "v.value", "portal", F.col("ingested_at").cast("timestamp").alias("ingested_at")).unionByName(deals)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC instant of every readable timestamp."""
    out = timestamps.normalise(_values(spark, d), "value", table(spark, d, "portal_site"), ingested="ingested_at")
    return out.where(F.col("utc_us").isNotNull()).select("field", "row_id", "utc_us")


def p3_zones(spark: SparkSession, d: str) -> DataFrame:
    """Per portal and field the zone its zoneless ticket times point to, beside the declared one."""
    sites = table(spark, d, "portal_site")
    names = sorted({r["zone"] for r in bounded_rows(sites.select("zone").distinct(), timestamps.MAX_ZONES, "portal zones") if r["zone"]})
    reads = timestamps.read_values(join_small(_values(spark, d), sites.select("portal", "date_order"), ["portal"]), "value", F.col("date_order"))
    est = timestamps.estimate_zones(reads, ["portal", "field"], "ingested_at", names)
    return join_small(est, sites.select("portal", F.col("zone").alias("declared_zone")), ["portal"])


def p1_tickets(spark: SparkSession, d: str) -> DataFrame:
    """The tickets the bridge's rows belong to."""
    return nested.heads(table(spark, d, "ticket"), table(spark, d, "ticket_raw"))


def p1_comments(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct comment once, in typed columns."""
    return nested.flat(p1_objects(spark, d), "comments")


def p1_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct resolution once."""
    return nested.flat(p1_objects(spark, d), "resolutions")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct image and attachment once."""
    return nested.flat(p1_objects(spark, d), "files")


QUERIES = {f.__name__: f for f in (p1_found, p1_bridge, p1_objects, p1_tickets, p1_comments, p1_resolutions, p1_files, p3_found, p3_zones)}
ORACLES: dict[str, str] = {}
