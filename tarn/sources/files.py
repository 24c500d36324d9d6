"""Readers of the file layouts a knowledge-base library consists of, tolerant of broken files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("space_key", "space_name", "product", "title", "url", "scraped_at", "screenshot", "body_md")])
USAGE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("ts", "kind", "model")), *(T.StructField(n, T.LongType()) for n in ("tokens_in", "tokens_out", "latency_ms")), T.StructField("retrieved_ids", T.ArrayType(T.StringType()))])
EVAL = T.StructType([T.StructField("question", T.StringType()), T.StructField("product", T.StringType()), T.StructField("expected_sources", T.ArrayType(T.StringType())), T.StructField("expected_keypoints", T.ArrayType(T.StringType()))])
#: Usage kinds that are no answers.
NO_ANSWER = ("learn_mode_failed_auth",)


def library_roots(exists, library: str, tickets: str | None = None) -> tuple[str, str]:
    """(articles, tickets) of a library path: its kb leaf, or itself if it is one; tickets lie beside unless given."""
    base = library.rstrip("/")
    leaf = base if base.rsplit("/", 1)[-1] == "kb" else (f"{base}/kb" if exists(f"{base}/kb") else base)
    parent = leaf.rsplit("/", 1)[0] if leaf.endswith("/kb") else base
    return leaf, tickets or f"{parent}/tickets"


def signatures(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """``path, sig`` of files: modification time and size, without reading them."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.concat_ws(":", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("sig"))


def _json_files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(path)
    return df.select(F.col("_metadata.file_path").alias("path"), "value")


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles under the child folders of a root; index files, unreadable files and such without a body are left out."""
    depth = len(root.rstrip("/").split("/"))
    rel = F.split(F.regexp_replace("path", r"^file:/*", "/"), "/")
    df = _json_files(spark, root, "*.json", True).where(~F.col("path").endswith("/index.json") & (F.size(rel) > depth + 1))
    got = df.select("path", F.from_json("value", ARTICLE, {"mode": "PERMISSIVE"}).alias("a"))
    return got.where("a.body_md is not null and trim(a.body_md) <> ''").select("path", "a.*", F.when(F.size(rel) - depth >= 3, F.get(rel, F.lit(depth + 1))).otherwise("").alias("category"))


def tickets(spark: SparkSession, root: str) -> DataFrame:
    """Ticket files (``ticket_*.json``, not below the root) as payloads for the nested-record operator."""
    df = _json_files(spark, root, "ticket_*.json", False)
    return df.select("path", F.xxhash64("path").alias("raw_id"), F.col("value").alias("payload"))


def usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage lines; blank and malformed ones and kinds that are no answers are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select(F.from_json("value", USAGE, {"mode": "PERMISSIVE"}).alias("u"), F.try_parse_json("value").isNotNull().alias("ok"))
    return got.where("ok and u is not null").select("u.*").where(~F.coalesce(F.col("kind").isin(*NO_ANSWER), F.lit(False)))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).option("multiLine", "true").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A saved manifest; empty, which means a full build, if there is none. One that is there but cannot be read is an error."""
    try:
        return spark.read.parquet(path).select("path", "sig", "chunk_ids")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, sig string, chunk_ids array<string>")


def listing_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of REST listing pages: ``page_id, title, url``, the first of each url; pages that are no listings give none."""
    schema = "struct<results:array<struct<id:string,title:string,_links:struct<webui:string>>>>"
    rows = pages.withColumn("_p", F.from_json(payload, schema)).select("*", F.posexplode("_p.results").alias("pos", "r"))
    from tarn.operators.retrieval import first_per

    got = rows.select("page_no", "pos", F.col("r.id").alias("page_id"), F.col("r.title").alias("title"), F.col("r._links.webui").alias("url")).where("url is not null")
    return first_per(got, ["url"], [F.col("page_no"), F.col("pos")]).drop("page_no", "pos")
