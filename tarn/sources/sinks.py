"""Writers: versioned tables swapped by pointer, article and ticket files, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


_POINTER = "current-"


def _pointers(fs, path) -> list[tuple[int, object]]:
    """The table's pointers, oldest first; there is more than one only while or after a job is lost between two steps."""
    if not fs.exists(path):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(path)]
    return sorted(((int(n[len(_POINTER) :]), p) for n, p in names if n.startswith(_POINTER) and n[len(_POINTER) :].isdigit()), key=lambda x: x[0])


def publish(df: DataFrame, table: str) -> str:
    """Writes a new version beside the old ones, then adds a pointer with the next number: readers take the highest, so they see
    one version or the other, whenever a job is lost. The pointer is written aside and renamed to a name that does not exist yet,
    which is atomic and fails if another writer was first.

    Returns the version's folder."""
    spark = df.sparkSession
    version = f"{table}/v-{uuid.uuid4().hex}"
    fs, root, jvm = _fs(spark, table)
    before = _pointers(fs, root)
    df.write.parquet(version)
    temp = jvm.org.apache.hadoop.fs.Path(f"{table}/_next-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(version.encode()))
    out.close()
    number = before[-1][0] + 1 if before else 1
    final = jvm.org.apache.hadoop.fs.Path(f"{table}/{_POINTER}{number:012d}")
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        raise FileExistsError(f"another writer published version {number} of {table}")
    for _, old in before[:-1]:  # the one before stays for readers that have just looked
        fs.delete(old, False)
    return version


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The published version of a table; none if nothing was published yet."""
    fs, root, _ = _fs(spark, table)
    found = _pointers(fs, root)
    return spark.read.parquet(spark.read.text(str(found[-1][1])).first()[0]) if found else None


def front_matter(*fields: tuple[str, Column]) -> Column:
    """A YAML header of quoted values."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("---\n"), *(F.concat(F.lit(f"{n}: "), quote(c), F.lit("\n")) for n, c in fields), F.lit("---\n\n"))


def article_markdown(articles: DataFrame) -> DataFrame:
    """``product, lib_folder, slug, markdown`` of articles with their header."""
    from tarn.functions.text import slug

    md = F.concat(front_matter(("title", F.col("title")), ("url", F.col("url")), ("space", F.col("space_name")), ("product", F.col("product"))), F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body_md", F.lit("")), F.lit("\n"))
    return articles.select("art_no", "product", "lib_folder", slug(F.col("title")).alias("slug"), md.alias("markdown"))


def ticket_markdown(tickets: DataFrame) -> DataFrame:
    """``rec_id, markdown``: labelled fields (blank ones left out), resolution, comments and files."""
    line = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(f"**{label}:** "), c))
    who = lambda c: F.concat_ws(" — ", F.nullif(F.trim(c["author"]), F.lit("")), F.nullif(F.trim(c["date"]), F.lit("")), F.when(c["internal"], F.lit("internal")))
    body = F.transform(F.filter("comments", lambda c: c.isNotNull()), lambda c: F.concat(F.lit("### "), who(c), F.lit("\n\n"), F.coalesce(c["body"], F.lit(""))))
    files = F.transform(F.filter("attachments", lambda a: a.isNotNull()), lambda a: F.concat(F.lit("- "), F.coalesce(a["filename"], a["saved_path"], F.lit(""))))
    section = lambda title, parts, sep: F.when(F.size(parts) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(parts, sep)))
    md = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), line("Status", F.col("status")), line("Product", F.col("product")), line("Organization", F.col("organization")), line("Created", F.col("created_at")),
        F.when(F.trim("resolution.text") != "", F.concat(F.lit("## Resolution\n\n"), F.col("resolution.text"))), section("Comments", body, "\n\n"), section("Files", files, "\n"),
    )
    return tickets.select("rec_id", md.alias("markdown"))


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, other characters than ASCII as they are."""
    df.select(F.to_json(F.struct("*"))).write.mode(mode).text(path)


def learned_entry(entries: DataFrame) -> DataFrame:
    """Learned answers as articles, under a name that the same product and title always get."""
    from tarn.functions.text import slug

    name = F.substring(F.sha1(F.concat_ws(":", F.coalesce("product", F.lit("")), F.coalesce("title", F.lit("")))), 1, 16)
    return entries.select(name.alias("name"), "product", "title", slug(F.col("topic"), "general").alias("category"), F.col("answer").alias("body_md"))
