"""The library's listings: release notes by version, families of spaces, chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sections of a version in their order, with what the changelog and the version's page call them.
SECTIONS = ("enhancements", "tasks", "bugs", "schema_changes")
ITEMS = {"enhancements": "enhancement", "tasks": "task", "bugs": "bug fix", "schema_changes": "schema change"}
TITLES = {"enhancements": "Enhancements and New Features", "tasks": "Tasks", "bugs": "Bugs", "schema_changes": "Schema Changes"}
SHOWN = 10


def families(spaces: DataFrame, label: str, key: str, order: str) -> DataFrame:
    """``label, spaces, n``: the keys of each label in listing order."""
    got = spaces.groupBy(label).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k")))).alias("p"))
    return got.select(label, F.transform("p", lambda x: x["k"]).alias("spaces"), F.size("p").alias("n"))


def family_map(spaces: DataFrame) -> DataFrame:
    """``label, members`` (key:name:kind): the spaces of each label, and the products with release notes as one more family."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kb = spaces.select(text("product_label").alias("label"), "space_key", F.concat_ws(":", "space_key", text("display_name"), F.lit("kb")).alias("m"))
    rn = spaces.where("product is not null").select(F.lit("Release Notes").alias("label"), F.col("product").alias("space_key"), F.concat_ws(":", "product", "product", F.lit("rn")).alias("m")).distinct()
    got = kb.unionByName(rn).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("space_key", "m"))).alias("p"))
    return got.select("label", F.transform("p", lambda x: x["m"]).alias("members"))


def chat_list(turns: DataFrame, chat: str, ts: str) -> DataFrame:
    """``chat, updated, turns``, the newest chat first."""
    return turns.groupBy(chat).agg(F.max(ts).alias("updated"), F.count(F.lit(1)).alias("turns")).orderBy(F.desc("updated"), chat)


def saved_chats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chats (chat_id, title, payload) after saving ``new``: payloads are replaced, a title that was given stays over an automatic one."""
    both = old.select("chat_id", F.col("title").alias("_old"), F.col("payload").alias("_was")).join(new, "chat_id", "full_outer")
    return both.select("chat_id", F.coalesce(F.nullif("_old", F.lit("")), "title").alias("title"), F.coalesce("payload", "_was").alias("payload"))


def changelog(items: DataFrame) -> DataFrame:
    """``product, version, url, summary`` of versions with their sections counted (product, version, url, section, n)."""
    sums = items.groupBy("product", "version", "url").agg(*(F.coalesce(F.sum(F.when(F.col("section") == s, F.col("n"))), F.lit(0)).alias(s) for s in SECTIONS))
    words = F.concat_ws(", ", *(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {ITEMS[s]}(s)"))) for s in SECTIONS))
    return sums.withColumn("summary", F.coalesce(F.nullif(words, F.lit("")), F.lit("no items extracted")))


def version_parts(version: Column) -> Column:
    """A version's numbers, as they are sorted by; parts that are no numbers count as -1."""
    return F.transform(F.split(F.replace(F.coalesce(version, F.lit("")), F.lit("-"), F.lit(".")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def master_index(versions: DataFrame) -> DataFrame:
    """``product, versions, newest, more``: how many versions a product has, the newest ten of them and how many more there are.

    The ten are picked by a ranked window that keeps ten rows of each product per partition before any are moved."""
    w = Window.partitionBy("product").orderBy(F.desc(version_parts(F.col("version"))), F.desc("version"))
    top = versions.select("product", "version").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SHOWN)
    shown = top.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("_n", "version"))).alias("p")).select("product", F.transform("p", lambda x: x["version"]).alias("newest"))
    n = versions.groupBy("product").agg(F.count(F.lit(1)).alias("versions"))
    return n.join(shown, "product", "left").withColumn("more", F.greatest(F.col("versions") - SHOWN, F.lit(0)))


def item_line(row: Column) -> Column:
    """``- **id** — details`` of an item (a map); without an id the details alone; without details the first value that is not empty."""
    given = lambda c: F.nullif(c, F.lit(""))
    details = F.coalesce(given(row["details"]), F.get(F.filter(F.map_values(row), lambda v: v != ""), F.lit(0)), F.lit(""))
    return F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("**"), given(row["id"]), F.lit("** — ")), F.lit("")), details)


def section_markdown(name: str, rows: Column) -> Column:
    """A section's table: the columns of all rows in the order they are first seen; pipes are escaped and line ends made blanks."""
    cols = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.map_keys(r))))
    cell = lambda v: F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(cols, lambda c: cell(F.element_at(r, c)))))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(cols, lambda _: F.lit("---")), "|"), F.lit("|"))
    text = F.array_join(F.concat(F.array(F.lit(f"## {TITLES[name]}"), F.lit(""), line(cols), rule), body, F.array(F.lit(""))), "\n")
    return F.when(F.size(rows) > 0, text)


def version_markdown(versions: DataFrame) -> DataFrame:
    """``product, version, markdown`` of version records (product, version, title, url, scraped_at, screenshot and a list of maps
    for each of :data:`SECTIONS`)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = F.initcap(F.replace(text("product"), F.lit("_"), F.lit(" ")))
    title = F.coalesce("title", F.concat(F.lit("Version "), F.col("version")))
    head = F.concat(F.lit("# "), shown, F.lit(" — "), title, F.lit("\n\n**Version:** "), text("version"), F.lit("  \n**URL:** "), text("url"), F.lit("  \n**Scraped:** "), text("scraped_at"), F.lit("  \n**Screenshot:** `"), text("screenshot"), F.lit("`\n"))
    return versions.select("product", "version", F.concat_ws("\n", head, *(section_markdown(s, F.col(s)) for s in SECTIONS)).alias("markdown"))
