"""Queries of the training-data problems on the driver's tables."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import email, lang, leak, mix, pii, split, tokenizer
from tarn.sources.tables import table


def _oversizable(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk").select(F.lit("chunk.text").alias("field"), F.col("chunk_no").alias("row_id"), "text")
    deals = table(spark, d, "booking_spot_deal").select(F.lit("booking_spot_deal.body_md").alias("field"), F.col("art_no").alias("row_id"), F.col("body_md").alias("text"))
    return chunks.unionByName(deals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be cut: the first of their pieces stands for each."""
    got = split.split_texts(_oversizable(spark, d), table(spark, d, "split_limit"))
    return got.where("n_pieces > 1 and piece_no = 1").select("field", "row_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(_oversizable(spark, d), table(spark, d, "split_limit"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items they leak."""
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_holdout"), with_places=False).select("doc_id", "item_id")


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_holdout"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return table(spark, d, "documents").select("doc_id", tokenizer.ids(spark, F.col("text")).alias("ids"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of a document in the mix."""
    docs = mix.sized(table(spark, d, "documents"))
    return mix.emit(docs, mix.plan(docs, table(spark, d, "mix_target")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    docs = mix.sized(table(spark, d, "documents"))
    rated = mix.plan(docs, table(spark, d, "mix_target"))
    return mix.shares(mix.emit(docs, rated), rated)


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p5_found, p5_spans, p7_ids, p8_mix, p8_shares)}
ORACLES: dict[str, str] = {}
ORACLES["p2_found"] = """
SELECT field, row_id FROM (
  SELECT 'chunk.text' AS field, chunk_no AS row_id, length(text) AS n FROM chunk
  UNION ALL SELECT 'booking_spot_deal.body_md', art_no, length(body_md) FROM booking_spot_deal
) JOIN split_limit USING (field) WHERE n > max_chars"""


def _identified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lang.identify(docs, lang.fit_profiles(docs))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of documents whose label is missing or wrong or whose text is in several languages."""
    return _identified(spark, d).where("not label_ok").select("doc_id", "start_pos", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    return _identified(spark, d)


QUERIES |= {f.__name__: f for f in (p9_found, p9_languages)}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines their sender did not newly write."""
    return email.other_lines(table(spark, d, "ticket")).select("rec_id", "comment_no", "line_no")


def p4_new_text(spark: SparkSession, d: str) -> DataFrame:
    """Each message with only its new text."""
    return email.reduced(table(spark, d, "ticket"))


QUERIES |= {f.__name__: f for f in (p4_found, p4_new_text)}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every personal detail in the texts of tickets."""
    tickets = table(spark, d, "ticket")
    return pii.find_details(tickets, pii.fit_names(tickets)).where("kind <> 'date'").select("rec_id", "field", "kind", "start_pos")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders. The key is ``tarn.pii.key`` of the session; without one a random key is drawn for
    this result, so its pseudonyms link within it and nowhere else."""
    tickets = table(spark, d, "ticket")
    key = spark.conf.get("tarn.pii.key", None) or secrets.token_hex(32)
    return pii.redact(tickets, pii.fit_names(tickets), key.encode())


QUERIES |= {f.__name__: f for f in (p6_found, p6_redacted)}
