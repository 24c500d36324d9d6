"""Scores of answers and models, and the gate over training records."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import redaction as R


class Leak(ValueError):
    """Training records with personal details or secrets."""


def scan_records(records: DataFrame, key: str, messages: str) -> DataFrame:
    """``key, message_no, category, head``: every leak in the records' messages, with the message's first 80 characters."""
    rows = records.select(key, F.posexplode(messages).alias("message_no", "content")).where("content is not null")
    return rows.select(key, "message_no", F.explode(R.leaks(F.col("content"))).alias("category"), F.substring("content", 1, 80).alias("head"))


def assert_clean(records: DataFrame, key: str, messages: str) -> None:
    """Raises :class:`Leak` if any message leaks; stops at the first one found."""
    first = scan_records(records, key, messages).first()
    if first:
        raise Leak(f"leak in record {first[key]}, message {first['message_no']}: {first['category']}")


def answer_stability(runs: DataFrame, case: str, run: str, answer: str) -> DataFrame:
    """``case, stability``: the mean similarity of each two answers of a case in the order of its runs; 1 for a single run.

    Cases are held to their runs, which are few by nature; a case's pairs are made one row after another, so a case with many
    runs takes time but no memory."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(run)[answer].fillna("").tolist()
        total = n = 0
        for a, b in combinations(own, 2):
            total += SequenceMatcher(None, a, b).ratio()
            n += 1
        return pd.DataFrame({case: [pdf[case].iloc[0]], "stability": [round(total / n, 4) if n else 1.0]})

    kind = dict(runs.dtypes)[case]
    return runs.select(case, run, answer).groupBy(case).applyInPandas(mean, f"{case} {kind}, stability double")


def means(cases: DataFrame, scores: list[str], places: int = 3) -> DataFrame:
    """The mean of each score over all cases, 0 without any, and their number."""
    return cases.agg(*(F.coalesce(F.round(F.avg(c), places), F.lit(0.0)).alias(c) for c in scores), F.count(F.lit(1)).alias("n"))


def model_scores(cases: DataFrame, unsupported: DataFrame) -> DataFrame:
    """``model, accuracy, abstain_safety``: mean accuracy over cases (0 without any), and the share of safe answers to unsupported
    questions (1 without any)."""
    a = cases.groupBy("model").agg(F.round(F.avg("accuracy"), 4).alias("accuracy"))
    u = unsupported.groupBy("model").agg(F.round(F.avg(F.col("safe").cast("double")), 4).alias("abstain_safety"))
    return a.join(u, "model", "full_outer").select("model", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("abstain_safety", F.lit(1.0)).alias("abstain_safety"))
