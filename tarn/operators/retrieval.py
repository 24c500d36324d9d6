"""Ranked retrieval: keyword and dense candidates, fusion, reranking behind a gate, parent assembly.

Queries come in batches.  A block of at most ``BLOCK`` queries is broadcast, each partition of the corpus scores its
rows against the block and keeps its own k best per query, and one window ranks what is left: the shuffle carries
k rows per query and partition, never pairs.  More queries run in further blocks.

Ties are broken by id everywhere.  Defined results: null and empty texts and queries without known terms find
nothing; rows scoring 0 or less are no candidates; repeated rows are separate rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import TOKEN, sigmoid, tokens
from tarn.sources.tables import cut, spread

# BM25 and fusion parameters, candidates and gates.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
TOP_K, RERANK_K, RERANK_K_ERROR = 30, 8, 14
CONFIDENCE_FLOOR = 0.06
#: Queries per broadcast block.
BLOCK = 20_000


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df``: partial counts first, one row per term shuffled and partition."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _idf(n: int, df: Column) -> Column:
    return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)


def _blocks(queries: DataFrame, qid: str) -> list[DataFrame]:
    n = queries.count()
    b = max(1, -(-n // BLOCK))
    return [queries] if b == 1 else [queries.where(F.pmod(F.xxhash64(qid), F.lit(b)) == i) for i in range(b)]


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df, cf``: how many documents have a term and how often it occurs; counted per batch before anything is moved."""
    found = re.compile(TOKEN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        cf: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([cf[t] for t in df], pa.int64())], names=["term", "df", "cf"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                tf = Counter(found((t or "").lower()))
                df.update(tf.keys())
                cf.update(tf)
            if len(df) > 500_000:  # a bound on memory, not on terms
                yield out()
                df.clear(), cf.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", text: str = "text", qid: str = "query_id", query: str = "query", keep: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k best documents of each query; scores are rounded to 6 places before ranking.

    ``keep`` says which documents may be found; the statistics are of all. The corpus is read twice for any number of queries up
    to ``BLOCK``: once for the statistics, of which one row comes back, and once to score. ``counts`` are the statistics
    (:func:`term_counts`) where several searches share them."""
    docs = spread(docs.select(doc_id, text, (F.lit(True) if keep is None else keep).alias("_keep")))
    n = docs.count()
    found = re.compile(TOKEN).findall
    blocks = _blocks(queries, qid)
    if counts is None:
        counts = term_counts(docs, text)
        if len(blocks) > 1:
            counts = cut(counts)  # read once per block
    parts = []
    for block in blocks:
        rows = block.select(F.col(qid).cast("bigint").alias("q"), F.col(query).alias("t")).collect()  # at most BLOCK rows, or as many as one hash block holds
        asked = block.select(F.explode(F.array_distinct(tokens(F.col(query)))).alias("term")).distinct().withColumn("_asked", F.lit(True))
        idf = _idf(n, F.col("df"))
        stats = counts.join(F.broadcast(asked), "term", "left").agg(F.sum("cf").alias("tokens"), F.avg(idf).alias("mean"), F.collect_list(F.when(F.col("_asked"), F.struct("term", idf.alias("idf")))).alias("known")).first()
        avgdl, floor = (stats["tokens"] or 0) / max(n, 1), (stats["mean"] or 0.0) * EPSILON
        known = {r["term"]: r["idf"] if r["idf"] >= 0 else floor for r in stats["known"]}
        by_term: dict[str, tuple[list[int], list[float]]] = {}
        for i, r in enumerate(rows):
            for w, times in Counter(found((r["t"] or "").lower())).items():
                if w in known:
                    at = by_term.setdefault(w, ([], []))
                    at[0].append(i)
                    at[1].append(times * known[w])
        arrays = {w: (np.array(a, dtype=np.int64), np.array(b)) for w, (a, b) in by_term.items()}
        shared = docs.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in rows], dtype=np.int64), arrays))

        def score(texts: list[str | None], low: np.ndarray, shared=shared, avgdl=avgdl) -> np.ndarray:
            arrays = shared.value[1]
            out = np.zeros((len(texts), len(low)))
            for i, t in enumerate(texts):
                tf = Counter(found((t or "").lower()))
                length = sum(tf.values())
                norm = K1 * (1 - B + B * length / avgdl) if avgdl else 0.0
                s = out[i]
                for w in sorted(tf.keys() & arrays.keys()):
                    at, idf = arrays[w]
                    s[at] += idf * (tf[w] * (K1 + 1) / (tf[w] + norm))
            return np.round(out, 6)

        parts.append(_best(docs.where("_keep").select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("x")), shared, score, k, 0.0))
    return _ranked(parts, k)


def _kept(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query, document, score) the k best of each query, by score, then document."""
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[nth < k], d[nth < k], s[nth < k]


def _best(rows: DataFrame, shared, score: Callable[[list, np.ndarray], np.ndarray], k: int, above: float) -> DataFrame:
    """The k best rows per query of every partition, scored in parts of a batch as matrices (rows by queries).

    Each query's k-th best score so far is the bar that later rows must reach, so few of them are looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[0]
        low = np.full(len(ids), -np.inf)
        step = max(1, 1_000_000 // max(len(ids), 1))
        q, d, s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            docs = np.array(batch.column(0).to_pylist(), dtype=object)
            xs = batch.column(1).to_pylist()
            for lo in range(0, len(xs), step):
                got = score(xs[lo : lo + step], low)
                i, at = np.nonzero((got >= low) & (got > above))
                if not len(i):
                    continue
                new = np.array([-(1 << 63) if x is None else x for x in docs[lo + i]], dtype=np.int64)
                q, d, s = _kept(np.r_[q, at], np.r_[d, new], np.r_[s, got[i, at]], k)
                full = np.bincount(q, minlength=len(ids)) >= k
                last = np.r_[q[1:] != q[:-1], True]
                bar = np.full(len(ids), -np.inf)
                bar[q[last]] = s[last]
                low = np.where(full, bar, -np.inf)
        out = [pa.array(ids[q]), pa.array(d, mask=d == -(1 << 63)), pa.array(s)]
        yield pa.RecordBatch.from_arrays(out, names=["query_id", "doc_id", "score"])

    return spread(rows).mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, doc_id: str = "vec_id", vector: str = "embedding", qid: str = "query_id", qvector: str = "query_vec", keep: Column | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: exact nearest rows by squared distance (score is its negative), of those to ``keep``.

    One matrix product per batch says which rows may be among the k nearest; only their distances are computed exactly."""
    vectors = vectors if keep is None else vectors.where(keep)
    parts = []
    for block in _blocks(queries, qid):
        rows = block.where(F.col(qvector).isNotNull()).select(F.col(qid).cast("bigint").alias("q"), F.col(qvector).alias("v")).collect()
        if not rows:
            continue
        matrix = np.array([r["v"] for r in rows], dtype=np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in rows], dtype=np.int64), matrix, (matrix**2).sum(axis=1)))

        def score(vs: list, low: np.ndarray, shared=shared) -> np.ndarray:
            _, q, size = shared.value
            out = np.full((len(vs), len(q)), -np.inf)
            fit = [i for i, v in enumerate(vs) if v is not None and len(v) == q.shape[1] and None not in v]
            if not fit:
                return out
            x = np.array([vs[i] for i in fit], dtype=np.float64)
            near = 2 * x @ q.T - (x**2).sum(axis=1)[:, None] - size
            i, at = np.nonzero(near >= np.where(np.isfinite(low), low - 1e-5 * (1 + np.abs(low)), low))
            for lo in range(0, len(i), 200_000):
                a, b = i[lo : lo + 200_000], at[lo : lo + 200_000]
                out[np.array(fit)[a], b] = np.round(-((q[b] - x[a]) ** 2).sum(axis=1), 6)
            return out

        parts.append(_best(vectors.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(vector).alias("x")), shared, score, k, -np.inf))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")
    return _ranked(parts, k)


def fuse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: ``query_id, doc_id, score, rank``."""
    both = a.select("query_id", "doc_id", "rank").unionByName(b.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker, a logit: how many of the query's distinct tokens a text has, from -4 (none) to 4 (all)."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(-4.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) * 8.0 / F.size(q) - 4.0)


def rerank(candidates: DataFrame, wide: Column | None = None) -> DataFrame:
    """Candidates with ``query`` and ``text`` by reranker score: the best 8 (14 where ``wide``), none under the confidence floor."""
    scored = candidates.withColumn("rerank", F.round(sigmoid(overlap_score(F.col("query"), F.col("text"))), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "doc_id")))
    top = F.max("rerank").over(Window.partitionBy("query_id"))
    limit = F.lit(RERANK_K) if wide is None else F.when(wide, RERANK_K_ERROR).otherwise(RERANK_K)
    return ranked.withColumn("top_score", top).where((F.col("rank") <= limit) & (F.col("top_score") >= CONFIDENCE_FLOOR))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def assemble(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """Whole parents of chunks: the head's text, then the bodies of the others without their title line (all up to the first
    blank line), stripped, joined by blank lines; empty bodies are left out. Null texts count as empty, ties go by text."""
    got = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    at = lambda t: F.instr(t, F.lit("\n\n"))
    body = lambda t: _stripped(F.when(at(t) > 0, F.substr(t, at(t) + 2)).otherwise(t))
    rest = F.filter(F.transform(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda x: body(x["t"])), lambda t: t != "")
    return got.select(key, F.size("p").alias("n_chunks"), F.array_join(F.concat(F.array(_stripped(F.col("p")[0]["t"])), rest), "\n\n").alias("text"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under an order; nulls come first. Rows are reduced in each partition before they are moved,
    so a key with a third of all rows costs one row per partition."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    if not rest:
        return df.distinct()
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_first"))
    return got.select(*keys, *(F.col("_first")[c].alias(c) for c in rest)).select(*df.columns)
