"""Queries of the library's own operators on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import redaction as R
from tarn.functions import text as X
from tarn.operators import answering, chunking, conversation, incremental, products, reports
from tarn.operators import retrieval as ret
from tarn.sources import sinks
from tarn.sources.tables import cut, spread, table
from tarn.streaming.state import gate_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- scalar text


@query("SELECT chunk_no, len(regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9#]+')) AS n_tokens FROM chunk")
def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk").select("chunk_no", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


SYNONYMS = [("web 2 5", "web2"), ("web 4 0", "web4"), ("rest api", "api")]


@query(
    r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce(question,'')), '[^\p{L}\p{N}_\s#]', ' ', 'g'), '\s+', ' ', 'g')),
    '\brest api\b', 'api', 'g'), '\bweb 2 5\b', 'web2', 'g'), '\bweb 4 0\b', 'web4', 'g'), '\s+', ' ', 'g')) AS norm FROM eval_holdout"""
)
def normalize_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_holdout").select("item_id", X.normalise_query(F.col("question"), SYNONYMS).alias("norm"))


_ERR = r"(?i)\b(error|errors|issue|issues|fail(?:s|ed|ing|ure)?|null|exception|crash(?:e[ds])?|bug|broken|wrong|incorrect|discrepan\w*|duplicat\w*|missing|not working|doesn''?t|cannot|can''?t|unable)\b"


@query(
    rf"""SELECT rec_id, CASE WHEN regexp_matches(t, '(?i)\bincidents?\b') THEN 'incident' WHEN regexp_matches(t, '{_ERR}') THEN 'error'
    WHEN regexp_matches(t, '(?i)\b(how (?:do|to|can|would)|steps?|guide|walk ?through|set ?up|configure|create|add|enable|book|post)\b') THEN 'how_to'
    WHEN regexp_matches(t, '(?i)\b(config\w*|settings?|install\w*|permission|enable|disable|toggle)\b') THEN 'config' ELSE 'general' END AS issue_type, regexp_matches(t, '{_ERR}') AS is_error
    FROM (SELECT rec_id, coalesce(title,'') AS t FROM ticket)"""
)
def classify_issue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ticket").select("rec_id", X.issue_type(F.col("title")).alias("issue_type"), X.is_error(F.col("title")).alias("is_error"))


@query(r"SELECT chunk_no, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text,''), '(?i)(?:ticket|tickets|bug|incident|#)\s*#?\s*(\d{3,7})', 1))), ',') AS refs FROM chunk")
def ticket_refs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk").select("chunk_no", F.array_join(F.array_sort(X.ticket_refs(F.col("text"))), ",").alias("refs"))


_PRODUCTS = [("tradedesk", "tradedesk"), ("saleshub", "saleshub"), ("formflow", "formflow"), ("rest api", "api"), ("api", "api"), ("web 2", "web2"), ("web 4", "web4")]


_NAMED = ", ".join(rf"CASE WHEN regexp_matches(t, '(?:^|[^\p{{L}}\p{{N}}_]){n}(?:[^\p{{L}}\p{{N}}_]|$)') THEN '{to}' END" for n, to in _PRODUCTS)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{_NAMED}], lambda x: x IS NOT NULL))), ',') AS products FROM (SELECT doc_id, lower(coalesce(text,'')) AS t FROM documents)")
def product_mentions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(X.mentions(F.col("text"), _PRODUCTS)), ",").alias("products"))


@query("SELECT art_no, CASE WHEN s = '' THEN 'untitled' ELSE substr(s, 1, 120) END AS slug FROM (SELECT art_no, regexp_replace(regexp_replace(lower(coalesce(title,'')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM booking_spot_deal)")
def slugify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "booking_spot_deal").select("art_no", X.slug(F.col("title")).alias("slug"))


@query("SELECT art_no, trim(replace(replace(coalesce(title,''), ' ', '_'), '/', '-')) AS name FROM booking_spot_deal")
def safe_name(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "booking_spot_deal").select("art_no", X.safe_name(F.col("title")).alias("name"))


@query(r"SELECT doc_id, coalesce(regexp_extract(coalesce(text,''), '\d+\.\d+(?:\.\d+)+'), '') AS version FROM documents")
def version_extract(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.version(F.col("text")).alias("version"))


@query(r"SELECT rec_id, trim(regexp_replace(coalesce(text,''), '\s+', ' ', 'g')) AS flat FROM ticket")
def collapse_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ticket").select("rec_id", X.collapse(F.col("text")).alias("flat"))


@query("SELECT chunk_no, 'art_' || substr(sha1(coalesce(space_key,'') || '|' || coalesce(title,'') || '|' || coalesce(chunk_index::varchar,'')), 1, 16) AS stable_id FROM chunk")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk").select("chunk_no", X.stable_id("art_", F.col("space_key"), F.col("title"), F.col("chunk_index")).alias("stable_id"))


@query("SELECT art_no, CASE WHEN len(string_split(p, '/')) >= 3 THEN string_split(p, '/')[2] ELSE '' END AS category FROM (SELECT art_no, coalesce(product,'') || '/' || coalesce(space_name,'') || '/' || coalesce(title,'') AS p FROM booking_spot_deal)")
def path_category(s: SparkSession, d: str) -> DataFrame:
    p = F.concat_ws("/", F.coalesce("product", F.lit("")), F.coalesce("space_name", F.lit("")), F.coalesce("title", F.lit("")))
    return table(s, d, "booking_spot_deal").select("art_no", X.path_category(p).alias("category"))


@query("SELECT doc_id, greatest(1, length(coalesce(text,'')) // 4)::int AS est FROM documents")
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("est"))


@query(
    r"""SELECT chunk_no, sha1(n || '|' || coalesce(product,'') || '|' || coalesce(kind,'') || '|v1') AS key FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(title,'')), '[^\p{L}\p{N}_\s#]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM chunk)"""
)
def cache_keys(s: SparkSession, d: str) -> DataFrame:
    key = conversation.cache_key(X.normalise_query(F.col("title"), []), F.col("product"), F.col("kind"), "v1")
    return table(s, d, "chunk").select("chunk_no", key.alias("key"))


@query(r"SELECT rec_id, coalesce(regexp_extract(regexp_replace(coalesce(created_at,''), '^[\s\x{00A0}\x{202F}]+', ''), '^\d{4}-\d{2}-\d{2}'), '') AS day FROM ticket")
def ticket_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ticket").select("rec_id", X.iso_date(F.col("created_at")).alias("day"))


@query("SELECT chat_id, count(DISTINCT id) AS n_ids FROM (SELECT chat_id, unnest(range(greatest(log_id - 2, 0), log_id + 1)) AS id FROM usage_log) GROUP BY chat_id")
def id_ranges(s: SparkSession, d: str) -> DataFrame:
    """The distinct ids of each chat's ranges, read row by row; a hot chat is counted in parts."""
    spec = F.concat_ws("-", "log_id", F.greatest(F.col("log_id") - 2, F.lit(0)))
    ids = table(s, d, "usage_log").select("chat_id", F.explode(X.id_ranges(spec)).alias("id"))
    return ids.groupBy("chat_id").agg(F.countDistinct("id").alias("n_ids"))


# ---------------------------------------------------------------- redaction


@query(r"SELECT rec_id, regexp_replace(coalesce(body,''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[redacted]', 'g') AS clean FROM ticket")
def scrub_emails(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ticket").select("rec_id", F.regexp_replace(F.coalesce("body", F.lit("")), R.LEAKS[0][1], R.GONE).alias("clean"))


@query(
    r"""SELECT * FROM (SELECT rec_id, 'email' AS kind FROM ticket WHERE regexp_matches(coalesce(body,''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')
    UNION ALL SELECT rec_id, 'phone' FROM ticket WHERE regexp_matches(coalesce(body,''), '(?:^|[^0-9])(?:\+?\d{1,2}[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?:[^0-9]|$)')
    UNION ALL SELECT rec_id, 'secret' FROM ticket WHERE regexp_matches(coalesce(body,''), '\b(?:sk-[A-Za-z0-9\-]{16,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|gh[pousr]_[A-Za-z0-9]{20,})\b')
    UNION ALL SELECT rec_id, 'password' FROM ticket WHERE regexp_matches(coalesce(body,''), '(?i)\bpassword\s*[:=]\s*[^\[\s]'))"""
)
def leak_scan(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "ticket").select("rec_id", "body")).select("rec_id", F.explode(R.leaks(F.col("body"))).alias("kind"))


@query()
def redact_tickets(s: SparkSession, d: str) -> DataFrame:
    terms = chunking.known_terms(F.col("comments"), F.col("resolution"), F.col("created_by"), F.col("assignee"))
    tickets = spread(table(s, d, "ticket").select("rec_id", "title", "body", "comments", "resolution", "created_by", "assignee"))
    return tickets.withColumn("_t", terms).select("rec_id", R.redact(F.col("body"), F.col("_t")).alias("body"), R.redact(F.col("title"), F.col("_t")).alias("title"))


@query()
def scrub_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "booking_spot_deal").select("art_no", R.scrub_answer(F.col("body_md")).alias("body"))


# ---------------------------------------------------------------- chunking


@query(r"""SELECT rec_id, ceil(n / 350.0)::int AS n_windows, CASE WHEN n > 350 THEN array_to_string(list_slice(w, 1, 350), ' ') END AS first_long FROM
    (SELECT rec_id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w, len(CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END) AS n FROM (SELECT rec_id, trim(regexp_replace(coalesce(body,''), '\s+', ' ', 'g')) AS t FROM ticket))""")
def word_windows(s: SparkSession, d: str) -> DataFrame:
    w = chunking.word_windows(F.col("body"))
    return table(s, d, "ticket").select("rec_id", F.size(w).alias("n_windows"), F.when(F.size(w) > 1, w[0]).alias("first_long"))


@query()
def article_chunks(s: SparkSession, d: str) -> DataFrame:
    spaces = table(s, d, "kb_space").select("space_key", "product_label", F.col("lib_folder").alias("category"))
    return chunking.article_chunks(table(s, d, "booking_spot_deal").join(spaces, "space_key", "left"))


@query()
def ticket_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.ticket_chunks(table(s, d, "ticket"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PARENTS = rf"""pc AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY chunk_index, text) AS n FROM (SELECT DISTINCT ticket_id, chunk_index, coalesce(text,'') AS text FROM chunk WHERE kind = 'ticket' AND ticket_id IS NOT NULL AND chunk_index IS NOT NULL)),
pb AS (SELECT *, CASE WHEN n > 1 AND contains(text, chr(10) || chr(10)) THEN {_STRIP.format("substr(text, instr(text, chr(10) || chr(10)) + 2)")} ELSE {_STRIP.format("text")} END AS body FROM pc),
parents AS (SELECT ticket_id, count(*)::int AS n_chunks, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY n) FILTER (n = 1 OR body <> ''), '') AS text FROM pb GROUP BY ticket_id)"""


@query(f"WITH {_PARENTS} SELECT ticket_id, n_chunks, text FROM parents")
def parent_assembly(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk").where("kind = 'ticket' and ticket_id is not null and chunk_index is not null").select("ticket_id", "chunk_index", "text").distinct()
    return ret.assemble(c, "ticket_id", "chunk_index", "text")


# ---------------------------------------------------------------- retrieval

_BM25 = r"""
d AS (SELECT chunk_no AS doc_id, regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9#]+') AS w FROM chunk),
st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(question,'')), '[a-z0-9#]+')) AS term FROM eval_holdout) GROUP BY ALL),
bs AS (SELECT query_id, tf.doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl)))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN d ON d.doc_id = tf.doc_id, st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0) WHERE rank <= 30)"""


def _bm25(s: SparkSession, d: str, k: int = ret.TOP_K, counts: DataFrame | None = None) -> DataFrame:
    q = table(s, d, "eval_holdout").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return ret.bm25_topk(table(s, d, "chunk"), q, k, doc_id="chunk_no", counts=counts)


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank::int AS rank FROM bm")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d).select("query_id", "doc_id", "rank")


def _dense(s: SparkSession, d: str, k: int = ret.TOP_K) -> DataFrame:
    v = table(s, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))  # the stated query set
    return ret.dense_topk(v, q, k)


_DENSE = """
ds AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(-list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 30)"""


@query(f"WITH {_DENSE} SELECT query_id, doc_id, rank::int AS rank FROM de")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d).select("query_id", "doc_id", "rank")


@query(
    f"""WITH {_DENSE}, l AS (SELECT query_id, doc_id, rank, label FROM de JOIN embeddings ON doc_id = vec_id)
    SELECT query_id, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM l) WHERE n = 1"""
)
def suggest_dedup(s: SparkSession, d: str) -> DataFrame:
    hits = _dense(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return ret.first_per(hits, ["query_id", "label"], [F.col("rank")]).select("query_id", "doc_id", "label")


@query(
    f"""WITH {_BM25}, c AS (SELECT query_id, doc_id, list_distinct(regexp_extract_all(lower(coalesce(question,'')), '[a-z0-9#]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9#]+')) AS w,
      regexp_matches(question, '{_ERR}') AS wide FROM bm JOIN eval_holdout ON item_id = query_id JOIN chunk ON chunk_no = doc_id),
    x AS (SELECT *, len(list_intersect(q, w)) * 8.0::double / len(q) - 4.0 AS logit FROM c),
    r AS (SELECT query_id, doc_id, wide, round(CASE WHEN logit >= 0 THEN 1 / (1 + exp(-logit)) ELSE exp(logit) / (1 + exp(logit)) END, 6) AS score FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM r)
    SELECT query_id, doc_id, round(score, 4) AS score, rank::int AS rank FROM k WHERE rank <= CASE WHEN wide THEN 14 ELSE 8 END AND top >= 0.06"""
)
def chunk_rerank(s: SparkSession, d: str) -> DataFrame:
    """Keyword hits on chunks, which have no vectors, reranked behind the gate."""
    return _reranked(s, d, _bm25(s, d))


def _reranked(s: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    q = table(s, d, "eval_holdout").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    c = hits.drop("rank").join(F.broadcast(q), "query_id").join(table(s, d, "chunk").select(F.col("chunk_no").alias("doc_id"), "text"), "doc_id")
    return ret.rerank(c, X.is_error(F.col("query"))).select("query_id", "doc_id", F.round("rerank", 4).alias("score"), "rank")


def _hybrid(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth document with a vector as a query, and the fused hits of its text and its vector.

    Documents and vectors are paired by ``doc_id = vec_id``, a synthetic association: the tables have no other."""
    docs = table(s, d, "documents").select("doc_id", "text")
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    q = v.where("doc_id % 50 = 0").join(docs, "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vec"))
    return q, ret.fuse(ret.bm25_topk(docs, q), ret.dense_topk(v, q, doc_id="doc_id"))


_PAIRED = "embeddings WHERE vec_id IN (SELECT doc_id FROM documents)"
_BM25_DOCS = _BM25.replace("chunk_no AS doc_id", "doc_id").replace("FROM chunk", "FROM documents").replace("item_id AS query_id", "query_id").replace("SELECT item_id, unnest", "SELECT query_id, unnest").replace("FROM eval_holdout", "FROM hq")
_HYBRID = f"""hq AS (SELECT doc_id AS query_id, text AS question FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), pv AS (SELECT * FROM {_PAIRED}),
{_BM25_DOCS}, {_DENSE.replace("embeddings q, embeddings v", "pv q, pv v")},
f AS (SELECT query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM de) GROUP BY ALL)"""


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::int AS rank FROM f")
def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    """Keyword and vector candidates of the same query, fused."""
    return _hybrid(s, d)[1].select("query_id", "doc_id", "rank")


@query(
    f"""WITH {_HYBRID}, c AS (SELECT f.query_id, f.doc_id, list_distinct(regexp_extract_all(lower(coalesce(question,'')), '[a-z0-9#]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9#]+')) AS w,
      coalesce(regexp_matches(question, '{_ERR}'), false) AS wide FROM f JOIN hq ON hq.query_id = f.query_id JOIN documents ON documents.doc_id = f.doc_id),
    x AS (SELECT *, CASE WHEN len(q) = 0 THEN -4.0 ELSE len(list_intersect(q, w)) * 8.0::double / len(q) - 4.0 END AS logit FROM c),
    r AS (SELECT query_id, doc_id, wide, round(CASE WHEN logit >= 0 THEN 1 / (1 + exp(-logit)) ELSE exp(logit) / (1 + exp(logit)) END, 6) AS score FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM r)
    SELECT query_id, doc_id, round(score, 4) AS score, rank::int AS rank FROM k WHERE rank <= CASE WHEN wide THEN 14 ELSE 8 END AND top >= 0.06"""
)
def rerank_gate(s: SparkSession, d: str) -> DataFrame:
    """The fused list, reranked behind the gate."""
    q, hits = _hybrid(s, d)
    c = hits.select("query_id", "doc_id").join(q.select("query_id", "query"), "query_id").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return ret.rerank(c, F.coalesce(X.is_error(F.col("query")), F.lit(False))).select("query_id", "doc_id", F.round("rerank", 4).alias("score"), "rank")


_BM25_TRADEDESK = _BM25.replace("FROM bs WHERE score > 0", "FROM bs WHERE score > 0 AND doc_id IN (SELECT chunk_no FROM chunk WHERE product = 'tradedesk')")


@query(f"WITH {_BM25_TRADEDESK} SELECT query_id, doc_id, rank::int AS rank FROM bm")
def product_filter_topk(s: SparkSession, d: str) -> DataFrame:
    """The 30 best of one product, by the statistics of all."""
    q = table(s, d, "eval_holdout").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return ret.bm25_topk(table(s, d, "chunk"), q, doc_id="chunk_no", keep=F.col("product") == "tradedesk").select("query_id", "doc_id", "rank")


@query(f"WITH {_DENSE.replace('WHERE q.vec_id % 50 = 0', 'WHERE q.vec_id % 50 = 0 AND v.label = 0')} SELECT query_id, doc_id, rank::int AS rank FROM de")
def dense_filter_topk(s: SparkSession, d: str) -> DataFrame:
    """The 30 nearest of one label, which stands in for the product: vectors have none."""
    v = table(s, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return ret.dense_topk(v, q, keep=F.col("label") == 0).select("query_id", "doc_id", "rank")


@query(
    f"""WITH {_BM25}, p AS (SELECT query_id, product, count(*) AS n FROM bm JOIN chunk ON chunk_no = doc_id GROUP BY ALL)
    SELECT query_id, count(*) AS products, round(max(n) / sum(n), 6) AS share, count(*) > 1 AND max(n) / sum(n) < 0.60 AS clarify FROM p GROUP BY query_id"""
)
def product_dominance(s: SparkSession, d: str) -> DataFrame:
    return _dominance(s, d, _bm25(s, d))


def _dominance(s: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    hits = hits.join(table(s, d, "chunk").select(F.col("chunk_no").alias("doc_id"), "product"), "doc_id")
    return reports.dominance(hits, "query_id", "product")


@query(
    f"""WITH {_BM25} SELECT query_id, array_to_string(list_sort(list_distinct(list(product) FILTER (product IS NOT NULL AND product <> ''))), ', ') AS products FROM bm JOIN chunk ON chunk_no = doc_id GROUP BY query_id"""
)
def clarifier_products(s: SparkSession, d: str) -> DataFrame:
    hits = _bm25(s, d).join(table(s, d, "chunk").select(F.col("chunk_no").alias("doc_id"), F.nullif("product", F.lit("")).alias("product")), "doc_id")
    return hits.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("product")), ", ").alias("products"))


@query("WITH df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_no, unnest(regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9#]+')) AS term FROM chunk) GROUP BY term) SELECT term, df FROM df")
def term_stats(s: SparkSession, d: str) -> DataFrame:
    return ret.document_frequencies(table(s, d, "chunk"))


# ---------------------------------------------------------------- joins, sets, incremental


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index as it is and as it was at the middle of its time, with all four states between them.

    A stated synthetic pair: the older one holds the chunks indexed before the middle of all times, each id as it first was
    and every tenth chunk with an earlier text; the current one holds each id as it last was, without every tenth chunk as withdrawn."""
    c = table(s, d, "chunk").withColumn("_us", F.unix_micros(F.col("indexed_at").cast("timestamp")))
    middle = c.agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi")).select(F.expr("_lo + (_hi - _lo) div 2").alias("_middle"))
    text = F.coalesce("text", F.lit(""))
    first = F.sha1(F.when(F.col("chunk_no") % 10 == 1, F.concat(text, F.lit(" (draft)"))).otherwise(text))
    c = c.where("id is not null").select("id", "chunk_no", "indexed_at", "_us", F.sha1(text).alias("sig"), first.alias("first"))
    cur = c.where("chunk_no % 10 <> 0").groupBy("id").agg(F.max_by("sig", F.struct("indexed_at", "chunk_no")).alias("sig"))
    old = c.join(F.broadcast(middle), F.col("_us") < F.col("_middle")).groupBy("id").agg(F.min_by("first", F.struct("indexed_at", "chunk_no")).alias("sig"))
    return cur, old


_HALVES = """mid AS (SELECT min(epoch_us(indexed_at)) + (max(epoch_us(indexed_at)) - min(epoch_us(indexed_at))) // 2 AS us FROM chunk),
cur AS (SELECT id, arg_max(sha1(coalesce(text,'')), (coalesce(epoch_us(indexed_at), -9223372036854775807), chunk_no)) AS sig FROM chunk WHERE id IS NOT NULL AND chunk_no % 10 <> 0 GROUP BY id),
old AS (SELECT id, arg_min(sha1(coalesce(text,'') || CASE WHEN chunk_no % 10 = 1 THEN ' (draft)' ELSE '' END), (epoch_us(indexed_at), chunk_no)) AS sig FROM chunk, mid WHERE id IS NOT NULL AND epoch_us(indexed_at) < mid.us GROUP BY id)"""


@query(
    f"""WITH {_HALVES} SELECT coalesce(c.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN c.sig IS NOT DISTINCT FROM o.sig THEN 'unchanged' ELSE 'changed' END AS state FROM cur c FULL JOIN old o ON c.id = o.id"""
)
def manifest_diff(s: SparkSession, d: str) -> DataFrame:
    cur, old = _halves(s, d)
    return incremental.manifest_diff(cur, old, "id")


@query(f"WITH {_HALVES} SELECT id, sig FROM cur UNION ALL SELECT id, sig FROM old WHERE id NOT IN (SELECT id FROM cur)")
def upsert_chunks(s: SparkSession, d: str) -> DataFrame:
    cur, old = _halves(s, d)
    return incremental.upsert(old, cur, "id")


@query(f"WITH {_HALVES} SELECT id, sig FROM old WHERE id IN (SELECT id FROM cur)")
def delete_chunks(s: SparkSession, d: str) -> DataFrame:
    """The older index without the ids that were removed since."""
    cur, old = _halves(s, d)
    gone = incremental.manifest_diff(cur, old, "id").where("state = 'removed'")
    return incremental.delete(old, gone, "id")


@query("SELECT chunk_no FROM chunk WHERE ticket_id IN (SELECT ticket_id FROM ticket WHERE trim(coalesce(ticket_id,'')) <> '' AND status IS NULL)")
def fetch_by_ticket(s: SparkSession, d: str) -> DataFrame:
    return incremental.fetch(table(s, d, "chunk"), table(s, d, "ticket").where("status is null"), "ticket_id").select("chunk_no")


@query(
    """WITH e AS (SELECT DISTINCT space_key, art_no FROM booking_spot_deal WHERE space_key IS NOT NULL), p AS (SELECT DISTINCT space_key, art_no FROM chunk)
    SELECT e.space_key, count(*) AS expected, count(p.art_no) AS present, count(*) - count(p.art_no) AS missing FROM e LEFT JOIN p ON e.space_key = p.space_key AND e.art_no = p.art_no GROUP BY e.space_key"""
)
def completeness_audit(s: SparkSession, d: str) -> DataFrame:
    return incremental.completeness(table(s, d, "booking_spot_deal").where("space_key is not null"), table(s, d, "chunk"), ["space_key"], "art_no")


@query("SELECT product, count(*) AS articles FROM booking_spot_deal GROUP BY ROLLUP (product)")
def product_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "booking_spot_deal").rollup("product").agg(F.count(F.lit(1)).alias("articles"))


@query(
    """WITH u AS (SELECT lower(trim(title)) AS k, product AS v, 0 AS s FROM booking_spot_deal UNION ALL SELECT lower(trim(title)), product, 1 FROM chunk UNION ALL SELECT lower(trim(title)), product, 2 FROM ticket)
    SELECT k AS title, arg_max(v, (s, v)) FILTER (v IS NOT NULL) AS product, min(s)::int AS first_source FROM u WHERE k IS NOT NULL AND v IS NOT NULL GROUP BY k"""
)
def retry_candidates(s: SparkSession, d: str) -> DataFrame:
    k = F.lower(F.trim("title"))
    parts = [table(s, d, t).select(k.alias("title"), "product").where("title is not null and product is not null") for t in ("booking_spot_deal", "chunk", "ticket")]
    return incremental.retry_candidates(parts, "title", "product")


@query("SELECT DISTINCT url FROM (SELECT url FROM booking_spot_deal UNION ALL SELECT url FROM chunk)")
def state_replay(s: SparkSession, d: str) -> DataFrame:
    return incremental.replay(table(s, d, "booking_spot_deal"), table(s, d, "chunk"), "url")


@query("SELECT * EXCLUDE n FROM (SELECT url, art_no, row_number() OVER (PARTITION BY url ORDER BY art_no) AS n FROM booking_spot_deal WHERE url IS NOT NULL) WHERE n = 1")
def url_dedup(s: SparkSession, d: str) -> DataFrame:
    return ret.first_per(table(s, d, "booking_spot_deal").where("url is not null").select("url", "art_no"), ["url"], [F.col("art_no")])


# ---------------------------------------------------------------- usage and reports


@query(
    """SELECT chat_id, (sum(coalesce(tokens_in,0)) // nullif(count_if(coalesce(tokens_in,0)+coalesce(tokens_out,0)>0),0))::bigint AS mean_in, (sum(coalesce(tokens_out,0)) // nullif(count_if(coalesce(tokens_in,0)+coalesce(tokens_out,0)>0),0))::bigint AS mean_out FROM usage_log GROUP BY chat_id"""
)
def usage_averages(s: SparkSession, d: str) -> DataFrame:
    u = reports.usage(table(s, d, "usage_log"), None, "chat_id")
    mean = lambda c: F.floor(F.try_divide(F.col(c), F.col("total_queries"))).cast("bigint")
    return u.select("chat_id", mean("total_in").alias("mean_in"), mean("total_out").alias("mean_out"))


#: Stand-in rates per million tokens in and out; ``gateway-mid`` has none on purpose, so unknown models cost nothing.
RATES = [("local-small", 0.2, 1.0), ("local-large", 2.0, 10.0)]


@query(
    """WITH r(m, i, o) AS (VALUES ('local-small', 0.2::double, 1.0::double), ('local-large', 2.0::double, 10.0::double))
    SELECT log_id, round((coalesce(tokens_in,0) * coalesce(i, 0) + coalesce(tokens_out,0) * coalesce(o, 0)) / 1e6, 9) AS cost FROM usage_log LEFT JOIN r ON lower(trim(model)) = r.m"""
)
def usage_cost(s: SparkSession, d: str) -> DataFrame:
    rates = s.createDataFrame(RATES, "model string, rate_in double, rate_out double")
    return reports.cost(table(s, d, "usage_log"), F.broadcast(rates)).select("log_id", F.round("cost", 9).alias("cost"))


@query(
    """WITH l AS (SELECT *, epoch_us(ts) >= (SELECT max(epoch_us(ts)) // 86400000000 * 86400000000 FROM usage_log) AS new, coalesce(tokens_in,0) AS i, coalesce(tokens_out,0) AS o FROM usage_log)
    SELECT coalesce(sum(i),0)::bigint AS total_in, coalesce(sum(o),0)::bigint AS total_out, count_if(i + o > 0)::bigint AS total_queries,
    coalesce(sum(i) FILTER (new),0)::bigint AS session_in, coalesce(sum(o) FILTER (new),0)::bigint AS session_out, count_if(i + o > 0 AND coalesce(new, false))::bigint AS session_queries FROM l"""
)
def usage_summary(s: SparkSession, d: str) -> DataFrame:
    """In all and in the session, which is the last day (UTC) of the log."""
    log = table(s, d, "usage_log")
    last = log.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_last")).select(F.timestamp_micros(F.expr("_last div 86400000000 * 86400000000")).alias("_since"))
    return reports.usage(log.crossJoin(F.broadcast(last)), F.col("_since"))


@query(
    """SELECT log_id, round(avg(CASE WHEN coalesce(latency_ms,0) > 5000 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY chat_id ORDER BY ts NULLS FIRST, log_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS failure_share FROM usage_log"""
)
def sliding_failures(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "usage_log").withColumn("failed", F.coalesce(F.col("latency_ms") > 5000, F.lit(False)))
    return incremental.running_failure_share(log, "chat_id", ["ts", "log_id"], "failed").select("log_id", "failure_share")


@query(
    """SELECT log_id, coalesce(lag(x) OVER w >= 0.85 AND x < 0.20, false) AS drift FROM (SELECT log_id, chat_id, ts, coalesce(latency_ms, 0) % 1000 / 1000.0 AS x FROM usage_log) WINDOW w AS (PARTITION BY chat_id ORDER BY ts NULLS FIRST, log_id)"""
)
def topic_drift(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "usage_log").withColumn("score", F.coalesce("latency_ms", F.lit(0)) % 1000 / 1000.0)  # a stand-in score: the log has none
    return conversation.drift(log, "chat_id", ["ts", "log_id"], "score").select("log_id", "drift")


@query("SELECT chat_id, log_id FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, ts ORDER BY log_id) AS n FROM usage_log) WHERE n = 1")
def exactly_once(s: SparkSession, d: str) -> DataFrame:
    return ret.first_per(table(s, d, "usage_log").select("chat_id", "ts", "log_id"), ["chat_id", "ts"], [F.col("log_id")]).select("chat_id", "log_id")


@query("SELECT retrieved_chunk, count(*) AS attempts, max(coalesce(latency_ms < 3000, false)) AS ok, count(*) > 1 AS retried, NOT max(coalesce(latency_ms < 3000, false)) AND count(*) >= 3 AS exhausted FROM usage_log GROUP BY retrieved_chunk")
def attempt_audit(s: SparkSession, d: str) -> DataFrame:
    return incremental.attempts(table(s, d, "usage_log").withColumn("ok", F.coalesce(F.col("latency_ms") < 3000, F.lit(False))), "retrieved_chunk", "ok")


@query("SELECT model, count(*) AS total, count_if(latency_ms > 5000) AS failed, count_if(latency_ms > 5000) > greatest(50, count(*) // 10) AS alert FROM (SELECT lower(trim(model)) AS model, latency_ms FROM usage_log) GROUP BY model")
def failure_alert(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "usage_log").groupBy(F.lower(F.trim("model")).alias("model")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("latency_ms") > 5000).alias("failed"))
    return g.withColumn("alert", reports.alert(F.col("failed"), F.col("total")))


@query("SELECT chat_id, max(ts) AS last_put FROM usage_log WHERE ts IS NOT NULL GROUP BY chat_id ORDER BY max(ts) DESC, chat_id LIMIT 2000")
def cache_eviction(s: SparkSession, d: str) -> DataFrame:
    return incremental.newest_cached(table(s, d, "usage_log").where("ts is not null").select("chat_id", F.col("ts").alias("last_put")), "chat_id", "last_put", 2000)


@query("SELECT product, count_if(kind = 'article') AS article, count_if(kind = 'ticket') AS ticket FROM chunk GROUP BY product")
def section_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk").groupBy("product").agg(F.count_if(F.col("kind") == "article").alias("article"), F.count_if(F.col("kind") == "ticket").alias("ticket"))


_VERSION_SQL = r"SELECT doc_id, regexp_extract(coalesce(text,''), '\d+\.\d+(?:\.\d+)+') AS version FROM documents"


@query(
    f"""SELECT DISTINCT version, array_to_string(list_transform(list_transform(string_split(version, '.'), lambda x: x::int), lambda x: lpad(x::varchar, 9, '0')), '.') AS sort_key FROM ({_VERSION_SQL}) WHERE version <> ''"""
)
def version_order(s: SparkSession, d: str) -> DataFrame:
    """Versions from the newest down, with a key that sorts as text; a range-partitioned sort."""
    v = table(s, d, "documents").select(X.version(F.col("text")).alias("version")).where("version <> ''").distinct()
    key = F.array_join(F.transform(X.version_key(F.col("version")), lambda n: F.lpad(n.cast("string"), 9, "0")), ".")
    return v.withColumn("sort_key", key).orderBy(F.desc("sort_key"))


@query(
    f"""WITH v AS (SELECT version, count(*) AS n, list_transform(string_split(version, '.'), lambda x: x::int) AS k FROM ({_VERSION_SQL}) WHERE version <> '' GROUP BY version)
    SELECT version, n FROM v ORDER BY k DESC LIMIT 10"""
)
def index_head(s: SparkSession, d: str) -> DataFrame:
    """The ten newest versions, as the master index shows them."""
    v = table(s, d, "documents").select(X.version(F.col("text")).alias("version")).where("version <> ''").groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    return v.orderBy(X.version_key(F.col("version")).desc()).limit(10)


PRODUCT_ORDER = {p: i for i, p in enumerate(("tradedesk", "web2", "web4", "api", "saleshub", "formflow", "other"))}


_PLACE = "CASE product " + " ".join(f"WHEN '{p}' THEN {i}" for p, i in PRODUCT_ORDER.items()) + f" ELSE {len(PRODUCT_ORDER)} END"


@query(
    f"""SELECT art_no, {_PLACE} AS product_order, row_number() OVER (PARTITION BY {_PLACE} ORDER BY coalesce(space_name,''), coalesce(title,''), art_no)::int AS place,
    '| ' || replace(coalesce(title,''), '|', '\\|') || ' | ' || replace(coalesce(space_name,''), '|', '\\|') || ' | ' || coalesce(url,'') || ' |' AS line FROM booking_spot_deal"""
)
def kb_index(s: SparkSession, d: str) -> DataFrame:
    """Every article with its place: products in the index's order, those without a place there last, then space and title."""
    rows = reports.index_rows(table(s, d, "booking_spot_deal"), PRODUCT_ORDER, "product", F.col("space_name"), F.col("title"), F.col("url"))
    return reports.placed(rows, "product_order", [F.coalesce("space_name", F.lit("")), F.coalesce("title", F.lit("")), F.col("art_no")]).select("art_no", "product_order", "place", "line")


@query(
    """SELECT user_id, event_id, CASE WHEN dt > 0 THEN round((n - 1) / dt * 60, 6) ELSE 0.0 END AS pace FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 - first_value(epoch_us(ts) / 1e6) OVER w AS dt, count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))"""
)
def pace(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("done", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return reports.pace(e, "user_id", "ts", "done").select("user_id", "event_id", "pace")


# ---------------------------------------------------------------- conversations: a ticket's comments as turns


def _turns(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "ticket").select("rec_id", F.posexplode("comments").alias("turn", "c")).where("c is not null")
    return t.select("rec_id", "turn", F.when(F.coalesce("c.internal", F.lit(False)), "assistant").otherwise("user").alias("role"), F.col("c.body").alias("content"))


_TURNS = "turns AS (SELECT rec_id, turn, CASE WHEN coalesce(c.internal, false) THEN 'assistant' ELSE 'user' END AS role, c.body AS content FROM (SELECT rec_id, unnest(comments) AS c, generate_subscripts(comments, 1) - 1 AS turn FROM ticket) WHERE c IS NOT NULL)"


@query(f"WITH {_TURNS} SELECT rec_id, turn::int AS turn, role FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY turn DESC) AS n FROM turns) WHERE n <= 12 AND role IN ('user', 'assistant')")
def turn_history(s: SparkSession, d: str) -> DataFrame:
    return conversation.history(_turns(s, d), "rec_id", "turn").select("rec_id", "turn", "role")


@query(f"WITH {_TURNS} SELECT rec_id, last(content ORDER BY turn) FILTER (role = 'user') AS last_question, last(role ORDER BY turn) AS last_role FROM turns GROUP BY rec_id")
def last_turns(s: SparkSession, d: str) -> DataFrame:
    return conversation.latest(_turns(s, d), "rec_id", "turn", "content")


@query(f"WITH {_TURNS} SELECT rec_id, turn::int AS turn, max(CASE WHEN regexp_matches(lower(coalesce(content,'')), 'deal') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS recent FROM turns")
def recent_mention(s: SparkSession, d: str) -> DataFrame:
    flag = F.lower(F.coalesce("content", F.lit(""))).contains("deal")
    return conversation.recent_mention(_turns(s, d), "rec_id", ["turn"], flag).select("rec_id", "turn", "recent")


@query(
    rf"""WITH {_TURNS}, p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN coalesce(content,'') END IGNORE NULLS) OVER w AS prev, coalesce(last_value(CASE WHEN role = 'assistant' THEN regexp_matches(coalesce(content,''), '\?\s*$') END IGNORE NULLS) OVER w, false) AS asked,
    trim(regexp_replace(coalesce(content,''), '\s+', ' ', 'g')) AS t FROM turns WINDOW w AS (PARTITION BY rec_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT rec_id, turn::int AS turn, CASE WHEN coalesce(prev,'') <> '' AND (asked OR (CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END) < 5) THEN prev || ' ' || coalesce(content,'') ELSE coalesce(content,'') END AS search_query FROM p WHERE role = 'user'"""
)
def query_fusion(s: SparkSession, d: str) -> DataFrame:
    """What each user turn is searched with. Comments have no kinds, so an assistant's turn that ends in a question mark stands for a clarification."""
    asked = F.coalesce("content", F.lit("")).rlike(r"\?\s*$")
    return conversation.fused_query(_turns(s, d), "rec_id", ["turn"], "content", asked).select("rec_id", "turn", "search_query")


_TITLES = rf"""q AS (SELECT rec_id, turn, role, trim(regexp_replace(coalesce(content,''), '\s+', ' ', 'g')) AS t, regexp_extract_all(coalesce(content,''), '(?i)(?:ticket|tickets|bug|incident|#)\s*#?\s*(\d{{3,7}})', 1)[1] AS ref FROM turns),
g AS (SELECT rec_id, arg_min(ref, turn) FILTER (role = 'user' AND ref IS NOT NULL) AS ref, arg_min(t, turn) FILTER (role = 'user' AND t <> '') AS t FROM q GROUP BY rec_id),
titles AS (SELECT rec_id, CASE WHEN ref IS NOT NULL THEN 'Ticket #' || ref WHEN t IS NULL THEN 'New chat' WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS title FROM g)"""


@query(f"WITH {_TURNS}, {_TITLES} SELECT rec_id, title FROM titles")
def auto_titles(s: SparkSession, d: str) -> DataFrame:
    return conversation.titles(_turns(s, d), "rec_id", "turn", "content")


@query(f"WITH {_TURNS}, {_TITLES} SELECT rec_id FROM turns WHERE contains(lower(coalesce(content,'')), 'settlement') UNION SELECT rec_id FROM titles WHERE contains(lower(title), 'settlement')")
def chat_search(s: SparkSession, d: str) -> DataFrame:
    """Chats with the word in their title or any turn."""
    return conversation.search(_turns(s, d), "rec_id", "turn", "content", "Settlement")


_POINTS_BACK = r"regexp_matches(coalesce(content,''), '(?i)(?:^|[^\p{L}\p{Nd}_])" + X.FOLLOW_UP_WORDS.removeprefix(r"(?i)\b").removesuffix(r"\b") + r"(?:[^\p{L}\p{Nd}_]|$)')"


@query(rf"WITH {_TURNS}, t AS (SELECT *, trim(regexp_replace(coalesce(content,''), '\s+', ' ', 'g')) AS t FROM turns) SELECT rec_id, turn::int AS turn, (CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END) < 5 OR {_POINTS_BACK} AS refers_back FROM t")
def follow_ups(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).select("rec_id", "turn", conversation.refers_back(F.col("content")).alias("refers_back"))


@query(
    """SELECT rec_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ', ') AS handled FROM (SELECT rec_id, list_filter(list_transform(
    list_concat(list_transform(list_filter(coalesce(comments, []), lambda c: c IS NOT NULL AND coalesce(c.internal, false)), lambda c: c.author), coalesce(list_transform(resolution.comments, lambda c: c.author), [])), lambda a: trim(a)),
    lambda a: a IS NOT NULL AND a <> '' AND lower(a) <> lower(trim(coalesce(created_by, '')))) AS l FROM ticket)"""
)
def handled_by(s: SparkSession, d: str) -> DataFrame:
    h = chunking.handled_by(F.filter("comments", lambda c: c.isNotNull()), F.col("resolution"), F.col("created_by"))
    return table(s, d, "ticket").select("rec_id", F.array_join(h, ", ").alias("handled"))


@query()
def known_terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ticket").select("rec_id", F.array_join(chunking.known_terms(F.col("comments"), F.col("resolution"), F.col("created_by"), F.col("assignee")), "|").alias("terms"))


# ---------------------------------------------------------------- evaluation and training records


@query(
    f"""WITH {_BM25}, a AS (SELECT query_id, list(DISTINCT coalesce(space_key, '')) AS src, string_agg(coalesce(text,''), ' ') AS answer FROM bm JOIN chunk ON chunk_no = doc_id WHERE rank <= 8 GROUP BY query_id),
    e AS (SELECT item_id, list_filter(coalesce(expected_sources, []), lambda x: x IS NOT NULL) AS s, list_filter(coalesce(expected_keypoints, []), lambda x: x IS NOT NULL) AS k, coalesce(src, []) AS src, lower(coalesce(answer,'')) AS a FROM eval_holdout LEFT JOIN a ON item_id = query_id),
    c AS (SELECT item_id, len(s) AS ns, len(k) AS nk, len(list_filter(s, lambda x: list_contains(src, x))) AS fs, len(list_filter(k, lambda x: contains(a, lower(x)))) AS fk FROM e)
    SELECT item_id, CASE WHEN ns > 0 AND fs = 0 THEN 0.0 ELSE round(0.5 * CASE WHEN ns > 0 THEN fs / ns::double ELSE 1.0 END + 0.5 * CASE WHEN nk > 0 THEN fk / nk::double ELSE 1.0 END, 4) END AS accuracy FROM c"""
)
def eval_accuracy(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunk").select(F.col("chunk_no").alias("doc_id"), "text", "space_key")
    got = _bm25(s, d, 8).join(chunks, "doc_id").groupBy(F.col("query_id").alias("item_id")).agg(F.collect_set(F.coalesce("space_key", F.lit(""))).alias("found_sources"), F.concat_ws(" ", F.collect_list("text")).alias("answer"))
    cases = table(s, d, "eval_holdout").join(got, "item_id", "left").withColumn("found_sources", F.coalesce("found_sources", F.array().cast("array<string>")))
    return reports.eval_accuracy(cases).select("item_id", "accuracy")


@query(
    """WITH r AS (SELECT chat_id, lower(trim(model)) AS run, list(DISTINCT retrieved_chunk) FILTER (retrieved_chunk IS NOT NULL) AS src FROM usage_log WHERE model IS NOT NULL AND chat_id IS NOT NULL GROUP BY ALL), n AS (SELECT chat_id, run, coalesce(src, []) AS src FROM r),
    p AS (SELECT a.chat_id, avg(CASE WHEN len(list_distinct(list_concat(a.src, b.src))) = 0 THEN 1.0 ELSE len(list_intersect(a.src, b.src)) / len(list_distinct(list_concat(a.src, b.src)))::double END) AS x FROM n a JOIN n b ON a.chat_id = b.chat_id AND a.run < b.run GROUP BY a.chat_id)
    SELECT c.chat_id, coalesce(round(x, 4), 1.0) AS stability FROM (SELECT DISTINCT chat_id FROM n) c LEFT JOIN p ON c.chat_id = p.chat_id"""
)
def source_stability(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "usage_log").where("model is not null and chat_id is not null").groupBy("chat_id", F.lower(F.trim("model")).alias("run")).agg(F.collect_set("retrieved_chunk").alias("src"))
    return reports.stability(runs, "chat_id", "run", "src")


_REFUSALS = ["cannot", "not able to"]


@query("SELECT product, round(avg(CASE WHEN trim(coalesce(text,'')) = '' OR contains(lower(trim(coalesce(text,''))), 'cannot') OR contains(lower(trim(coalesce(text,''))), 'not able to') THEN 1.0 ELSE 0.0 END), 6) AS safety FROM ticket GROUP BY product")
def abstain_safety(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ticket").groupBy("product").agg(F.round(F.avg(reports.refused(F.col("text"), _REFUSALS).cast("double")), 6).alias("safety"))


@query()
def holdout_split(s: SparkSession, d: str) -> DataFrame:
    return reports.holdout(table(s, d, "ticket").select("rec_id"), "rec_id", 500)


@query()
def training_examples(s: SparkSession, d: str) -> DataFrame:
    """Records of system, user and assistant messages from resolved tickets, scrubbed."""
    t = table(s, d, "ticket").withColumn("_t", chunking.known_terms(F.col("comments"), F.col("resolution"), F.col("created_by"), F.col("assignee")))
    t = t.select("rec_id", chunking.problem_text(F.col("comments"), F.col("title"), F.col("_t")).alias("p"), chunking.resolution_text(F.col("comments"), F.col("resolution"), F.col("_t")).alias("r")).where("p <> '' and r <> ''")
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), R.scrub(c).alias("content"))
    return t.select("rec_id", F.to_json(F.struct(F.array(msg("system", F.lit("Answer from the given context.")), msg("user", F.col("p")), msg("assistant", F.col("r"))).alias("messages"))).alias("record"))


# ---------------------------------------------------------------- sinks and state


@query()
def ticket_markdown(s: SparkSession, d: str) -> DataFrame:
    return sinks.ticket_markdown(table(s, d, "ticket"))


@query()
def article_markdown(s: SparkSession, d: str) -> DataFrame:
    spaces = table(s, d, "kb_space").select("space_key", "lib_folder")
    return sinks.article_markdown(table(s, d, "booking_spot_deal").join(spaces, "space_key", "left"))


@query()
def adaptive_gate(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "usage_log").withColumn("ok", F.coalesce(F.col("latency_ms") < 5000, F.lit(False)))
    return gate_log(log, "chat_id", "log_id", "ok")


@query("SELECT chat_id, session_start AS start, count(*) AS n FROM (SELECT chat_id, time_bucket(INTERVAL '10 minutes', ts) AS session_start FROM usage_log WHERE ts IS NOT NULL) GROUP BY ALL")
def usage_windows(s: SparkSession, d: str) -> DataFrame:
    """Extension: turns per chat and ten minutes."""
    g = table(s, d, "usage_log").where("ts is not null").groupBy("chat_id", F.window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("chat_id", F.col("w.start").alias("start"), "n")


@query("SELECT substr(sha1(coalesce(product,'') || ':' || coalesce(title,'')), 1, 16) AS name, product, title FROM ticket")
def learned_entries(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "ticket").select("product", "title", F.col("category").alias("topic"), F.col("text").alias("answer"))
    return sinks.learned_entry(t).select("name", "product", "title")


# ---------------------------------------------------------------- extensions on the star schema, no parity claims


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"""
)
def ext_pricing_summary(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").where("l_shipdate <= date'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def ext_region_revenue(s: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- from hits to answers


def _context(s: SparkSession, d: str, k: int = 8, hits: DataFrame | None = None) -> DataFrame:
    c = table(s, d, "chunk").select(F.col("chunk_no").alias("doc_id"), "kind", "ticket_id", "title", "url", "product", "category", "text", F.col("indexed_at").cast("string").alias("created_at"))
    return (_bm25(s, d, ret.TOP_K) if hits is None else hits).drop("score").join(c, "doc_id").where(F.col("rank") <= k)


@query(
    f"""WITH {_BM25}, c AS (SELECT query_id, doc_id, rank, ticket_id FROM bm JOIN chunk ON chunk_no = doc_id WHERE rank <= 8)
    SELECT query_id, doc_id FROM c WHERE ticket_id IS NULL UNION ALL SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ticket_id ORDER BY rank) AS n FROM c WHERE ticket_id IS NOT NULL) WHERE n = 1"""
)
def expand_tickets(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk").where("kind = 'ticket' and ticket_id is not null and chunk_index is not null").select("ticket_id", "chunk_index", "text").distinct()
    return answering.expand_tickets(_context(s, d), c).select("query_id", "doc_id")


@query(
    f"""WITH {_BM25}, hq AS (SELECT query_id, doc_id, rank, kind, url FROM bm JOIN chunk ON chunk_no = doc_id), c AS (SELECT * FROM hq WHERE rank <= 8),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hq WHERE kind = 'article' AND trim(url) <> '' AND query_id NOT IN (SELECT query_id FROM c WHERE kind = 'article') AND query_id IN (SELECT query_id FROM c))
    SELECT query_id, doc_id FROM c UNION ALL SELECT query_id, doc_id FROM b WHERE n = 1"""
)
def ensure_article(s: SparkSession, d: str) -> DataFrame:
    quick = cut(_context(s, d, ret.TOP_K))  # the context is its head
    return answering.ensure_kind(quick.where("rank <= 8"), quick, "article", F.trim("url") != "").select("query_id", "doc_id")


_CITE = """CASE WHEN kind = 'ticket' THEN 'Ticket #' || coalesce(ticket_id,'') || ' · ' || pd ELSE pd || ' · ' || coalesce(nullif(category,''),'general') || ' · ' || coalesce(title,'') END"""
_DISPLAY = "CASE coalesce(product,'') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in products.DISPLAY.items()) + " ELSE coalesce(product,'') END"
_CONTEXT = f"""hq AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, coalesce(url,'') AS url, coalesce(text,'') AS text, {_CITE} AS label FROM (SELECT *, {_DISPLAY} AS pd FROM bm JOIN chunk ON chunk_no = doc_id WHERE rank <= 8)),
ctx AS (SELECT query_id, count(*)::int AS n_entries, 'CONTEXT (the only facts you may use):' || chr(10) || chr(10) || string_agg(n || '. ' || CASE WHEN url <> '' THEN '[' || label || '](' || url || ')' ELSE '[' || label || ']' END || chr(10) || '   ' || text || chr(10), chr(10) ORDER BY n) AS context FROM hq GROUP BY query_id)"""


@query(f"WITH {_BM25}, {_CONTEXT} SELECT query_id, n_entries, context FROM ctx")
def context_text(s: SparkSession, d: str) -> DataFrame:
    return answering.context_text(_context(s, d))


@query(
    rf"""WITH {_BM25}, {_CONTEXT}, have AS (SELECT query_id, list(DISTINCT url) AS urls FROM hq WHERE rank <= 4 GROUP BY query_id),
    c AS (SELECT query_id, context, coalesce(urls, []) AS urls, regexp_extract_all(context, '{X.CITATION}', 0) AS raws, regexp_extract_all(context, '{X.CITATION}', 2) AS cited FROM ctx LEFT JOIN have USING (query_id)),
    v AS (SELECT *, list_filter(raws, lambda x, i: NOT list_contains(urls, cited[i])) AS bad FROM c)
    SELECT query_id, (len(raws) - len(bad))::int AS n_verified, len(bad)::int AS n_unverified, len(bad) = 0 AS all_verified, md5(list_reduce(list_prepend(context, bad), lambda a, x: replace(a, x, '[unverified]'))) AS text_md5 FROM v"""
)
def citation_validate(s: SparkSession, d: str) -> DataFrame:
    """Citations of answers against what was retrieved. As answers the contexts of eight entries stand in, of which only the first
    four count as retrieved, so both outcomes occur."""
    hits = cut(_context(s, d))
    answers = answering.context_text(hits).select("query_id", F.col("context").alias("answer"))
    got = answering.validate_citations(answers, hits.where("rank <= 4").select("query_id", "url"))
    return got.select("query_id", F.size("verified").alias("n_verified"), F.size("unverified").alias("n_unverified"), "all_verified", F.md5("stripped_text").alias("text_md5"))


@query()
def related_tickets(s: SparkSession, d: str) -> DataFrame:
    """The tickets like the first ticket of each context, by a search of their own (BM25, as chunks have no vectors)."""
    c = table(s, d, "chunk")
    counts = cut(ret.term_counts(spread(c)))  # both searches are over the same corpus
    context = cut(_context(s, d, hits=_bm25(s, d, 8, counts)))
    hits = ret.bm25_topk(c, cut(answering.ticket_seeds(context)), answering.SEED_K, doc_id="chunk_no", counts=counts)
    rows = c.where("kind = 'ticket'").select(F.col("chunk_no").alias("doc_id"), "ticket_id", F.col("indexed_at").cast("string").alias("created_at"))
    return answering.related_tickets(context, hits.join(rows, "doc_id"))


_SHOWN = "CASE coalesce(product,'') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in products.DISPLAY.items()) + " ELSE '' END"
_SUGGESTED = f"""sh AS (SELECT query_id, rank, doc_id, coalesce(title,'') AS title, url, coalesce(category,'') AS category, {_SHOWN} AS shown FROM bm JOIN chunk ON chunk_no = doc_id WHERE coalesce(url,'') <> ''),
so AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY rank) AS n FROM sh) WHERE n = 1),
sug AS (SELECT query_id, string_agg('• [' || title || '](' || url || ')  — ' || shown || ' · ' || category, chr(10) ORDER BY rank) AS suggestions FROM so GROUP BY query_id)"""


@query(f"WITH {_BM25}, {_SUGGESTED} SELECT query_id, suggestions FROM sug")
def suggestion_lists(s: SparkSession, d: str) -> DataFrame:
    return answering.suggestions(_context(s, d, ret.TOP_K))


@query()
def turn_decisions(s: SparkSession, d: str) -> DataFrame:
    """The kind of turn each held-out question would get."""
    hits = cut(_bm25(s, d))  # one search for the three things that are read off it
    top = _reranked(s, d, hits).groupBy("query_id").agg(F.max("score").alias("score"))
    q = table(s, d, "eval_holdout").select(F.col("item_id").alias("query_id"), "question", "product")
    rows = q.join(top, "query_id", "left").join(_dominance(s, d, hits).select("query_id", "clarify"), "query_id", "left").join(answering.suggestions(_context(s, d, ret.TOP_K, hits)), "query_id", "left")
    short = F.size(X.words(F.col("question"))) < X.SHORT_LIMIT
    kind = answering.decision(F.coalesce("score", F.lit(0.0)), F.coalesce("clarify", F.lit(False)), F.col("product").isNotNull(), short, F.col("suggestions").isNotNull())
    return rows.select("query_id", kind.alias("kind"))
