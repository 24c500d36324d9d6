"""Queries of the smaller operators: names, gates over records, evaluation means, listings, work-lists, release library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import evaluation, incremental, library, portal, products
from tarn.plans.reference import ORACLES as _SEEN
from tarn.sources.tables import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        assert f.__name__ not in _SEEN
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _case(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


# ---------------------------------------------------------------- names


@query(f"SELECT rec_id, {_case('lower(trim(product))', products.PROJECTS, repr('other'))} AS product FROM ticket")
def ticket_products(s: SparkSession, d: str) -> DataFrame:
    """The product a ticket's project stands for."""
    return table(s, d, "ticket").select("rec_id", products.of_project(F.col("product")).alias("product"))


@query(f"SELECT chunk_no, {_case('lower(trim(product))', products.SYNONYMS, 'NULL')} AS slug, {_case('product', products.DISPLAY, 'coalesce(product, ' + repr('') + ')')} AS shown FROM chunk")
def product_names(s: SparkSession, d: str) -> DataFrame:
    """The slug of each chunk's product as typed, and its display name as stored."""
    return table(s, d, "chunk").select("chunk_no", products.resolve(F.col("product")).alias("slug"), products.display(F.col("product")).alias("shown"))


#: Stand-in providers of the log's models.
MODELS = {"local": ["local-small", "local-large"], "gateway": ["gateway-mid", "local-large"]}


@query("SELECT log_id, CASE lower(trim(model)) WHEN 'local-small' THEN 'local' WHEN 'local-large' THEN 'local' WHEN 'gateway-mid' THEN 'gateway' END AS provider FROM usage_log")
def model_providers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").select("log_id", products.provider_of(F.lower(F.trim("model")), MODELS).alias("provider"))


# ---------------------------------------------------------------- gates over records


_LEAK_SQL = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?:^|[^0-9])(?:\+?\d{1,2}[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?:[^0-9]|$)"),
    ("secret", r"\b(?:sk-[A-Za-z0-9\-]{16,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|gh[pousr]_[A-Za-z0-9]{20,})\b"),
    ("password", r"(?i)\bpassword\s*[:=]\s*[^\[\s]"),
]


@query(
    "WITH m AS (SELECT rec_id, 0 AS message_no, body AS content FROM ticket UNION ALL SELECT rec_id, n, c.body FROM (SELECT rec_id, unnest(comments) AS c, generate_subscripts(comments, 1) AS n FROM ticket)) "
    + " UNION ALL ".join(f"SELECT rec_id, message_no::int AS message_no, '{kind}' AS category, substr(content, 1, 80) AS head FROM m WHERE regexp_matches(coalesce(content,''), '{rx}')" for kind, rx in _LEAK_SQL)
)
def scan_records(s: SparkSession, d: str) -> DataFrame:
    """Leaks in records of messages: each ticket's opening message and comments."""
    t = table(s, d, "ticket")
    return evaluation.scan_records(t.select("rec_id", F.concat(F.array("body"), F.coalesce(F.transform("comments", lambda c: c["body"]), F.array().cast("array<string>"))).alias("messages")), "rec_id", "messages")


# ---------------------------------------------------------------- evaluation


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Stand-in runs of cases: the tickets of an id are one case, each scraping of it a run with its text as the answer."""
    t = table(s, d, "ticket").where("trim(ticket_id) <> '' and text is not null")
    return t.select(F.col("ticket_id").alias("case_id"), F.col("rec_id").alias("run"), F.substring("text", 1, 400).alias("answer"))


@query()
def answer_stability(s: SparkSession, d: str) -> DataFrame:
    """How alike the answers of a case's runs are; cases with one run are stable."""
    return evaluation.answer_stability(_runs(s, d), "case_id", "run", "answer")


@query(
    """WITH a AS (SELECT chat_id, lower(trim(model)) AS model, count_if(latency_ms < 3000) / count(*)::double AS accuracy, count_if(coalesce(tokens_out,0) = 0) AS refused, count(*) AS n FROM usage_log WHERE trim(model) <> '' GROUP BY ALL)
    SELECT model, coalesce(round(avg(accuracy), 4), 0.0) AS accuracy, round(sum(refused) / sum(n)::double, 4) AS abstain_safety FROM a GROUP BY model"""
)
def model_scores(s: SparkSession, d: str) -> DataFrame:
    """Per model the mean accuracy over cases and the share of refusals. Stand-ins: a chat is a case, its quick answers are right,
    answers without tokens are refusals."""
    log = table(s, d, "usage_log").where("trim(model) <> ''").withColumn("model", F.lower(F.trim("model")))
    cases = log.groupBy("model", "chat_id").agg((F.count_if(F.col("latency_ms") < 3000) / F.count(F.lit(1))).alias("accuracy"))
    unsupported = log.select("model", (F.coalesce("tokens_out", F.lit(0)) == 0).alias("safe"))
    return evaluation.model_scores(cases, unsupported)


@query("SELECT round(avg(x), 3) AS accuracy, round(avg(y), 3) AS other, count(*) AS n FROM (SELECT chat_id, count_if(latency_ms < 3000) / count(*)::double AS x, count_if(latency_ms >= 3000) / count(*)::double AS y FROM usage_log GROUP BY chat_id)")
def eval_means(s: SparkSession, d: str) -> DataFrame:
    cases = table(s, d, "usage_log").groupBy("chat_id").agg((F.count_if(F.col("latency_ms") < 3000) / F.count(F.lit(1))).alias("accuracy"), (F.count_if(F.col("latency_ms") >= 3000) / F.count(F.lit(1))).alias("other"))
    return evaluation.means(cases, ["accuracy", "other"])


# ---------------------------------------------------------------- spaces, families, work-lists


@query(
    """WITH n AS (SELECT space_key, count(*) AS n FROM booking_spot_deal GROUP BY space_key)
    SELECT k.space_key, k.display_name, coalesce(n, 0) AS articles, coalesce(n, 0) > 0 AS ok, bool_and(coalesce(n, 0) > 0) OVER () AS passed FROM kb_space k LEFT JOIN n ON k.space_key = n.space_key"""
)
def validate_spaces(s: SparkSession, d: str) -> DataFrame:
    return incremental.validate_groups(table(s, d, "kb_space").select("space_key", "display_name"), table(s, d, "booking_spot_deal"), "space_key", "articles")


@query("SELECT product_label, list(space_key ORDER BY space_key) AS spaces, count(*)::int AS n FROM kb_space GROUP BY product_label")
def product_groups(s: SparkSession, d: str) -> DataFrame:
    """The spaces of each product label; the table has no listing order, so the key gives it."""
    return library.families(table(s, d, "kb_space").select("product_label", "space_key"), "product_label", "space_key", "space_key")


@query(
    """SELECT coalesce(product_label, '') AS label, list(space_key || ':' || coalesce(display_name, '') || ':kb' ORDER BY space_key) AS members FROM kb_space GROUP BY ALL
    UNION ALL SELECT 'Release Notes', list(p || ':' || p || ':rn' ORDER BY p) FROM (SELECT DISTINCT product AS p FROM kb_space WHERE product IS NOT NULL)"""
)
def family_map(s: SparkSession, d: str) -> DataFrame:
    return library.family_map(table(s, d, "kb_space"))


@query("SELECT space_key || '|' || slug AS key FROM (SELECT DISTINCT space_key, trim(regexp_replace(lower(coalesce(title,'')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM booking_spot_deal WHERE space_key IS NOT NULL) WHERE slug <> ''")
def legacy_state(s: SparkSession, d: str) -> DataFrame:
    """The keys of a state kept as slugs by space, as it is flattened where no newer state is there."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    nested = table(s, d, "booking_spot_deal").where("space_key is not null").select("space_key", slug.alias("slug")).where("slug <> ''").groupBy("space_key").agg(F.collect_set("slug").alias("slugs"))
    return incremental.legacy_state(s.createDataFrame([], "key string"), nested, "space_key", "slugs")


@query(
    """WITH r AS (SELECT DISTINCT space_key, art_no FROM chunk WHERE art_no IS NOT NULL AND (coalesce(trim(text), '') = '' OR length(text) < 200))
    SELECT b.space_key, count(*) AS discovered FROM booking_spot_deal b WHERE EXISTS (SELECT 1 FROM r WHERE r.art_no = b.art_no AND r.space_key = b.space_key) GROUP BY b.space_key"""
)
def retry_worklist(s: SparkSession, d: str) -> DataFrame:
    """A work-list cut to the rows to retry (here, articles with an empty or very short chunk), and how many of each space are queued."""
    retry = table(s, d, "chunk").where("art_no is not null and (coalesce(trim(text), '') = '' or length(text) < 200)").select("space_key", "art_no")
    return incremental.worklist(table(s, d, "booking_spot_deal"), retry, ["space_key", "art_no"]).groupBy("space_key").agg(F.count(F.lit(1)).alias("discovered"))


@query(
    """WITH mid AS (SELECT min(epoch_us(indexed_at)) + (max(epoch_us(indexed_at)) - min(epoch_us(indexed_at))) // 2 AS us FROM chunk),
    o AS (SELECT id, arg_min(sha1(coalesce(text,'')), (epoch_us(indexed_at), chunk_no)) AS sig FROM chunk, mid WHERE id IS NOT NULL AND epoch_us(indexed_at) < mid.us GROUP BY id),
    c AS (SELECT id, arg_max(sha1(coalesce(text,'')), (coalesce(epoch_us(indexed_at), -9223372036854775807), chunk_no)) AS sig FROM chunk WHERE id IS NOT NULL AND chunk_no % 10 <> 0 GROUP BY id),
    f AS (SELECT coalesce(c.id, o.id) AS id, o.id IS NULL AS fresh, c.id IS NULL AS gone, c.sig IS NOT DISTINCT FROM o.sig AS same FROM c FULL JOIN o ON c.id = o.id)
    SELECT count_if(fresh OR (NOT gone AND NOT same)) AS embedded, count_if(gone OR (NOT fresh AND NOT same)) AS deleted, count_if(NOT fresh AND NOT gone AND same) AS unchanged, count_if(NOT gone) AS total FROM f"""
)
def ingest_report(s: SparkSession, d: str) -> DataFrame:
    """What a run of the index would do, by its diff."""
    c = table(s, d, "chunk").where("id is not null").withColumn("_us", F.unix_micros(F.col("indexed_at").cast("timestamp")))
    middle = table(s, d, "chunk").select(F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("_us")).agg(F.expr("min(_us) + (max(_us) - min(_us)) div 2").alias("_middle"))
    sig = F.sha1(F.coalesce("text", F.lit("")))
    old = c.join(F.broadcast(middle), F.col("_us") < F.col("_middle")).groupBy("id").agg(F.min_by(sig, F.struct("indexed_at", "chunk_no")).alias("sig"))
    cur = c.where("chunk_no % 10 <> 0").groupBy("id").agg(F.max_by(sig, F.struct("indexed_at", "chunk_no")).alias("sig"))
    return incremental.ingest_report(incremental.manifest_diff(cur, old, "id"))


# ---------------------------------------------------------------- answers and chats


@query(
    """SELECT log_id, chat_id, to_json({'kind': coalesce(kind,''), 'model': coalesce(model,''), 'tokens_in': coalesce(tokens_in,0), 'tokens_out': coalesce(tokens_out,0), 'latency_ms': coalesce(latency_ms,0)})::varchar AS debug,
    c.title AS source_title, c.url AS source_url FROM usage_log LEFT JOIN (SELECT chunk_no, coalesce(title,'') AS title, coalesce(url,'') AS url FROM chunk) c ON chunk_no = retrieved_chunk"""
)
def answer_payloads(s: SparkSession, d: str) -> DataFrame:
    """Each turn with the source it used and what it took."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    debug = F.to_json(F.struct(text("kind"), text("model"), zero("tokens_in"), zero("tokens_out"), zero("latency_ms")))
    sources = table(s, d, "chunk").select(F.col("chunk_no").alias("retrieved_chunk"), F.coalesce("title", F.lit("")).alias("source_title"), F.coalesce("url", F.lit("")).alias("source_url"))
    return table(s, d, "usage_log").join(sources, "retrieved_chunk", "left").select("log_id", "chat_id", debug.alias("debug"), "source_title", "source_url")


@query("SELECT chat_id, max(ts) AS updated, count(*) AS turns FROM usage_log WHERE chat_id IS NOT NULL GROUP BY chat_id")
def chat_list(s: SparkSession, d: str) -> DataFrame:
    """The chats, newest first."""
    return library.chat_list(table(s, d, "usage_log").where("chat_id is not null"), "chat_id", "ts")


# ---------------------------------------------------------------- release library


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Stand-in version records: an article is a version of its product, numbered by its id; its chunks are its items."""
    v = table(s, d, "booking_spot_deal").where("product is not null").select("art_no", "product", F.concat_ws(".", F.expr("art_no div 100"), F.expr("art_no % 100"), F.lit("0")).alias("version"), F.coalesce("url", F.lit("")).alias("url"))
    section = F.when(F.col("chunk_index") % 3 == 0, "enhancements").when(F.col("chunk_index") % 3 == 1, "bugs").otherwise("tasks")
    items = table(s, d, "chunk").where("art_no is not null").groupBy("art_no", section.alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return v.join(items, "art_no", "left")


_VERSIONS = """ver AS (SELECT art_no, product, (art_no // 100) || '.' || (art_no % 100) || '.0' AS version, coalesce(url,'') AS url FROM booking_spot_deal WHERE product IS NOT NULL),
cnt AS (SELECT v.product, v.version, v.url, v.art_no, count(c.chunk_no) FILTER (c.chunk_index % 3 = 0) AS e, count(c.chunk_no) FILTER (c.chunk_index IS NULL OR c.chunk_index % 3 NOT IN (0, 1)) AS t, count(c.chunk_no) FILTER (c.chunk_index % 3 = 1) AS b FROM ver v LEFT JOIN chunk c ON v.art_no = c.art_no GROUP BY ALL)"""


@query(
    f"""WITH {_VERSIONS} SELECT product, version, CASE WHEN e + t + b = 0 THEN 'no items extracted' ELSE array_to_string(list_filter([CASE WHEN e > 0 THEN e || ' enhancement(s)' END, CASE WHEN t > 0 THEN t || ' task(s)' END, CASE WHEN b > 0 THEN b || ' bug fix(s)' END], lambda x: x IS NOT NULL), ', ') END AS summary FROM cnt"""
)
def changelog(s: SparkSession, d: str) -> DataFrame:
    """What each version holds, in words."""
    return library.changelog(_versions(s, d)).select("product", "version", "summary")


@query(f"WITH {_VERSIONS} SELECT product, count(*) AS versions, greatest(count(*) - 10, 0) AS more FROM ver GROUP BY product")
def master_index(s: SparkSession, d: str) -> DataFrame:
    """Per product its versions, of which the index shows ten, and how many more there are."""
    return library.master_index(_versions(s, d).select("product", "version", "art_no").distinct()).select("product", "versions", "more")


# ---------------------------------------------------------------- portal pages


@query(
    r"""SELECT rec_id, nullif(trim(regexp_replace(coalesce(status,''), '\s+', ' ', 'g')), '') AS status, nullif(trim(regexp_replace(coalesce(organization,''), '\s+', ' ', 'g')), '') AS organization,
    nullif(trim(regexp_replace(coalesce(product,''), '\s+', ' ', 'g')), '') AS product FROM ticket"""
)
def portal_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields read back from ticket pages. As there are no pages among the tables, each ticket's is written here in the portal's markup."""
    plain = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    field = lambda label, c: F.concat(F.lit(f'<button class="floating-dropdown-btn"><span class="floating-dropdown-label">{label}<b>*</b></span><span class="floating-dropdown-value">'), plain(c), F.lit("</span></button>"))
    pages = table(s, d, "ticket").select("rec_id", F.lit("").alias("ticket_id"), F.lit("http://portal").alias("base"), F.concat(F.lit("<body><h1>Ticket</h1>"), field("Status", "status"), field("Organization", "organization"), field("Project", "product"), F.lit("</body>")).alias("html"))
    got = portal.ticket_records(pages)
    return got.select("rec_id", *(F.col("record.fields")[c].alias(c) for c in ("status", "organization", "product")))
