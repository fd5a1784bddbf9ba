"""Every operator as a query over the driver's tables, with the same result in SQL.

The tables stand in for a run's inputs: pages are hits and payloads, documents
are payloads, labels are verdicts, events are log lines, embeddings are hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DISCARD, AuditThresholds, CurationConfig
from ..functions import hashing, media, text, url, verdict
from ..operators import audit, decide, discovery, ledger, reports, similarity
from ..runtime import attach, global_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (read) by its name, with the SQL of its result."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            attach(spark)
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return wrap


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def category_counts(read):
    return reports.category_counts(read("documents"), "lang")


@query("SELECT source AS key, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, key LIMIT 10")
def discard_reasons_top10(read):
    docs = read("documents").select(F.lit(DISCARD).alias("category"), F.col("source").alias("model_name"))
    return reports.discard_reasons(docs, 10)


_RATE = "CASE WHEN total > 0 THEN concat((({0} * 2000 + total) // (total * 2)) // 10, '.', (({0} * 2000 + total) // (total * 2)) % 10, '%') ELSE '0.0%' END"


@query(f"""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE toxic <> 1) AS kept, count(*) FILTER (WHERE toxic = 1) AS discarded FROM labels)
SELECT total, kept, discarded, {_RATE.format('kept')} AS kept_rate, {_RATE.format('discarded')} AS discard_rate FROM c
""")
def kept_discard_rates(read):
    return reports.success_rates(read("labels").select(F.when(F.col("toxic") == 1, DISCARD).otherwise("other").alias("category")))


@query("""
SELECT concat('f', event_id) AS filepath, concat('u', event_id) AS url, event_type AS category, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at FROM events
WHERE event_id % 3 <> 0 AND event_type <> 'error' ORDER BY 4 DESC, event_id DESC LIMIT 50
""")
def newest_n(read):
    i = F.col("event_id")
    rows = read("events").select(
        i.alias("id"), F.concat(F.lit("u"), i).alias("url"), F.when(i % 3 != 0, F.concat(F.lit("f"), i)).alias("filepath"),
        F.when(F.col("event_type") == "error", DISCARD).otherwise(F.col("event_type")).alias("category"), text.iso_seconds(F.col("ts")).alias("created_at"),
    )
    return ledger.newest_kept(rows, 50)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def ledger_order(read):
    return global_rank(read("events").select("ts", "event_id"), [F.col("ts"), F.col("event_id")], "place").select("event_id", "place")


_SLUG = "left(coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'image'), 32)"


@query(f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents")
def slugify(read):
    return read("documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS winner, count(*) AS copies FROM documents GROUP BY 1")
def sha256_dedupe_winner(read):
    docs = read("documents").select(F.col("doc_id").alias("discovery_rank"), hashing.sha256_hex(F.col("text")).alias("sha256"))
    none = docs.limit(0).select("sha256", F.lit("").alias("category"), F.lit("").alias("model_name"))
    marked = decide.mark_copies(docs, none)
    return marked.groupBy("sha256").agg(F.min(F.when(~F.col("is_copy"), F.col("discovery_rank"))).alias("winner"), F.count("*").alias("copies"))


@query("""
SELECT doc_id, sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1
""")
def sha256_dedupe_losers(read):
    docs = read("documents").select(F.col("doc_id").alias("discovery_rank"), hashing.sha256_hex(F.col("text")).alias("sha256"))
    none = docs.limit(0).select("sha256", F.lit("").alias("category"), F.lit("").alias("model_name"))
    return decide.mark_copies(docs, none).filter("is_copy").select(F.col("discovery_rank").alias("doc_id"), "sha256")


_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), ';[^/]*$', '')"


@query(f"SELECT page_id, url, '.html' AS ext FROM pages WHERE lower(regexp_extract({_PATH}, '[^/](\\.[^./]+)/*$', 1)) = '.html'")
def url_ext_filter(read):
    pages = read("pages").select("page_id", "url", url.url_ext(F.col("url")).alias("ext"))
    return pages.filter(F.col("ext").isin(".html"))


@query(f"""
WITH n AS (SELECT page_id, regexp_extract({_PATH}, '([^/]*)/*$', 1) AS name, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages),
s AS (SELECT page_id, coalesce(nullif(coalesce(nullif(regexp_extract(name, '^(.+)\\.[^.]+$', 1), ''), name), ''), nullif(host, ''), 'image') AS stem FROM n)
SELECT page_id, stem, {_SLUG.format('stem')} AS slug FROM s
""")
def url_stem_slug(read):
    stem = url.url_stem(F.col("url"))
    return read("pages").select("page_id", stem.alias("stem"), text.slugify(stem).alias("slug"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def history_anti(read):
    return discovery.not_recorded(read("documents").select("doc_id", "lang"), read("labels"), "doc_id")


@query("""
WITH h AS (SELECT doc_id, lang, sha256(text) AS sha FROM documents)
SELECT doc_id, lang FROM h SEMI JOIN (SELECT sha FROM h JOIN labels USING (doc_id)) USING (sha)
""")
def history_semi(read):
    docs = read("documents").select(F.col("doc_id").alias("discovery_rank"), "lang", hashing.sha256_hex(F.col("text")).alias("sha256"))
    past = docs.join(read("labels"), F.col("discovery_rank") == F.col("doc_id")).select("sha256", F.lit("other").alias("category"), F.lit("m").alias("model_name"))
    # each hash once, by its least id: a row picked for it could be another when Spark computes the rows again. The hash
    # in the rank tells null or repeated ids apart, and rows by rank are dealt anew for the last join, which Spark can split
    least = docs.groupBy("sha256").agg(F.min("discovery_rank").alias("least"))
    once = least.select("sha256", F.struct("least", "sha256").alias("discovery_rank"))
    known = decide.mark_copies(once, past).filter("is_copy").select("sha256")
    return docs.join(known, "sha256").select(F.col("discovery_rank").alias("doc_id"), "lang")


_VARIANTS = CurationConfig().variant_suffixes + CurationConfig().filetype_suffixes
_EXTRAS = ("src0 fanart", "src1 portrait", "latest portrait")


@query(f"""
WITH base AS (SELECT DISTINCT source AS q FROM documents),
suffix(variant, s) AS (VALUES (0, ''), {', '.join(f"({i}, ' {s}')" for i, s in enumerate(_VARIANTS, 1))}),
spelled AS (
  SELECT q AS base, variant, q || s AS query, 0 AS late FROM base, suffix WHERE variant = 0 OR strlen(q) = length(q)
  UNION ALL SELECT NULL, i, e, 1 FROM (VALUES {', '.join(f"({i}, '{e}')" for i, e in enumerate(_EXTRAS))}) x(i, e)),
first AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY late, base, variant) AS r FROM spelled)
SELECT query, base AS base_rank, variant FROM first WHERE r = 1
""")
def query_expand(read):
    base = read("documents").select(F.col("source").alias("base_rank"), F.col("source").alias("query")).distinct()
    config = CurationConfig()
    return discovery.expand_queries(base, config.variant_suffixes, config.filetype_suffixes, _EXTRAS)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 80")
def max_results_per_query(read):
    return discovery.top_results(read("documents").select("doc_id", "lang"), 80, "lang", "doc_id")


@query("SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS discovery_rank FROM (SELECT page_id, url FROM pages ORDER BY page_id LIMIT 40)")
def url_cap(read):
    first = read("pages").select("page_id", "url").orderBy("page_id").limit(CurationConfig().url_cap)
    return discovery.discovery_rank(first, [F.col("page_id")]).select("page_id", "url", "discovery_rank")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 20 THEN 'kept' ELSE 'limit_reached' END AS decision FROM labels WHERE quality = 1 AND toxic = 0
""")
def keep_quota(read):
    passers = read("labels").filter("quality = 1 and toxic = 0").select("doc_id")
    ranked = decide.keep_quota(passers, CurationConfig().limit, F.lit(True), ["doc_id"])
    return ranked.select("doc_id", F.when(F.col("in_quota"), "kept").otherwise("limit_reached").alias("decision"))


@query("""
WITH p AS (
  SELECT CASE WHEN page_id % 29 = 0 THEN 404 ELSE 200 END AS status,
    CASE page_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN '' WHEN 2 THEN 'IMAGE/PNG; q=1' ELSE 'application/octet-stream' END AS ct,
    strlen(html) + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS size, page_id % 2 = 1 AS html,
    CASE WHEN page_id % 5 = 0 THEN strlen(html) + 7 WHEN page_id % 5 = 1 THEN NULL ELSE strlen(html) + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END END AS declared
  FROM pages),
r AS (SELECT CASE WHEN status <> 200 THEN 'status' WHEN declared > 9000 THEN 'too large (declared)' WHEN declared < 2000 THEN 'too small (declared)'
    WHEN ct = 'text/plain' THEN 'unsupported content-type' WHEN size <> declared THEN 'truncated' WHEN size > 9000 THEN 'too large' WHEN size < 2000 THEN 'too small'
    WHEN html THEN 'html' ELSE 'valid' END AS reason FROM p)
SELECT reason, count(*) AS n FROM r GROUP BY reason
""")
def payload_validation(read):
    i, html = F.col("page_id"), F.col("html")
    data = F.encode(F.when(i % 2 == 0, F.concat(F.lit("X"), html)).otherwise(html), "UTF-8")
    pages = read("pages").select(
        F.when(i % 29 == 0, 404).otherwise(200).alias("status"),
        F.when(i % 7 == 0, "text/plain").when(i % 7 == 1, "").when(i % 7 == 2, "IMAGE/PNG; q=1").otherwise("application/octet-stream").alias("content_type"),
        data.alias("content"),
        F.when(i % 5 == 0, F.octet_length(html) + 7).when(i % 5 == 1, F.lit(None)).otherwise(F.octet_length(data)).cast("string").alias("content_length"),
    )
    reason = media.reject_reason(F.col("status"), F.col("content_type"), F.col("content_length"), F.col("content"), 2_000, 9_000, CurationConfig().content_types)
    return pages.select(F.coalesce(reason, F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT 'pages' AS origin, page_id AS id, html AS body FROM pages UNION ALL SELECT 'documents', doc_id, text FROM documents)
SELECT origin, id, regexp_matches(body, '^[ \\t\\n\\v\\f\\r]*<') AS is_html FROM a
""")
def html_sniff(read):
    both = read("pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    both = both.union(read("documents").select(F.lit("documents"), "doc_id", "text"))
    return both.select("origin", "id", media.looks_like_html(F.encode("body", "UTF-8")).alias("is_html"))


@query("""
SELECT doc_id, CASE WHEN toxic IS NULL OR toxic = 1 OR quality = 0 THEN 'discard' ELSE 'photo' END AS category FROM documents LEFT JOIN labels USING (doc_id)
""")
def safety_gate(read):
    joined = read("documents").select("doc_id").join(read("labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 0, DISCARD).when(F.col("quality") == 1, "photo")
    return joined.select("doc_id", decide.safety_gate(label, F.col("toxic") == 1).alias("category"))


_LEDGER_CONFIG = CurationConfig(limit=60, max_urls_multiplier=4, max_results_per_query=200, min_bytes=400, max_bytes=20_000)
_DOC_URL = "concat('http://', source, '.example/', cast(doc_id as {0}), CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg?x=1' ELSE '.gif' END)"
_RESPONSE = """concat('{"label": "', CASE WHEN quality = 1 THEN 'photo' ELSE 'discard' END, '", "confidence": 0.5, "is_underage_or_ambiguous": ', CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END, '}')"""


def _run_inputs(read):
    docs = read("documents").withColumn("url", F.expr(_DOC_URL.format("string")))
    hits = docs.select(F.lit(0).alias("query_rank"), F.col("lang").alias("query"), F.col("doc_id").alias("result_rank"), "url")
    payloads = docs.select("url", F.lit(200).alias("status"), F.lit("").alias("content_type"), F.lit(None).cast("string").alias("content_length"), F.encode("text", "UTF-8").alias("content"))
    verdicts = docs.join(read("labels"), "doc_id").select(hashing.sha256_hex(F.col("text")).alias("sha256"), F.expr(_RESPONSE).alias("response"), F.lit("model").alias("model_name"))
    past = docs.filter("doc_id % 50 = 0").select("url", hashing.sha256_hex(F.col("text")).alias("sha256"), F.lit("other").alias("category"), F.lit("model").alias("model_name"))
    return hits, payloads, verdicts, past


_LEDGER_SQL = f"""
WITH d AS (SELECT *, {_DOC_URL.format('varchar')} AS url, sha256(text) AS sha FROM documents),
past AS (SELECT url, sha FROM d WHERE doc_id % 50 = 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM d) WHERE r <= 200),
found AS (SELECT * FROM top WHERE doc_id % 4 <> 3 AND url NOT IN (SELECT url FROM past) ORDER BY doc_id LIMIT 240),
valid AS (SELECT * FROM found WHERE strlen(text) BETWEEN 400 AND 20000 AND NOT regexp_matches(text, '^[ \\t\\n\\v\\f\\r]*<')),
verdict AS (SELECT sha256(text) AS sha, arg_min(quality = 1 AND toxic = 0, (CASE WHEN quality = 1 THEN 2 ELSE 0 END) + (CASE WHEN toxic = 1 THEN 1 ELSE 0 END)) AS safe FROM documents JOIN labels USING (doc_id) GROUP BY 1),
marked AS (SELECT v.*, row_number() OVER (PARTITION BY v.sha ORDER BY doc_id) > 1 OR v.sha IN (SELECT sha FROM past) AS copy, w.sha IS NOT NULL AS judged, w.safe FROM valid v LEFT JOIN verdict w ON v.sha = w.sha),
passing AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS q FROM marked WHERE NOT copy AND judged AND safe),
decided AS (SELECT m.url, m.sha AS sha256, p.q,
  CASE WHEN copy THEN 'dedupe' WHEN NOT judged THEN 'classify_error' WHEN p.q > 60 THEN 'limit_reached' ELSE 'model' END AS model_name FROM marked m LEFT JOIN passing p USING (doc_id))
"""


def _decisions(read):
    hits, payloads, verdicts, past = _run_inputs(read)
    found = discovery.discover(hits, past, _LEDGER_CONFIG)
    return found, decide.decide(found, payloads, verdicts, past, _LEDGER_CONFIG)


@query(_LEDGER_SQL + """
SELECT url, sha256, CASE WHEN q <= 60 THEN 'photo' ELSE 'discard' END AS category, model_name,
  CASE model_name WHEN 'model' THEN 0.5::DOUBLE WHEN 'classify_error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM decided
""")
def decision_ledger(read):
    return _decisions(read)[1].select("url", "sha256", "category", "model_name", "confidence")


@query(_LEDGER_SQL + """
SELECT (SELECT count(*) FROM found) AS urls_found, count(*) AS downloaded, count(*) FILTER (WHERE model_name NOT IN ('dedupe', 'classify_error')) AS classified,
  count(*) FILTER (WHERE q <= 60) AS kept, count(*) FILTER (WHERE q IS NULL OR q > 60) AS discarded FROM decided
""")
def run_counters(read):
    return decide.run_counters(*_decisions(read))


@query("""
WITH b AS (SELECT concat('u', doc_id % 400) AS url, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT url, doc_id FROM b WHERE url NOT IN (SELECT concat('u', doc_id % 400) FROM documents WHERE doc_id % 3 = 0 AND doc_id < 150)
""")
def insert_or_ignore(read):
    docs = read("documents").select("doc_id", F.concat(F.lit("u"), (F.col("doc_id") % 400).cast("string")).alias("url"))
    return ledger.new_rows(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0 and doc_id < 150"), ["doc_id"]).select("url", "doc_id")


@query("""
WITH b AS (SELECT sha256(coalesce(text, '')) AS url, min(doc_id) AS doc_id FROM documents GROUP BY 1),
h AS (SELECT sha256(coalesce(text, '')) AS url FROM documents JOIN labels USING (doc_id))
SELECT url, doc_id FROM b ANTI JOIN h USING (url)
""")
def insert_or_ignore_whole(read):
    """All documents by their text's hash, against the documents of all labels as history."""
    docs = read("documents").select("doc_id", hashing.sha256_hex(F.coalesce("text", F.lit(""))).alias("url"))
    return ledger.new_rows(docs, docs.join(read("labels").select("doc_id"), "doc_id"), ["doc_id"]).select("url", "doc_id")


@query("""
SELECT concat('2024-01-01T00:00:', lpad(CAST(page_id % 60 AS VARCHAR), 2, '0'), '+00:00') AS created_at, url, concat('{"url":"', url, '","sha256":"', sha256(html), '","phash":null,"filepath":null,"category":"other","created_at":"2024-01-01T00:00:', lpad(CAST(page_id % 60 AS VARCHAR), 2, '0'),
  '+00:00","model_name":"model","confidence":1.0}') AS item FROM pages
""")
def manifest(read):
    pages = read("pages").select(
        F.col("page_id").alias("id"), "url", hashing.sha256_hex(F.col("html")).alias("sha256"), F.lit(None).cast("string").alias("phash"), F.lit(None).cast("string").alias("filepath"), F.lit("other").alias("category"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit("+00:00")).alias("created_at"), F.lit("model").alias("model_name"), F.lit(1.0).alias("confidence"),
    )
    return ledger.manifest_items(pages).select("created_at", "url", "item")


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events
""")
def json_extract(read):
    told = F.when(F.col("event_id") % 7 == 0, F.lit("no answer {")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done."))).otherwise(F.col("props"))
    return read("events").select("event_id", F.try_variant_get(verdict.extract_json(told), "$.k", "bigint").alias("k"))


_BROKEN = """CASE doc_id % 10
  WHEN 0 THEN '{"label": "photo", "confidence": "0.9", "is_underage_or_ambiguous": false}'
  WHEN 1 THEN 'I think {"label": "other", "confidence": 1, "reasons": ["a", "b"], "is_underage_or_ambiguous": true} fits'
  WHEN 2 THEN '{"label": "photo", "confidence": 1.5, "is_underage_or_ambiguous": false}'
  WHEN 3 THEN '{"label": "unknown", "confidence": 0.5, "is_underage_or_ambiguous": false}'
  WHEN 4 THEN '{"label": "photo", "confidence": 0.5, "reasons": "a", "is_underage_or_ambiguous": false}'
  WHEN 5 THEN '{"label": "photo", "confidence": 0.5}'
  WHEN 6 THEN '{"label": "photo", "confidence": 0.5, "is_underage_or_ambiguous": false, "extra": 1}'
  WHEN 7 THEN '["photo"]'
  WHEN 8 THEN 'nothing'
  ELSE '{"label": "discard", "confidence": 0.25, "reasons": [], "is_underage_or_ambiguous": false}' END"""


@query("""
SELECT doc_id, quality, CASE doc_id % 10 WHEN 0 THEN 'photo' WHEN 1 THEN 'other' WHEN 9 THEN 'discard' END AS label,
  CASE doc_id % 10 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 9 THEN 0.25::DOUBLE END AS confidence,
  CASE doc_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 9 THEN 0 END::BIGINT AS n_reasons, CASE doc_id % 10 WHEN 0 THEN false WHEN 1 THEN true WHEN 9 THEN false END AS flagged FROM labels
""")
def verdict_validate(read):
    rows = read("labels").select("doc_id", "quality", F.expr(_BROKEN).alias("response"))
    v = verdict.validate_verdict(verdict.extract_json(F.col("response")), CurationConfig().labels)
    rows = rows.select("doc_id", "quality", v.alias("v"))
    n = F.when(F.col("v").isNotNull(), F.size("v.reasons")).cast("long")
    return rows.select("doc_id", "quality", F.col("v.label").alias("label"), F.col("v.confidence").alias("confidence"), n.alias("n_reasons"), F.col("v.is_underage_or_ambiguous").alias("flagged"))


_LINE = """concat('2024 | INFO | run | ', CASE event_type WHEN 'error' THEN 'download failed url=u error=' WHEN 'click' THEN 'Download FAILED error=' WHEN 'view' THEN 'classification failed error='
  WHEN 'signup' THEN 'discarded invalid image ' ELSE 'image decode skipped search failed ' END, CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN 'status 429' WHEN user_id % 5 = 2 THEN 'Status 403' WHEN user_id % 5 = 3 THEN 'status 403' ELSE 'too small error=x' END)"""


@query(f"""
WITH l AS (SELECT lower({_LINE}) AS v FROM events)
SELECT count(*) FILTER (WHERE contains(v, 'download failed')) AS download_failed, count(*) FILTER (WHERE contains(v, 'classification failed')) AS classification_failed,
  count(*) FILTER (WHERE contains(v, 'discarded invalid image')) AS discarded_invalid, count(*) FILTER (WHERE contains(v, 'image decode skipped')) AS decode_skipped,
  count(*) FILTER (WHERE contains(v, 'status 429')) AS rate_limited, count(*) FILTER (WHERE contains(v, 'search failed')) AS search_failed FROM l
""")
def log_line_counts(read):
    return reports.log_counters(read("events").select(F.expr(_LINE).alias("value")))


@query(f"""
WITH l AS (SELECT regexp_extract({_LINE}, 'error=(.+)$', 1) AS reason FROM events WHERE event_type IN ('error', 'click'))
SELECT min(reason) AS reason, count(*) AS n FROM l WHERE reason <> '' GROUP BY lower(reason)
""")
def log_reason_counts(read):
    return reports.failure_reasons(read("events").select(F.expr(_LINE).alias("value")))


_BITS = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (CASE WHEN i = 64 THEN -9223372036854775808 ELSE (1::HUGEINT << (i - 1)::HUGEINT)::HUGEINT END)::HUGEINT ELSE 0::HUGEINT END))::BIGINT"


def _sign_bits(vector: Column) -> Column:
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@query(f"""
WITH h AS (SELECT vec_id AS id, {_BITS} AS hash FROM embeddings)
SELECT a.id, a.hash, count(b.id) AS n_similar FROM h a LEFT JOIN h b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 6 GROUP BY a.id, a.hash
""")
def hamming_pairs(read):
    return similarity.similar_counts(read("embeddings").select(F.col("vec_id").alias("id"), _sign_bits(F.col("embedding")).alias("hash")), 6)


@query("""
WITH m AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS a, len(list_filter(embedding, lambda x: x > 0.1)) AS b, len(list_filter(embedding, lambda x: x < -0.1)) AS c,
  len(list_filter(embedding, lambda x: x > 0.2)) AS d, len(list_filter(embedding, lambda x: x < -0.2)) AS e FROM embeddings),
f AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN ['metrics_missing'] ELSE list_filter([CASE WHEN a < 32 AND b < 14 THEN 'low_luma+low_sat_std' END, CASE WHEN c < 14 AND b < 14 THEN 'low_sat_mean+low_sat_std' END,
  CASE WHEN d < 3 AND b < 14 THEN 'low_color+low_sat_std' END, CASE WHEN a >= 36 THEN 'flat_ratio' END, CASE WHEN d < 3 AND e < 3 THEN 'low_lap+low_edge' END, CASE WHEN e < 2 THEN 'low_entropy' END], lambda x: x IS NOT NULL) END AS flags FROM m)
SELECT vec_id, coalesce(nullif(array_to_string(flags, ','), ''), 'none') AS flags, len(flags) > 0 AS flagged FROM f
""")
def embedding_flags(read):
    count = lambda f: F.size(F.filter("embedding", f)).cast("double")
    a, b, c, d, e = (count(f) for f in (lambda x: x > 0, lambda x: x > 0.1, lambda x: x < -0.1, lambda x: x > 0.2, lambda x: x < -0.2))
    items = read("embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 11 != 0, a).alias("luma_stddev"), b.alias("sat_stddev"), c.alias("sat_mean"), d.alias("colorfulness"), a.alias("flat_ratio"),
        d.alias("laplacian_var"), e.alias("edge_density"), e.alias("entropy"),
    )
    bounds = AuditThresholds(min_luma_stddev=32, min_sat_stddev=14, min_sat_mean=14, min_colorfulness=3, flat_tile_ratio=36, min_laplacian_var=3, min_edge_density=3, min_entropy=2)
    return audit.with_flags(items, bounds).select("vec_id", text.join_flags(F.col("flags")).alias("flags"), "flagged")


@query("SELECT doc_id, md5('data:text/plain;base64,' || base64(encode(text))) AS uri_md5 FROM documents")
def base64_uri(read):
    return read("documents").select("doc_id", F.md5(text.data_uri(F.lit("text/plain"), F.encode("text", "UTF-8"))).alias("uri_md5"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS compact FROM events")
def iso_timestamp(read):
    return read("events").select("event_id", text.iso_seconds(F.col("ts")).alias("iso"), text.compact_seconds(F.col("ts")).alias("compact"))


@query("""
WITH i AS (SELECT doc_id, n_chars < 500 AS short, CASE WHEN toxic = 1 THEN true END AS bad FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT doc_id, short OR coalesce(bad, false) AS flagged, concat_ws(',', CASE WHEN short THEN 'short' END, CASE WHEN bad THEN 'llm_gray' END) AS flags FROM i)
SELECT doc_id, coalesce(nullif(flags, ''), 'none') AS flags FROM f WHERE flagged OR NOT (SELECT bool_or(flagged) FROM f) ORDER BY doc_id DESC LIMIT 20
""")
def audit_sample20(read):
    short = F.col("n_chars") < 500
    items = read("documents").select("doc_id", F.col("doc_id").cast("string").alias("filepath"), short.alias("flagged"), F.array_compact(F.array(F.when(short, F.lit("short")))).alias("flags"))
    verdicts = read("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("filepath"), F.struct(F.lit("GRAY").alias("quality"), F.lit(None).cast("boolean").alias("is_gray"), F.lit("").alias("reason")).alias("llm"))
    sample = audit.flagged_or_all(audit.with_auditor(items, verdicts)).orderBy(F.desc("doc_id")).limit(20)
    return sample.select("doc_id", text.join_flags(F.col("flags")).alias("flags"))


@query(f"""
WITH w AS (SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1), d AS (SELECT doc_id, lang, source, sha FROM w JOIN documents USING (doc_id))
SELECT doc_id, concat('out/', lang, '/', left(sha, 12), '_', {_SLUG.format("concat(source, '_', doc_id % 3)")}, CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.bin' ELSE '.gif' END) AS filepath FROM d
""")
def file_names(read):
    hashed = read("documents").select("doc_id", "lang", "source", hashing.sha256_hex(F.col("text")).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("doc_id", "lang", "source")).alias("f")).select("sha256", "f.*")
    ext = F.when(F.col("doc_id") % 4 == 0, ".JPG?x").when(F.col("doc_id") % 4 == 1, ".png").otherwise("")  # that of the content type counts
    kind = F.when(F.col("doc_id") % 4 == 0, "image/png").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "application/octet-stream").otherwise("IMAGE/GIF; q=1")
    rows = first.select("doc_id", F.concat(F.lit("http://h/"), "source", F.lit("_"), (F.col("doc_id") % 3).cast("string"), ext).alias("url"), "sha256", kind.alias("content_type"), F.col("lang").alias("category"), F.col("doc_id").alias("discovery_rank"))
    return ledger.file_paths(rows, F.lit("out")).select("doc_id", "filepath")


@query("""
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM pages
""")
def mime_sniff(read):
    i = F.col("page_id") % 5
    head = F.when(i == 0, "FFD8FF").when(i == 1, "89504E470D").when(i == 2, "474946383961").when(i == 3, "524946460000000057454250").otherwise("")
    return read("pages").select("page_id", media.sniff_mime(F.unhex(F.concat(head, F.hex("html")))).alias("mime"))


_ERRORS = """CASE user_id % 6 WHEN 0 THEN '{"error": {"message": "Cannot decode image"}}' WHEN 1 THEN '{"error": {"message": "image input is not supported"}}' WHEN 2 THEN '{"error": "x"} bad response_format '
  WHEN 3 THEN ' schema UNSUPPORTED ' WHEN 4 THEN '{"error": {"code": 5}}' ELSE 'try later' END"""


@query("""
SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'decode' WHEN 1 THEN 'no_vision' WHEN 2 THEN 'schema_unsupported' WHEN 3 THEN 'schema_unsupported' ELSE 'other' END AS kind FROM events
""")
def error_classes(read):
    return read("events").select("event_id", verdict.error_class(verdict.error_message(F.expr(_ERRORS))).alias("kind"))


@query("""
WITH i AS (SELECT n_chars < 500 OR toxic = 1 AS flagged, labels.doc_id IS NOT NULL AS audited, toxic = 1 AS bad FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE audited) AS audited, count(*) FILTER (WHERE bad) AS bad,
  coalesce(count(*) FILTER (WHERE flagged) * 100.0::DOUBLE / nullif(count(*), 0), 0) AS flagged_rate, coalesce(count(*) FILTER (WHERE bad) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE audited), 0), 0) AS bad_rate FROM i
""")
def audit_totals(read):
    items = read("documents").select(F.col("doc_id").cast("string").alias("filepath"), (F.col("n_chars") < 500).alias("flagged"), F.array().cast("array<string>").alias("flags"))
    said = F.struct(F.when(F.col("toxic") == 1, "low").otherwise("good").alias("quality"), F.lit(False).alias("is_gray"), F.lit("").alias("reason"))
    verdicts = read("labels").select(F.col("doc_id").cast("string").alias("filepath"), said.alias("llm"))
    return audit.audit_totals(audit.with_auditor(items, verdicts)).select("total", "flagged", "audited", "bad", "flagged_rate", "bad_rate")


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(url), '[/_.-](thumbs?|thumbnail|preview|avatar|icons?)[/_.-]|[?&](w|h|width|height|size)=[0-9]{1,3}(&|$)') OR page_id % 10 = 0")
def thumbnail_urls(read):
    spelled = F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("/thumb/x.png"))).otherwise(F.col("url"))
    return read("pages").filter(url.url_looks_like_thumbnail(spelled)).select("page_id")


@query(f"SELECT count(*) AS n_hashes FROM (SELECT DISTINCT {_BITS} AS hash FROM embeddings WHERE vec_id % 7 > 1)")
def phash_scan(read):
    i = F.col("vec_id")
    found = read("embeddings").select(F.when(i % 7 == 0, F.lit("")).when(i % 7 != 1, F.lpad(F.lower(F.hex(_sign_bits(F.col("embedding")))), 16, "0")).alias("phash"))
    return ledger.phashes(found).distinct().agg(F.count("*").alias("n_hashes"))


def _greedy(read):
    """No SQL: the scan in rank order is sequential. A test holds it against one."""
    items = read("embeddings").select(F.col("vec_id").alias("rank"), _sign_bits(F.col("embedding")).alias("hash"))
    return similarity.greedy_keep(items, 6).select(F.col("rank").alias("vec_id"))


_greedy.__name__ = "greedy_near_hashes"
query()(_greedy)
