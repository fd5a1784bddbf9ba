"""One query for each operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, attach, cut
from . import attribution, classifier, fertility, fingerprints, licenses, mixing, near_dups, packing, substrings, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), added=True)


def op2_quality_classifier(spark, sf_dir):
    scores = classifier.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), classifier.may_train(F.col("doc_id")))
    return scores.select("doc_id", F.coalesce(~classifier.may_train(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_license_scans(spark, sf_dir):
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.edit_probe(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substrings.dedup_report(_read(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_report(_read(spark, sf_dir, "documents"), added=True)


def op7_warc(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    with Scratch(spark, "warc") as archives:
        found = warc.read_archives(warc.write_archives(pages, min_payload=0, scratch=archives))
        return cut(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op8_quality_rules(spark, sf_dir):
    return fertility.quality_report(_read(spark, sf_dir, "documents"), added=True)


def op9_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return attribution.count_tokens(_read(spark, sf_dir, "documents"), added=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_license_scans, op4_fingerprints, op5_substring_dedup, op6_source_mixing, op7_warc, op8_quality_rules, op9_near_duplicates, op10_token_counts)}


OP5_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM split, unnest(range(1, len(ws) - 11)) t(i)),
least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM windows JOIN least USING (k), range(13) r(o) WHERE m < doc_id),
words AS (SELECT doc_id, p, ws[p] AS w FROM split, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS left_over FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM split LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS own FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((instr('0123456789abcdef', substr(h, 1 + 5 * k // 4, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2 + 5 * k // 4, 1)) - 1) >> (3 - 5 * k % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> own THEN own END AS refers_to FROM g
"""


def oracle_sql() -> dict[str, str]:
    """The others need tokenizers, trained models, ICU or graph searches; tests hold them against plain versions."""
    return {"op5_substring_dedup": OP5_SQL, "op7_warc": OP7_SQL}
