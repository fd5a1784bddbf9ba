"""From candidates to decisions: the rules in order, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DISCARD, CurationConfig
from ..functions.hashing import sha256_hex
from ..functions.media import content_type_norm, reject_reason
from ..functions.verdict import extract_json, validate_verdict


def fetched(candidates: DataFrame, payloads: DataFrame, config: CurationConfig) -> DataFrame:
    """candidates with the sha256 and content type of their payload; reject says why a payload fails.

    A URL without a payload has no row: it stays unrecorded and is tried again. Of
    several payloads of a URL one counts, the same in each run: one that passes if
    any does, of those the one of the least hash. Only payloads of candidates are
    hashed, and bytes stay behind: only the hash travels on.
    """
    reason = reject_reason(F.col("status"), F.col("content_type"), F.col("content_length"), F.col("content"), config.min_bytes, config.max_bytes, config.content_types, config.length_tolerance)
    wanted = payloads.join(candidates.select("url"), "url", "left_semi")
    judged = wanted.select("url", F.struct(reason.isNotNull().alias("fails"), sha256_hex(F.col("content")).alias("sha256"), content_type_norm(F.col("content_type")).alias("content_type"), reason.alias("reject")).alias("p"))
    return candidates.join(judged.groupBy("url").agg(F.min("p").alias("p")).select("url", "p.content_type", "p.sha256", "p.reject"), "url")


def mark_copies(rows: DataFrame, ledger: DataFrame, ignore_errors: bool = False) -> DataFrame:
    """Adds is_copy: the hash is recorded, or an earlier row of the run has it."""
    past = ledger.filter("not (category <=> 'discard' and model_name <=> 'classify_error')") if ignore_errors else ledger
    past = past.filter("sha256 is not null").select("sha256").distinct()
    new = rows.groupBy("sha256").agg(F.min("discovery_rank").alias("discovery_rank")).join(past, "sha256", "left_anti")
    # hashes meet once each and rows by their rank, so a hot hash is no hot task
    joined = rows.join(new.select("discovery_rank", F.lit(True).alias("_new")), "discovery_rank", "left")
    return joined.withColumn("is_copy", F.col("_new").isNull()).drop("_new")


def safety_gate(label: Column, flagged: Column) -> Column:
    """The label, or discard if the flag is set or unknown, or the label is discard or unknown."""
    return F.when(F.coalesce(flagged, F.lit(True)) | F.coalesce(label == DISCARD, F.lit(True)), DISCARD).otherwise(label)


def judge(rows: DataFrame, verdicts: DataFrame | None, config: CurationConfig) -> DataFrame:
    """Adds label, confidence, model_name after the verdict and the gate.

    verdicts: (sha256, response, model_name). A missing or broken response is
    classify_error; nothing unsafe passes for want of a verdict.
    """
    if config.skip_classify:
        return rows.withColumns({"label": F.lit("other"), "confidence": F.lit(1.0), "model_name": F.lit("unclassified")})
    parsed = verdicts.select("sha256", "model_name", validate_verdict(extract_json(F.col("response")), config.labels).alias("_v"))
    # of several verdicts on a payload one valid one counts, the same in each run
    parsed = parsed.filter("_v is not null").groupBy("sha256").agg(F.min(F.struct("model_name", "_v")).alias("_m")).select("sha256", "_m.model_name", "_m._v")
    joined = rows.join(parsed, "sha256", "left")
    gated = safety_gate(F.col("_v.label"), F.col("_v.is_underage_or_ambiguous"))
    return joined.withColumns({
        "label": F.when(F.col("_v").isNull(), DISCARD).otherwise(gated),
        "confidence": F.when(F.col("_v").isNull(), 0.0).otherwise(F.col("_v.confidence")),
        "model_name": F.when(F.col("_v").isNull(), "classify_error").otherwise(F.col("model_name")),
    }).drop("_v")


def keep_quota(rows: DataFrame, limit: int, passes: Column, order: list[str]) -> DataFrame:
    """Adds in_quota: whether a passing row is among the first `limit` of them.

    Only those few are sorted out, by a top-k, and sent to the others.
    """
    first = rows.filter(passes).orderBy(*order).limit(limit).select(*order).withColumn("in_quota", F.lit(True))
    return rows.join(F.broadcast(first), order, "left").withColumn("in_quota", F.coalesce("in_quota", F.lit(False)))


def decide(candidates: DataFrame, payloads: DataFrame, verdicts: DataFrame | None, ledger: DataFrame, config: CurationConfig) -> DataFrame:
    """(url, discovery_rank, sha256, content_type, category, model_name, confidence, kept) of all judged URLs.

    Copies are discards of `dedupe`; passing rows beyond the limit are discards of
    `limit_reached`. The limit holds whatever the order of tasks.
    """
    valid = fetched(candidates, payloads, config).filter("reject is null").drop("reject")
    marked = mark_copies(valid, ledger, config.ignore_classify_errors)
    judged = judge(marked, verdicts, config)
    passes = ~F.col("is_copy") & (F.col("label") != DISCARD)
    ranked = keep_quota(judged, config.limit, passes, ["discovery_rank"])
    over = passes & ~F.col("in_quota")
    return ranked.select(
        "url", "discovery_rank", "sha256", "content_type",
        F.when(F.col("is_copy") | over, DISCARD).otherwise(F.col("label")).alias("category"),
        F.when(F.col("is_copy"), "dedupe").when(over, "limit_reached").otherwise(F.col("model_name")).alias("model_name"),
        F.when(F.col("is_copy") | over, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        (passes & F.col("in_quota")).alias("kept"),
    )


def run_counters(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """urls_found, downloaded, classified, kept, discarded in one pass over each input."""
    n_found = found.agg(F.count("*").alias("urls_found"))
    stages = decisions.agg(
        F.count("*").alias("downloaded"),
        F.count_if(~F.col("model_name").isin("dedupe", "classify_error")).alias("classified"),
        F.count_if("kept").alias("kept"),
        F.count_if(F.col("category") == DISCARD).alias("discarded"),
    )
    return n_found.crossJoin(stages)
