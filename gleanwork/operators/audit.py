"""Quality audits: flag rules over image metrics, verdicts of an auditor, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditThresholds
from ..functions.text import join_flags


def metric_flags(t: AuditThresholds) -> Column:
    """array<string> over the metric columns. A missing core metric gives metrics_missing alone."""
    c = F.col
    low = {name: F.coalesce(c(column) < bound, F.lit(False)) for name, column, bound in (
        ("luma", "luma_stddev", t.min_luma_stddev), ("sat_std", "sat_stddev", t.min_sat_stddev), ("sat_mean", "sat_mean", t.min_sat_mean), ("color", "colorfulness", t.min_colorfulness),
        ("lap", "laplacian_var", t.min_laplacian_var), ("edge", "edge_density", t.min_edge_density), ("entropy", "entropy", t.min_entropy),
    )}
    flat = F.coalesce(c("flat_ratio") >= t.flat_tile_ratio, F.lit(False))
    rules = {
        "low_luma+low_sat_std": low["luma"] & low["sat_std"],
        "low_sat_mean+low_sat_std": low["sat_mean"] & low["sat_std"],
        "low_color+low_sat_std": low["color"] & low["sat_std"],
        "flat_ratio": flat,
        "low_lap+low_edge": low["lap"] & low["edge"],
        "low_entropy": low["entropy"],
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    missing = c("luma_stddev").isNull() | c("sat_stddev").isNull() | c("sat_mean").isNull()
    return F.when(missing, F.array(F.lit("metrics_missing"))).otherwise(found)


def gate_reason(t: AuditThresholds, truncated: Column | None = None, truncated_factor: float = 1.5) -> Column:
    """Why an image would be discarded before classification, or null.

    The gates of single bounds, in order; a truncated image needs its texture and
    entropy above the bounds by a factor.
    """
    below = lambda name, bound: F.coalesce(F.col(name) < bound, F.lit(False))
    out = F.when(below("luma_stddev", t.min_luma_stddev) & below("sat_stddev", t.min_sat_stddev), "low_variance")
    out = out.when(below("sat_mean", t.min_sat_mean) & below("sat_stddev", t.min_sat_stddev), "low_saturation")
    out = out.when(below("colorfulness", t.min_colorfulness) & below("sat_stddev", t.min_sat_stddev), "low_color")
    out = out.when(F.coalesce(F.col("flat_ratio") >= t.flat_tile_ratio, F.lit(False)), "flat_ratio")
    if truncated is not None:
        weak = below("laplacian_var", t.min_laplacian_var * truncated_factor) | below("edge_density", t.min_edge_density * truncated_factor) | below("entropy", t.min_entropy * truncated_factor)
        out = out.when(truncated & weak, "truncated_low_quality")
    return out


def with_flags(items: DataFrame, thresholds: AuditThresholds) -> DataFrame:
    return items.withColumn("flags", metric_flags(thresholds)).withColumn("flagged", F.size("flags") > 0)


def mark_missing(ledger_items: DataFrame, files: DataFrame) -> DataFrame:
    """Left join on filepath; items without a file get flag and error missing_file. files: (filepath, metrics)."""
    joined = ledger_items.join(files.withColumn("_here", F.lit(True)), "filepath", "left")
    return joined.withColumn("error", F.when(F.col("_here").isNull(), "missing_file")).drop("_here")


def flagged_or_all(items: DataFrame) -> DataFrame:
    """The flagged items, or all of them if none is."""
    some = items.agg(F.coalesce(F.max("flagged"), F.lit(False)).alias("_any"))
    return items.crossJoin(F.broadcast(some)).filter("flagged or not _any").drop("_any")


def candidates(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """What the auditor is asked about: the first n flagged items, or of all items if none is flagged."""
    return flagged_or_all(items).orderBy(*order).limit(n)


def auditor_finds_bad(quality: Column, is_gray: Column) -> Column:
    return F.coalesce(F.lower(quality).isin("gray", "low"), F.lit(False)) | F.coalesce(is_gray, F.lit(False))


def with_auditor(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds the auditor's verdicts (filepath, llm): bad ones flag, as llm_gray or llm_low."""
    joined = items.join(verdicts, "filepath", "left")
    bad = auditor_finds_bad(F.col("llm.quality"), F.col("llm.is_gray"))
    gray = F.coalesce(F.lower("llm.quality") == "gray", F.lit(False)) | F.coalesce(F.col("llm.is_gray"), F.lit(False))
    more = F.array_union("flags", F.array(F.when(gray, "llm_gray").otherwise("llm_low")))
    return joined.withColumn("flagged", F.col("flagged") | bad).withColumn("flags", F.when(bad, more).otherwise(F.col("flags")))


def audit_totals(items: DataFrame) -> DataFrame:
    """total, flagged, audited, bad, and rates in percent (0 of nothing)."""
    bad = F.col("llm").isNotNull() & (F.coalesce(F.col("llm.quality").isin("gray", "low"), F.lit(False)) | F.coalesce(F.col("llm.is_gray"), F.lit(False)))
    counts = items.agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("llm").isNotNull()).alias("audited"), F.count_if(bad).alias("bad"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    return counts.withColumns({"flagged_rate": rate("flagged", "total"), "bad_rate": rate("bad", "audited")})


def sample_line() -> Column:
    """One line of the report; missing metrics read as zero."""
    z = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    spec = "- %s | luma_std=%.2f sat_std=%.2f sat_mean=%.2f color=%.2f flat=%.2f lap=%.2f edge_den=%.4f entropy=%.2f edge=%.2f bright=%.2f flags=%s%s"
    names = ("luma_stddev", "sat_stddev", "sat_mean", "colorfulness", "flat_ratio", "laplacian_var", "edge_density", "entropy", "edge_mean", "brightness")
    llm = F.when(F.coalesce(F.col("llm.quality"), F.lit("")) != "", F.concat(F.lit(" | llm="), F.col("llm.quality"), F.lit(" ("), F.coalesce("llm.reason", F.lit("None")), F.lit(")"))).otherwise("")
    return F.format_string(spec, F.col("filepath"), *[z(n) for n in names], join_flags(F.col("flags")), llm)


def quality_report(items: DataFrame, order: list[Column], sample: int = 20) -> str:
    """The report as text: totals, then the first flagged and the first that the auditor found bad."""
    t = audit_totals(items).first()
    out = [
        "# QUALITYREPORT.MD", "", f"Audited images: {t['total']}", f"Flagged as likely gray/low quality: {t['flagged']} ({t['flagged_rate']:.1f}%)",
        f"LLM audited: {t['audited']}", f"LLM flagged gray/low: {t['bad']} ({t['bad_rate']:.1f}%)", "", "## Sample flagged images",
    ]
    out += [r["line"] for r in items.filter("flagged").orderBy(*order).limit(sample).select(sample_line().alias("line")).collect()] or ["- (none)"]
    out += ["", "## Sample LLM-flagged images"]
    bad = items.filter(F.col("llm").isNotNull() & (F.col("llm.quality").isin("gray", "low") | F.coalesce(F.col("llm.is_gray"), F.lit(False))))
    line = F.format_string("- %s | llm=%s (%s)", "filepath", F.coalesce("llm.quality", F.lit("unknown")), F.coalesce("llm.reason", F.lit("no reason")))
    out += [r["line"] for r in bad.orderBy(*order).limit(sample).select(line.alias("line")).collect()] or ["- (none)"]
    return "\n".join(out)


def write_json(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)
