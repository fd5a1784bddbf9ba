"""Counts, rates and log analytics, and the text of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DISCARD
from ..functions.text import error_reason, rate_text

# What log lines are counted for, whatever their case.
LOG_PATTERNS = {
    "download_failed": "download failed",
    "classification_failed": "classification failed",
    "discarded_invalid": "discarded invalid image",
    "decode_skipped": "image decode skipped",
    "rate_limited": "status 429",
    "search_failed": "search failed",
}


def category_counts(ledger: DataFrame, column: str = "category") -> DataFrame:
    return ledger.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))


def stats_lines(ledger: DataFrame) -> list[str]:
    """The total, then categories by name; a null category comes first."""
    rows = category_counts(ledger).orderBy("category").collect()
    return [f"Total records: {sum(r['n'] for r in rows)}", *(f"{r['category']}: {r['n']}" for r in rows)]


def success_rates(ledger: DataFrame) -> DataFrame:
    """total, kept, discarded and both rates, in one pass. Null categories count in the total alone."""
    counts = ledger.agg(F.count("*").alias("total"), F.count_if(F.col("category") != DISCARD).alias("kept"), F.count_if(F.col("category") == DISCARD).alias("discarded"))
    return counts.withColumns({"kept_rate": rate_text(F.col("kept"), F.col("total")), "discard_rate": rate_text(F.col("discarded"), F.col("total"))})


def top_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(key, n), the most frequent first, ties by name."""
    counts = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")
    return counts.limit(n) if n is not None else counts


def discard_reasons(ledger: DataFrame, n: int = 10) -> DataFrame:
    return top_counts(ledger.filter(F.col("category") == DISCARD), "model_name", n)


def log_counters(lines: DataFrame, column: str = "value") -> DataFrame:
    """All counters in one pass."""
    return lines.agg(*[F.count_if(F.col(column).rlike(f"(?i){pattern}")).alias(name) for name, pattern in LOG_PATTERNS.items()])


def failure_reasons(lines: DataFrame, column: str = "value") -> DataFrame:
    """(reason, n) of failed downloads; case doesn't tell reasons apart, empty ones don't count."""
    failed = lines.filter(F.col(column).rlike("(?i)download failed")).select(error_reason(F.col(column)).alias("reason")).filter("reason <> ''")
    return failed.groupBy(F.lower("reason").alias("_key")).agg(F.min("reason").alias("reason"), F.count("*").alias("n")).select("reason", "n").orderBy(F.desc("n"), "reason")


def success_report(ledger: DataFrame | None, lines: DataFrame | None, today: str, log_name: str | None = None) -> str:
    """The metrics file as text; None for a ledger or log that isn't there."""
    out = ["# SUCCESSRATE.MD", "", f"Last updated: {today}", "", "## Baseline metrics (cumulative)"]
    if ledger is None:
        out.append("- ERROR: missing ledger")
    else:
        r = success_rates(ledger).first()
        out += [f"- Total records: {r['total']}", f"- Kept: {r['kept']} ({r['kept_rate']})", f"- Discarded: {r['discarded']} ({r['discard_rate']})", "- Top discard reasons (model_name):"]
        out += [f"  - {x['key']}={x['n']}" for x in discard_reasons(ledger).collect()] or ["  - (none)"]
        out += ["- Category counts:", *(f"  - {x['key']}={x['n']}" for x in top_counts(ledger, "category").collect())]
    out += ["", "## Latest run log metrics"]
    if lines is None:
        out.append("- No log files found")
    else:
        counters = log_counters(lines).first().asDict()
        out += [f"- latest_log: {log_name}", *(f"- {k}: {v}" for k, v in counters.items()), "- download_reasons:"]
        out += [f"  - {x['n']} {x['reason']}" for x in failure_reasons(lines).toLocalIterator()] or ["  - (none)"]
    return "\n".join(out) + "\n"
