"""A whole run: hits, decisions, ledger, manifest, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..operators import decide, discovery, ledger
from ..runtime import cut


@dataclass(frozen=True)
class Run:
    found: DataFrame
    decisions: DataFrame

    @property
    def counters(self) -> DataFrame:
        return decide.run_counters(self.found, self.decisions)


def watched(decisions: DataFrame, into: Observation) -> DataFrame:
    """decisions, whose counts arrive in `into` while whatever reads them runs; no pass of its own."""
    return decisions.observe(into, F.count("*").alias("downloaded"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("discarded"))


def curate(hits: DataFrame, payloads: DataFrame, verdicts: DataFrame | None, past: DataFrame, config: CurationConfig) -> Run:
    """Decides on hits without writing. Decisions are computed once, as several sinks read them."""
    found = discovery.discover(hits, past, config)
    decisions = decide.decide(found, payloads, verdicts, past, config)
    return Run(found, cut(decisions))


def record(run: Run, path: str, created_at: str, config: CurationConfig) -> DataFrame:
    """Appends a run's decisions to the ledger; running it again adds nothing."""
    past = ledger.read_ledger(run.decisions.sparkSession, path).filter("filepath is not null")
    kept = ledger.file_paths(run.decisions.filter("kept"), F.lit(config.out_dir), past).select("url", "filepath")
    rows = run.decisions.join(kept, "url", "left")
    return ledger.append(rows.drop("content_type", "kept"), path, created_at, ["discovery_rank"])
