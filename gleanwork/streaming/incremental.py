"""Incremental discovery: each micro-batch of hits is a run against the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import CurationConfig
from ..operators.ledger import read_ledger
from ..plans.curate import curate, record
from ..schemas import HITS


def stream_hits(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of recorded search results; files that arrive become micro-batches of bounded size."""
    return spark.readStream.schema(HITS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def run_stream(hits: DataFrame, payloads: Callable[[], DataFrame], verdicts: Callable[[], DataFrame | None], ledger_path: str, checkpoint: str, config: CurationConfig, clock: Callable[[], str]) -> StreamingQuery:
    """Starts the stream, until what is there has been read.

    A batch that runs again after a failure finds its URLs recorded and adds none.
    """

    def batch(rows: DataFrame, number: int) -> None:
        past = read_ledger(rows.sparkSession, ledger_path)
        record(curate(rows, payloads(), verdicts(), past, config), ledger_path, clock(), config)

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
