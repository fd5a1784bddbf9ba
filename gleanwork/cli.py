"""python -m gleanwork run | stats | report | audit, over offline tables."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import CurationConfig, load_config
from .operators import audit, images, ledger, reports
from .plans.curate import curate, record
from .runlog import setup_logging
from .runtime import attach
from .sources import tables


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gleanwork")
    parser.add_argument("--config", default="config.yaml")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="decide on recorded hits and append to the ledger")
    run.add_argument("--hits", required=True)
    run.add_argument("--payloads", required=True)
    run.add_argument("--verdicts")
    run.add_argument("--limit", type=int)
    run.add_argument("--manifest", action=argparse.BooleanOptionalAction, default=None)
    run.add_argument("--skip-classify", action="store_true", default=None)
    report = commands.add_parser("report", help="success rates of the ledger and of the latest log")
    report.add_argument("--log-dir")
    check = commands.add_parser("audit", help="image metrics of kept files")
    check.add_argument("--sample", type=int, default=200)
    for command in (run, commands.add_parser("stats", help="rows by category"), report, check):
        command.add_argument("--out")
    return parser


def settings(args: argparse.Namespace) -> CurationConfig:
    """The file's settings, with the flags that are given over them."""
    config = load_config(args.config)
    if args.out:
        config = config.with_out_dir(args.out)
    given = {k: v for k in ("limit", "manifest", "skip_classify") if (v := getattr(args, k, None)) is not None}
    return replace(config, **given)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns the lines that it prints."""
    args = _parser().parse_args(argv)
    config = settings(args)
    spark = attach(spark or SparkSession.builder.appName("gleanwork").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    now = datetime.now(UTC)
    past = ledger.read_ledger(spark, config.ledger_path)
    if args.command == "run":
        log = setup_logging(config.log_dir, now)
        verdicts = spark.read.parquet(args.verdicts) if args.verdicts else None
        if verdicts is None and not config.skip_classify:
            raise SystemExit("without --verdicts nothing passes the gate; --skip-classify has to be asked for")
        done = curate(tables.read_hits(spark, args.hits), spark.read.parquet(args.payloads), verdicts, past, config)
        stamp = now.isoformat(timespec="seconds")
        record(done, config.ledger_path, stamp, config)
        if config.manifest:
            ledger.write_manifest(ledger.read_ledger(spark, config.ledger_path), str(Path(config.out_dir, "manifest.json")), stamp)
        lines = [" ".join(f"{k}={v}" for k, v in done.counters.first().asDict().items())]
        log.info(lines[0])
    elif args.command == "stats":
        lines = reports.stats_lines(past)
    elif args.command == "report":
        newest = tables.latest_log(spark, args.log_dir or config.log_dir)
        log_lines = tables.read_log(spark, newest) if newest else None
        lines = reports.success_report(past, log_lines, now.date().isoformat(), newest).splitlines()
    else:
        found = images.image_metrics(tables.read_images(spark, f"{config.out_dir}/*/*"), config.audit)
        kept = ledger.newest_kept(past, args.sample).withColumn("_path", F.col("filepath"))
        named = found.withColumn("filepath", F.regexp_extract("filepath", r"([^/]+/[^/]+/[^/]+)$", 1))
        items = audit.with_flags(audit.mark_missing(kept.drop("_path"), named), config.audit).withColumn("llm", F.lit(None).cast("struct<quality:string,is_gray:boolean,reason:string>"))
        lines = audit.quality_report(items, [F.desc("created_at"), F.col("filepath")]).splitlines()
    print("\n".join(lines))
    return lines
