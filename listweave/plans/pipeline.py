"""The whole job: configured inputs to output files."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listweave.operators import flow
from listweave.operators.probe import Lookup, ServerLookup, asked_for, probed, system_lookup
from listweave.sinks import write_outputs
from listweave.sources.config import Config, load_config
from listweave.sources.lists import raw_lines
from listweave.storage import materialize, scratch

log = logging.getLogger(__name__)


@dataclass
class Plan:
    """The tables of a run; nothing is computed until one of them is used."""

    read: DataFrame
    kept: DataFrame
    effective: DataFrame
    rendered: DataFrame
    stats: DataFrame
    trail: DataFrame


@dataclass
class Report:
    """What a run has done: rows per output file, the sources' counts, the
    events of the lines by kind, the lookups made, and the seconds it took."""

    totals: dict[str, int]
    sources: dict[str, dict[str, int]]
    events: dict[str, int]
    lookups: dict[str, int]
    seconds: float


def plan(lines: DataFrame, config: Config, lookup: Lookup | None = None) -> Plan:
    p = config.parser
    excludes = lines.sparkSession.createDataFrame([(x,) for x in p.excludes], "target string")
    read, failed = flow.mark_excluded(flow.until_error(lines, p.min_length, p.max_length), excludes), None
    if p.dns_probe.enable:
        lookup = lookup or (ServerLookup(list(p.dns_probe.provider), p.dns_probe.timeout) if p.dns_probe.provider else system_lookup)
        read = materialize(probed(read, lookup, p.dns_probe.parallel, F.col("status").eqNullSafe("OK") & ~F.col("excluded")), "probed")  # a lookup is never repeated
        failed = read.where("not resolves")
    kept = read.where("status = 'OK' and not excluded" + (" and resolves" if failed is not None else "")).drop("excluded", "resolves")
    effective = flow.first_wins(kept)
    trail = flow.audit_trail(lines, excludes, p.min_length, p.max_length, p.alert_length, failed)
    return Plan(read, kept, effective, flow.fan_out(effective, [o.item() for o in config.output]), flow.source_stats(read), trail)


def run(spark: SparkSession, config: Config, lookup: Lookup | None = None, now: str | None = None, root: str | None = None, audit_path: str | None = None) -> Report:
    """Reads, cleans and writes everything. Each source is fetched once: its
    lines are written to the shared folder first. Intermediate tables are
    deleted at the end, also after a failure. ``audit_path`` keeps the fate of
    every line as a table."""
    began = time.monotonic()
    with scratch(spark):
        lines = materialize(raw_lines(spark, config.input, config.http, config.local, root), "lines")
        made = plan(lines, config, lookup)
        folder = config.path if "://" in config.path or config.path.startswith("/") else f"{root or '.'}/{config.path}"
        totals = write_outputs(spark, made.rendered, [o.item() for o in config.output], folder, config.file_header, now)
        for name, n in totals.items():
            log.info("[%s] written completed, total size => %d", name, n)
        counts = {r["source_name"]: {k: r[k] for k in ("total", "effective", "repeat", "invalid")} for r in made.stats.collect()}
        sources = {i.name: counts.get(i.name, dict.fromkeys(("total", "effective", "repeat", "invalid"), 0)) for i in config.input}
        for name, c in sources.items():
            log.info("[%s] total: %d, effective: %d, repeat: %d, invalid: %d", name, c["total"], c["effective"], c["repeat"], c["invalid"])
        trail = made.trail
        if audit_path:
            trail.write.mode("overwrite").parquet(audit_path)
            trail = spark.read.schema(trail.schema).parquet(audit_path)
        events = {r["event"]: r["n"] for r in trail.groupBy("event").agg(F.count(F.lit(1)).alias("n")).collect()}
        events["suspicious"] = trail.where("suspicious").count()
        lookups = {}
        if config.parser.dns_probe.enable:
            asked = asked_for(made.read, F.col("status").eqNullSafe("OK") & ~F.col("excluded"))
            n = asked.agg(F.count("target").alias("wanted"), F.count_distinct("target").alias("queries")).first()
            lookups = {"wanted": n["wanted"], "queries": n["queries"], "cache_hits": n["wanted"] - n["queries"]}
            log.info("lookups: %d queries, %d answered from earlier ones", lookups["queries"], lookups["cache_hits"])
    report = Report(totals, sources, events, lookups, time.monotonic() - began)
    log.info("all done in %.1f s", report.seconds)
    return report


def main() -> None:
    args = argparse.ArgumentParser(description="Read filter lists, clean them and write output files.")
    args.add_argument("config", help="YAML file")
    args.add_argument("--audit", help="folder for a table of what became of every line")
    given = args.parse_args()
    config = load_config(given.config)
    logging.basicConfig(level=LEVELS.get(config.parser.log_level.upper(), logging.INFO))
    spark = SparkSession.builder.appName("listweave").getOrCreate()
    report = run(spark, config, audit_path=given.audit)
    for name, c in report.sources.items():
        print(name, *(f"{k}: {v}" for k, v in c.items()))
    for name, n in report.totals.items():
        print(name, n)


#: Names of log levels in the configuration.
LEVELS = {"TRACE": logging.DEBUG, "DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARN": logging.WARNING, "ERROR": logging.ERROR}


if __name__ == "__main__":
    main()
