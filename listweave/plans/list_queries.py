"""Queries of the list operators over raw_lines, rules, inputs, outputs and excludes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listweave.functions import text
from listweave.operators import flow
from listweave.operators.dialects import DIALECTS, renderings
from listweave.plans.common import table
from listweave.plans.list_sql import ORACLE  # noqa: F401
from listweave.sinks import header
from listweave.sources.config import output_items

CLOCK = "2025-03-03 02:00:00"
_SHOWN = ["origin", "source_type", "target", "dest", "mode", "scope", "type"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_lines")


def _outputs(spark: SparkSession, sf_dir: str) -> list[dict]:
    return output_items(table(spark, sf_dir, "outputs"))


def _flat(rules: DataFrame) -> DataFrame:
    """Controls as text, so that results compare as plain columns."""
    return rules.withColumn("controls", F.array_join("controls", "+"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.exclude(flow.until_error(_lines(spark, sf_dir)).where("status = 'OK'"), table(spark, sf_dir, "excludes"))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.first_wins(_kept(spark, sf_dir))


def gate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.gate(_lines(spark, sf_dir)).select("source_idx", "line_no", "line")


def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.gate(_lines(spark, sf_dir), 8, 60).select("source_idx", "line_no", "line")


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.audit(_lines(spark, sf_dir), table(spark, sf_dir, "excludes"))


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.audit_trail(_lines(spark, sf_dir), table(spark, sf_dir, "excludes"), alert_length=9)


def _parse(dialect: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _lines(spark, sf_dir).where(F.col("source_type") == dialect)
        return _flat(flow.parsed(lines)).select("source_idx", "line_no", *_SHOWN, "controls", "status")

    return run


def classify_base_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("source_idx", "line_no", text.base_rule(F.col("line")).alias("base"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return _lines(spark, sf_dir).select(
        "source_idx", "line_no",
        text.starts_with_any(c, "||", "@@").alias("anchored"), text.between(c, "/", "/").alias("pattern"),
        text.sub_before(c, ".").alias("before_first"), text.sub_before(c, ".", last=True).alias("before_last"),
        text.sub_after(c, ".").alias("after_first"), text.sub_after(c, ".", last=True).alias("after_last"),
        text.sub_between(c, "a", "e").alias("inner"), F.size(text.split_ignore_blank(c, "/")).cast("bigint").alias("parts"),
        text.equals_any(c, "||^", "@@").alias("empty_rule"), text.java_trim(c).alias("trimmed"),
        text.utf16_len(c).cast("bigint").alias("units"), text.has_text(c).alias("has_text"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listweave.sources.lists import lines_of

    return lines_of(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("content")), "doc_id").select("doc_id", "line_no", "line")


def first_error_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.until_error(_lines(spark, sf_dir)).select("source_idx", "line_no", "origin", "status")


def exclude_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("source_idx", "line_no", "origin", "target")


def suspicious_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.suspicious(_kept(spark, sf_dir)).select("source_idx", "line_no", "origin")


def short_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert with a longer limit, which the test tables do reach."""
    return flow.suspicious(_kept(spark, sf_dir), 9).select("source_idx", "line_no", "origin")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_effective(spark, sf_dir)).select("source_idx", "line_no", "source_name", *_SHOWN, "controls")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.source_stats(flow.mark_excluded(flow.until_error(_lines(spark, sf_dir)), table(spark, sf_dir, "excludes")))


def _render(dialect: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = table(spark, sf_dir, "rules").where("status = 'OK'")
        return rules.select("rule_id", renderings()[dialect].alias("line")).where("line is not null")

    return run


def fanout_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.fan_out(table(spark, sf_dir, "rules").where("status = 'OK'"), _outputs(spark, sf_dir))


def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.fan_out(_effective(spark, sf_dir), _outputs(spark, sf_dir))


def output_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = _outputs(spark, sf_dir)
    return flow.output_totals(flow.fan_out(_effective(spark, sf_dir), outputs), outputs)


def render_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = _outputs(spark, sf_dir)
    totals = {r["file"]: r["total"] for r in flow.output_totals(flow.fan_out(_effective(spark, sf_dir), outputs), outputs).collect()}
    rows = [(o["name"], header(o, "Lists ${type}\n\n  by ${name}: ${desc}\nTotal ${total}", totals[o["name"]], CLOCK, "\n")) for o in outputs]
    return spark.createDataFrame(rows, "file string, header string")


def dns_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in resolver knows every name but those under .invalid."""
    from listweave.operators.probe import drop_unresolved
    from listweave.storage import materialize

    kept = materialize(_kept(spark, sf_dir).select("source_idx", "line_no", "origin", "target", "type", "scope"), "kept")
    return drop_unresolved(kept, _stand_in).select("source_idx", "line_no", "origin")


def _stand_in(name: str) -> bool:
    return not name.endswith(".invalid")


def incremental_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of two arrivals of lines, kept by the streaming store, equal those of one batch over both."""
    from listweave.storage import own_folder
    from listweave.streaming.incremental import replay

    return _flat(replay(_lines(spark, sf_dir), own_folder(spark))).select("source_idx", "line_no", "origin", "target", "mode", "scope", "type")


QUERIES = {
    "gate_lines": gate_lines, "length_gate": length_gate, "audit_lines": audit_lines, "audit_trail": audit_trail,
    **{f"parse_{d.lower()}": _parse(d) for d in DIALECTS},
    "classify_base_rule": classify_base_rule, "text_helpers": text_helpers, "split_lines": split_lines,
    "first_error_truncation": first_error_truncation, "exclude_rules": exclude_rules, "suspicious_rules": suspicious_rules, "short_rules": short_rules,
    "dedup_first_wins": dedup_first_wins, "source_stats": source_stats,
    **{f"render_{d.lower()}": _render(d) for d in DIALECTS},
    "fanout_outputs": fanout_outputs, "output_totals": output_totals, "render_header": render_header,
    "dns_filtered": dns_filtered, "end_to_end": end_to_end, "incremental_lists": incremental_lists,
}
