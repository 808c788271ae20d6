"""Gate, exclusion, truncation, deduplication, fan-out and statistics of rules.

Rows carry (source_idx, line_no); that pair is the order in which a rule was
met, so every step is deterministic whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listweave.functions.text import has_text, utf16_len
from listweave.operators.dialects import breaking, is_comment, parse_lines, renderings

MIN_LENGTH, MAX_LENGTH, ALERT_LENGTH = 0, 1024, 6


def gate_reason(line: Column, source_type: Column, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> Column:
    """Why a line is not parsed (blank, comment, short, long), else null."""
    out = F.when(~F.coalesce(has_text(line), F.lit(False)), "blank").when(is_comment(line, source_type), "comment")
    if min_length > 0:
        out = out.when(utf16_len(line) < min_length, "short")
    if max_length > 0:
        out = out.when(utf16_len(line) > max_length, "long")
    return out


def gate(lines: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    return lines.where(gate_reason(F.col("line"), F.col("source_type"), min_length, max_length).isNull())


def parsed(lines: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """Lines that pass the gate, parsed; ERROR and INVALID ones included."""
    return parse_lines(gate(lines, min_length, max_length))


def first_errors(lines: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """(source_idx, error_at): where a source breaks off. One row per source at
    most, which is configuration, so joins broadcast it."""
    at = breaking(gate(lines.where("source_type = 'SMARTDNS'"), min_length, max_length))
    return F.broadcast(at.groupBy("source_idx").agg(F.min("line_no").alias("error_at")))


def until_error(lines: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """Parsed lines up to the first ERROR of their source, without it and what
    follows. The cut is made on the lines, before they are parsed."""
    rows = lines.join(first_errors(lines, min_length, max_length), "source_idx", "left")
    return parsed(rows.where("error_at is null or line_no < error_at").drop("error_at"), min_length, max_length)


def exclude(rules: DataFrame, excludes: DataFrame) -> DataFrame:
    """Rules whose target is not listed exactly; rules without target stay."""
    return rules.join(excludes.select("target").distinct(), "target", "left_anti")


def suspicious(rules: DataFrame, alert_length: int = ALERT_LENGTH) -> DataFrame:
    return rules.where(utf16_len(F.col("origin")) <= alert_length)


def rule_key() -> list[Column]:
    """Columns that are equal for equal rules: the line for UNKNOWN ones, else
    target, mode, scope and type. Other fields don't count."""
    unknown = F.col("type") == "UNKNOWN"
    return [unknown.alias("ku"), F.when(unknown, F.col("origin")).otherwise(F.col("target")).alias("kt"), *[F.when(~unknown, F.col(c)).alias(f"k_{c}") for c in ("mode", "scope", "type")]]


def first_wins(rules: DataFrame) -> DataFrame:
    """One row per rule, the first met. Each task keeps one row per key before
    the shuffle, so a key held by any share of the rows costs a row per task."""
    first = Window.partitionBy(*rule_key()).orderBy("source_idx", "line_no")
    return rules.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def mark_excluded(rules: DataFrame, excludes: DataFrame) -> DataFrame:
    """``rules`` with ``excluded``, true for those ``exclude`` would drop."""
    listed = excludes.select("target").where("target is not null").distinct().withColumn("excluded", F.lit(True))
    return rules.join(listed, "target", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def _is_kept(rules: DataFrame) -> Column:
    """What goes on to deduplication: rules that are neither excluded nor, where
    a probe has been made, unresolved."""
    kept = (F.col("status") == "OK") & ~F.col("excluded")
    return kept & F.col("resolves") if "resolves" in rules.columns else kept


def source_stats(read: DataFrame) -> DataFrame:
    """(source_name, total, effective, repeat, invalid) of parsed lines with
    their mark ``excluded`` and, after a probe, ``resolves``; what does not
    resolve counts as invalid. total = invalid + excluded + repeat + effective.

    The lines are read and parsed once: they are counted per key and source in
    the tasks (a key, and all lines that are not kept, cost a row per source
    there), and the source of a key's first line gets the effective one.
    """
    kept = _is_kept(read)
    lost = (F.col("status") != "OK") | (~kept & ~F.col("excluded"))
    keys = [c.alias(f"g{i}") for i, c in enumerate(rule_key())]
    rows = read.select("source_name", "source_idx", "line_no", kept.alias("kept"), lost.alias("lost"), *keys)
    g = [f"g{i}" for i in range(len(keys))]
    rows = rows.withColumns({c: F.when(F.col("kept"), F.col(c)) for c in g})
    per_key = rows.groupBy("kept", "lost", *g, "source_name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_idx", "line_no")).alias("first"))
    first = F.min("first").over(Window.partitionBy("kept", "lost", *g))
    won = (F.col("kept") & (F.col("first") == first)).cast("bigint")
    counts = per_key.select("source_name", "kept", "lost", "n", won.alias("won"))
    counts = counts.groupBy("source_name").agg(
        F.sum("n").alias("total"), F.sum("won").alias("effective"),
        F.sum(F.when(F.col("kept"), F.col("n") - F.col("won")).otherwise(0)).alias("repeat"),
        F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("invalid"))
    return counts


def fan_out(rules: DataFrame, outputs: list[dict]) -> DataFrame:
    """(file, source_idx, line_no, line): each rule in each output that takes
    it. Outputs are configuration, so they are unrolled into one array per row
    and every dialect is rendered once; there is no join."""
    texts = renderings()
    used = sorted({o["type"] for o in outputs})
    rows = rules.select("source_idx", "line_no", "source_name", "type", *[texts[d].alias(f"_{d}") for d in used])
    made = []
    for o in outputs:
        takes = F.lit(True)
        if o.get("rule"):
            takes = takes & F.col("source_name").isin(*o["rule"])
        if o.get("filter"):
            takes = takes & F.col("type").isin(*o["filter"])
        made.append(F.struct(F.lit(o["name"]).alias("file"), F.when(takes, F.col(f"_{o['type']}")).alias("line")))
    if not made:
        return rows.select(F.lit("").alias("file"), "source_idx", "line_no", F.lit("").alias("line")).where("false")
    return rows.select("source_idx", "line_no", F.inline(F.filter(F.array(*made), lambda m: m["line"].isNotNull()))).select("file", "source_idx", "line_no", "line")


def output_totals(rendered: DataFrame, outputs: list[dict]) -> DataFrame:
    """(file, total), with 0 for outputs without rows."""
    spark = rendered.sparkSession
    names = spark.createDataFrame([(o["name"],) for o in outputs], "file string")
    counts = rendered.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    return names.join(counts, "file", "left").fillna(0, ["total"])


def _events(lines: DataFrame, excludes: DataFrame, min_length: int, max_length: int) -> DataFrame:
    """Every line once, parsed if it passes the gate, with ``event`` where it
    goes no further: blank, comment, short, long, invalid, error, lost (behind
    an error) or excluded."""
    reason = gate_reason(F.col("line"), F.col("source_type"), min_length, max_length)
    lines = lines.withColumn("_gate", reason)
    rows = parse_lines(lines.withColumn("line", F.when(F.col("_gate").isNull(), F.col("line"))))
    rows = mark_excluded(rows.join(first_errors(lines.drop("_gate"), min_length, max_length), "source_idx", "left"), excludes)
    event = (
        F.when((F.col("line_no") > F.col("error_at")), "lost").when(F.col("_gate").isNotNull(), F.col("_gate"))
        .when(F.col("status") == "ERROR", "error").when(F.col("status") == "INVALID", "invalid").when(F.col("excluded"), "excluded"))
    return rows.withColumn("event", event).drop("_gate", "error_at")


def audit(lines: DataFrame, excludes: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, alert_length: int = ALERT_LENGTH) -> DataFrame:
    """(source_idx, line_no, event): what became of every line before
    deduplication: see ``_events``, else suspicious (kept, but short) or kept."""
    rows = _events(lines, excludes, min_length, max_length)
    going = F.when(utf16_len(F.col("origin")) <= alert_length, "suspicious").otherwise("kept")
    return rows.select("source_idx", "line_no", F.coalesce("event", going).alias("event"))


def audit_trail(lines: DataFrame, excludes: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, alert_length: int = ALERT_LENGTH, unresolved: DataFrame | None = None) -> DataFrame:
    """(source_idx, source_name, line_no, event, suspicious): every line to its
    end: as ``_events`` says, else unresolved (listed in ``unresolved`` by
    (source_idx, line_no)), repeat or effective; ``suspicious`` marks short
    rules that were not excluded."""
    rows = _events(lines, excludes, min_length, max_length)
    short = F.col("event").isNull() & (utf16_len(F.col("origin")) <= alert_length)
    rows = rows.select("source_idx", "source_name", "line_no", "event", short.alias("suspicious"), *rule_key())
    if unresolved is not None:
        failed = unresolved.select("source_idx", "line_no").distinct().withColumn("_no", F.lit(True))
        rows = rows.join(failed, ["source_idx", "line_no"], "left")
        rows = rows.withColumn("event", F.when(F.col("event").isNull() & F.col("_no"), "unresolved").otherwise(F.col("event"))).drop("_no")
    # lines that end before have a key of their own, so none gathers in one task
    own = F.when(F.col("event").isNotNull(), F.struct("source_idx", "line_no"))
    keys = ["ku", "kt", "k_mode", "k_scope", "k_type"]
    place = F.row_number().over(Window.partitionBy(*[F.when(F.col("event").isNull(), F.col(c)) for c in keys], own).orderBy("source_idx", "line_no"))
    last = F.when(place == 1, "effective").otherwise("repeat")
    return rows.select("source_idx", "source_name", "line_no", F.coalesce("event", last).alias("event"), F.coalesce("suspicious", F.lit(False)).alias("suspicious"))
