"""Queries p3_ and p4_ (changes between snapshots, rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listweave.operators.reject_rows import loaded, parse_rows, rejected
from listweave.operators.snapshots import snapshot_changes, validity_intervals
from listweave.plans.common import table

_SNAP = {"snapshot": "snap_no", "key": ["source_name", "entry_id"], "value": ["origin"], "version": ["loaded_at", "line_no"]}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "rule_snapshots"), **_SNAP)


def p3_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = validity_intervals(table(spark, sf_dir, "rule_snapshots"), **_SNAP)
    return runs.select(F.col("k0").alias("source_name"), F.col("k1").alias("entry_id"), F.col("first_snap").alias("valid_from"), F.col("after_snap").alias("valid_before"), F.col("v.v0").alias("origin"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parse_rows(table(spark, sf_dir, "rule_dump"), "row_id", "row_text"))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(parse_rows(table(spark, sf_dir, "rule_dump"), "row_id", "row_text"))


_LATEST = """
WITH snaps AS (
  SELECT snap_no, row_number() OVER (ORDER BY snap_no) - 1 AS idx, lead(snap_no) OVER (ORDER BY snap_no) AS next_no
  FROM (SELECT DISTINCT snap_no FROM rule_snapshots WHERE snap_no IS NOT NULL)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY snap_no, source_name, entry_id
    ORDER BY loaded_at DESC NULLS LAST, line_no DESC NULLS LAST, origin DESC NULLS LAST) AS rn
  FROM rule_snapshots),
r AS (SELECT s.idx, s.snap_no, s.next_no, source_name, entry_id, origin FROM ranked JOIN snaps s USING (snap_no) WHERE rn = 1)
"""

_FIELDS = r"""
WITH cut AS (
  SELECT row_id, CASE WHEN ends_with(row_text, chr(13)) THEN left(row_text, length(row_text) - 1) ELSE row_text END AS x FROM rule_dump),
judged AS (
  SELECT row_id, x IS NOT NULL AND NOT regexp_full_match(x, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS bad_quotes,
    regexp_extract_all(',' || x, ',("(?:[^"]|"")*"|[^",]*)', 1) AS parts FROM cut),
fields AS (
  SELECT row_id, bad_quotes, coalesce(len(parts), 0) AS n,
    list_transform(parts, lambda p: CASE WHEN starts_with(p, '"') THEN replace(substr(p, 2, length(p) - 2), '""', '"') ELSE p END) AS f FROM judged),
typed AS (
  SELECT row_id, f, CASE WHEN bad_quotes THEN 'quoting' WHEN n <> 9 THEN 'columns'
    WHEN trim(f[1], ' ') = '' OR trim(f[4], ' ') = ''
      OR NOT regexp_full_match(f[2], '(?i:easylist|dns|dnsmasq|clash|smartdns|hosts)')
      OR NOT regexp_full_match(f[3], '[0-9]{1,12}') OR regexp_full_match(f[3], '0+')
      OR NOT (f[6] = '' OR regexp_full_match(f[6], '((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])'))
      OR f[7] NOT IN ('', 'DENY', 'ALLOW', 'REWRITE') OR f[8] NOT IN ('BASIC', 'WILDCARD', 'REGEX', 'UNKNOWN')
      OR NOT regexp_full_match(f[9], '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}')
      OR try_strptime(f[9], '%Y-%m-%d %H:%M:%S') IS NULL THEN 'value' END AS reason FROM fields)
"""

QUERIES = {"p3_found": p3_found, "p3_intervals": p3_intervals, "p4_found": p4_found, "p4_loaded": p4_loaded}

ORACLE = {
    "p3_found": _LATEST + """
SELECT coalesce(b.snap_no, a.next_no) AS snap_no, coalesce(b.source_name, a.source_name) AS source_name,
  coalesce(b.entry_id, a.entry_id) AS entry_id,
  CASE WHEN a.idx IS NULL THEN 'added' WHEN b.idx IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM r a FULL JOIN r b ON b.idx = a.idx + 1 AND a.source_name IS NOT DISTINCT FROM b.source_name AND a.entry_id IS NOT DISTINCT FROM b.entry_id
WHERE (a.idx IS NULL AND b.idx > 0) OR (b.idx IS NULL AND a.next_no IS NOT NULL)
  OR (a.idx IS NOT NULL AND b.idx IS NOT NULL AND a.origin IS DISTINCT FROM b.origin)
""",
    "p3_intervals": _LATEST + """
, marked AS (SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 AND lag(origin) OVER w IS NOT DISTINCT FROM origin THEN 0 ELSE 1 END AS s
  FROM r WINDOW w AS (PARTITION BY source_name, entry_id ORDER BY idx)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY source_name, entry_id ORDER BY idx) AS island FROM marked)
SELECT source_name, entry_id, min(snap_no) AS valid_from, arg_max_null(next_no, idx) AS valid_before, any_value(origin) AS origin
FROM runs GROUP BY source_name, entry_id, island
""",
    "p4_found": _FIELDS + "SELECT row_id, reason FROM typed WHERE reason IS NOT NULL",
    "p4_loaded": _FIELDS + """
SELECT row_id, f[1] AS source_name, upper(f[2]) AS source_type, CAST(f[3] AS BIGINT) AS line_no, f[4] AS origin, f[5] AS target,
  nullif(f[6], '') AS dest, nullif(f[7], '') AS mode, f[8] AS type, strptime(f[9], '%Y-%m-%d %H:%M:%S') AS fetched_at
FROM typed WHERE reason IS NULL
""",
}
