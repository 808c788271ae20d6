"""Queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listweave.llm import bpe, canonical, mixing, seen_keys, subjects, term_stats
from listweave.plans.common import table


def _term_fields() -> dict:
    c = F.col
    named = term_stats.whole_term(c("source_name"))
    return {
        "target": F.when(c("type").isin("BASIC", "WILDCARD"), term_stats.dotted_terms(c("target"))),
        "source_name": F.when(named != "", F.array(named)),
    }


def p1_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats.marked_frequencies(table(spark, sf_dir, "rules"), "rule_id", _term_fields())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_frequencies(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = seen_keys.rule_key(*[F.col(c) for c in ("origin", "target", "mode", "scope", "type")]).alias("key")
    return seen_keys.seen_before(table(spark, sf_dir, "incoming_rules").select("rec_id", key), table(spark, sf_dir, "rules").where("status = 'OK'").select(key))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).where("seen").select("rec_id")


def p2_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("rec_id", "seen")


def p2_disproved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of wrong answers: arrivals the filters took for seen and no other record holds."""
    return _decided(spark, sf_dir).where("route = 'disproved'").select("rec_id")


def p2_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_keys.error_report(_decided(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = canonical.canonical_key([F.col("mode"), F.col("type")], [F.col("origin"), F.col("target")])
    return table(spark, sf_dir, "rules").where("status = 'OK'").select(F.col("rule_id").alias("id"), key.alias("key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copies(_records(spark, sf_dir))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.collapse(_records(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, mixing.Plan]:
    targets = table(spark, sf_dir, "mix_targets")
    sized = mixing.size_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    queue = mixing.plan(sized, targets)
    return mixing.mixture(sized, queue), sized, targets, queue


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sized, targets, queue = _mixed(spark, sf_dir)
    return mixing.shares(mixed, sized, targets, queue.budget)


#: A document belongs to a subject if so many sentences or list items are about it.
NEED_UNITS = 3


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted(r["subject"] for r in table(spark, sf_dir, "subjects").select("subject").distinct().collect())
    return subjects.subject_units(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), names)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where(F.col("units") >= NEED_UNITS).select("doc_id", "subject")


def p8_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the corpus is made up: documents that belong to each subject, and units about it."""
    belongs = F.count_if(F.col("units") >= NEED_UNITS).alias("documents")
    return _judged(spark, sf_dir).groupBy("subject").agg(belongs, F.sum("units").alias("units"))


QUERIES = {
    "p1_found": p1_found, "p1_frequencies": p1_frequencies,
    "p2_found": p2_found, "p2_decisions": p2_decisions, "p2_disproved": p2_disproved, "p2_error_report": p2_error_report,
    "p5_found": p5_found, "p5_records": p5_records,
    "p6_ids": p6_ids,
    "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_mixtures": p8_mixtures, "p8_composition": p8_composition,
}

_TERMS = """
WITH t AS (
  SELECT 'target' AS field, rule_id, unnest(list_filter(list_transform(string_split(lower(target), '.'), lambda p: trim(p, ' ' || chr(9))), lambda p: p <> '')) AS term
  FROM rules WHERE type IN ('BASIC', 'WILDCARD')
  UNION ALL
  SELECT 'source_name', rule_id, trim(lower(source_name), ' ' || chr(9)) FROM rules WHERE trim(source_name, ' ' || chr(9)) <> ''),
n AS (SELECT field, count(DISTINCT rule_id) AS n FROM t GROUP BY field),
f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rule_id) AS records FROM t GROUP BY ALL),
m AS (SELECT field, term, occurrences, records,
  CASE WHEN records < 3 THEN 'rare' WHEN records * 20 > n THEN 'common' END AS mark FROM f JOIN n USING (field))
"""
_KEYS = """
WITH a AS (
  SELECT rec_id, CASE WHEN type = 'UNKNOWN' THEN {'o': origin, 't': NULL, 'm': NULL, 's': NULL, 'y': type} ELSE {'o': NULL, 't': target, 'm': mode, 's': scope, 'y': type} END AS k FROM incoming_rules),
s AS (
  SELECT DISTINCT CASE WHEN type = 'UNKNOWN' THEN {'o': origin, 't': NULL, 'm': NULL, 's': NULL, 'y': type} ELSE {'o': NULL, 't': target, 'm': mode, 's': scope, 'y': type} END AS k FROM rules WHERE status = 'OK'),
d AS (
  SELECT rec_id, s.k IS NOT NULL OR rec_id > min(rec_id) OVER (PARTITION BY a.k) AS seen FROM a LEFT JOIN s ON a.k IS NOT DISTINCT FROM s.k)
"""
_CANON = """
WITH c AS (
  SELECT rule_id, mode, type,
    list_sort(list_filter(regexp_split_to_array(translate(origin, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda r: r <> '')) AS o,
    list_sort(list_filter(regexp_split_to_array(translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda r: r <> '')) AS t
  FROM rules WHERE status = 'OK')
"""
ORACLE = {
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": _TERMS + "SELECT * FROM m",
    "p2_found": _KEYS + "SELECT rec_id FROM d WHERE seen",
    "p2_decisions": _KEYS + "SELECT rec_id, seen FROM d",
    "p5_found": _CANON + ", g AS (SELECT rule_id, min(rule_id) OVER (PARTITION BY mode, type, o, t) AS first_id FROM c) SELECT first_id, rule_id AS copy_id FROM g WHERE rule_id <> first_id",
    "p5_records": _CANON + "SELECT min(rule_id) AS first_id, count(*) AS copies FROM c GROUP BY mode, type, o, t",
}
