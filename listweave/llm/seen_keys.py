"""Has this key been seen before? Filter, then verify.

A Bloom filter of the stored keys and one of the keys that come repeatedly
among the arrivals are probed first. A record that neither may hold is new
and leaves at once with its id alone. The others are looked up exactly: their
full keys are shuffled and met by those stored keys on disk that a filter of
the looked-up keys lets through. What the lookup disproves is kept as the
measured error of the filter.

Defined results
- A key is its full text, compared byte for byte; null parts equal null
  parts. A record whose key is null is never seen.
- A record is ``seen`` if its key is stored or an arrival with a smaller
  record id has it; of equal arrivals the first is judged by the store alone.
- ``route`` is ``filter`` (decided by the filter), ``lookup`` (positive and
  confirmed), ``first`` (positive because later arrivals repeat it; not an
  error) or ``disproved`` (positive, but held by no other record).
- Every record comes out once; empty tables give no rows. A key may hold any
  share of the rows on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.llm.bloom import BITS_PER_KEY, SEGMENT_BLOCKS, membership_filter, might_contain, repeat_filter, words_for
from listweave.llm.keyed import HOT_SHARE, join_back, key_text
from listweave.storage import materialize


def rule_key(origin: Column, target: Column, mode: Column, scope: Column, type: Column) -> Column:
    """The rule key: origin for UNKNOWN rules, else target, mode, scope, type."""
    whole = F.concat(F.lit("U"), key_text(origin))
    return F.when(type.eqNullSafe(F.lit("UNKNOWN")), whole).otherwise(F.concat(F.lit("K"), key_text(target, mode, scope, type)))


def seen_before(arrivals: DataFrame, stored: DataFrame, segment_blocks: int = SEGMENT_BLOCKS, hot_share: int = HOT_SHARE, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(rec_id, seen, route) of every row of ``arrivals`` (rec_id, key), given
    ``stored`` (key)."""
    n_new, n_old = arrivals.count(), stored.count()
    new = arrivals.select("rec_id", "key", F.xxhash64("key").alias("h")).withColumn("h", F.when(F.col("key").isNotNull(), F.col("h")))
    old = stored.where("key is not null").select("key", F.xxhash64("key").alias("h"))
    w_old, w_new = words_for(n_old, bits_per_key), words_for(n_new, bits_per_key)

    probed = might_contain(new, membership_filter(old, w_old), "h", w_old, "in_store", segment_blocks)
    probed = might_contain(probed, repeat_filter(new, w_new), "h", w_new, "in_new", segment_blocks)
    positive = F.col("in_store") | F.col("in_new")
    # written once, negatives with their id alone; positives are counted per key, looked up and joined back
    only = lambda c: F.when(positive, F.col(c)).alias(c)
    routed = materialize(probed.select("rec_id", only("key"), only("h"), only("in_store"), positive.alias("positive")), "routed", "positive")
    negatives = routed.where("not positive").select("rec_id", F.lit(False).alias("seen"), F.lit("filter").alias("route"))
    asked = routed.where("positive")

    # one row per looked-up key; combined in the tasks first, so hot keys stay small
    keys = asked.groupBy("key").agg(F.min("rec_id").alias("first_rec"), F.count(F.lit(1)).alias("held"))
    w_asked = words_for(asked.where("in_store").count(), bits_per_key)
    wanted = membership_filter(asked.where("in_store").select("h"), w_asked)
    # the reverse filter leaves of the stored side only keys that may match; no other is shuffled
    on_disk = might_contain(old, wanted, "h", w_asked, "asked", segment_blocks).where("asked").select("key").distinct()
    looked_up = keys.join(on_disk.withColumn("stored", F.lit(True)), "key", "left").select("key", "first_rec", "held", F.coalesce("stored", F.lit(False)).alias("stored"))
    rows = join_back(asked.select("rec_id", "key"), looked_up, "key", "held", n_new, hot_share)
    seen = F.col("stored") | (F.col("rec_id") > F.col("first_rec"))
    route = F.when(seen, "lookup").when(F.col("held") > 1, "first").otherwise("disproved")
    return negatives.unionByName(rows.select("rec_id", seen.alias("seen"), route.alias("route")))


def error_report(decided: DataFrame) -> DataFrame:
    """One row: records, filter_negatives, positives, confirmed, first_of_repeats,
    disproved, false_positive_rate (disproved among the records no other holds;
    0 where there are none)."""
    n = lambda route: F.count_if(F.col("route") == route)
    counts = decided.agg(F.count(F.lit(1)).alias("records"), n("filter").alias("filter_negatives"), F.count_if(F.col("route") != "filter").alias("positives"), n("lookup").alias("confirmed"), n("first").alias("first_of_repeats"), n("disproved").alias("disproved"))
    rate = F.coalesce(F.try_divide("disproved", F.col("disproved") + F.col("filter_negatives")), F.lit(0.0))
    return counts.withColumn("false_positive_rate", rate)
