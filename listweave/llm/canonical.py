"""Duplicates hidden by formatting differences.

Records whose texts hold the same runs of letters and digits, whatever their
case, order and separators, collapse into one record with its number of
copies. Filters of once- and repeatedly-seen canonical hashes are built task
by task and merged; only records whose hash may be repeated are shuffled, by
their full canonical key, and grouped exactly. All others are emitted as
singletons without a shuffle.

Defined results
- Canonical text: the runs of a-z and 0-9 of the text with A-Z folded (ASCII
  only), sorted, equal runs kept as often as they stand. A text without runs
  is the empty list; null equals only null.
- The record's id is the smallest id of its copies; ids are unique.
- Empty tables give no rows; a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.llm.bloom import SEGMENT_BLOCKS, might_contain, repeat_filter, words_for
from listweave.llm.keyed import HOT_SHARE, join_back, key_text
from listweave.storage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_runs(text: Column) -> Column:
    """Sorted runs of the text, joined by spaces; null for null."""
    runs = F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+")
    return F.array_join(F.sort_array(F.filter(runs, lambda r: r != "")), " ")


def canonical_key(same: list[Column], loose: list[Column]) -> Column:
    """Injective key of the columns to be equal and those to be equal canonically."""
    return key_text(*same, *[canonical_runs(c) for c in loose])


def _split(records: DataFrame, segment_blocks: int) -> tuple[DataFrame, int]:
    """(id, key, maybe_repeated), written once; only possible repeats keep their key."""
    n = records.count()
    n_words = words_for(n)
    hashed = records.select("id", "key", F.xxhash64("key").alias("h"))
    probed = might_contain(hashed, repeat_filter(hashed, n_words), "h", n_words, "maybe_repeated", segment_blocks)
    return materialize(probed.select("id", F.when(F.col("maybe_repeated"), F.col("key")).alias("key"), "maybe_repeated"), "repeats", "maybe_repeated"), n


def _groups(maybe: DataFrame) -> DataFrame:
    return maybe.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def collapse(records: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """(first_id, copies) per record of ``records`` (id, key)."""
    split, _ = _split(records, segment_blocks)
    singles = split.where("not maybe_repeated").select(F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("copies"))
    return singles.unionByName(_groups(split.where("maybe_repeated")).select("first_id", "copies"))


def copies(records: DataFrame, segment_blocks: int = SEGMENT_BLOCKS, hot_share: int = HOT_SHARE) -> DataFrame:
    """(first_id, copy_id): every row but the first of its record."""
    split, n = _split(records, segment_blocks)
    maybe = split.where("maybe_repeated").select("id", "key")
    back = join_back(maybe, _groups(maybe).where("copies > 1"), "key", "copies", n, hot_share)
    return back.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
