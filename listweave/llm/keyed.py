"""Exact helpers on text keys: injective key texts and joins back to hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key held by one in so many rows is hot; at most so many keys can be.
HOT_SHARE = 1000


def key_text(*parts: Column) -> Column:
    """One string for a tuple of strings, different for different tuples; null
    parts are told apart from empty ones by their length mark."""
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def join_back(rows: DataFrame, per_key: DataFrame, key: str, held: str, total: int, hot_share: int = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row per key) on ``key``.

    ``held`` counts a key's rows and ``total`` all rows, so the keys with
    held * hot_share >= total number at most ``hot_share``: those are
    broadcast and their rows stay where they are, however many. The other keys
    have less than total / hot_share rows each and are shuffled.
    """
    is_hot = F.col(held) * hot_share >= F.lit(total)
    hot = F.broadcast(per_key.where(is_hot).withColumn("_hot", F.lit(True)))
    cold = per_key.where(~is_hot)
    marks = F.broadcast(per_key.where(is_hot).select(key))
    return rows.join(hot, key).drop("_hot").unionByName(rows.join(marks, key, "left_anti").join(cold, key))
