"""What changed between full snapshots of a table.

Gaps and islands: the versions of a record over the snapshots are folded into
validity intervals (runs of consecutive snapshots with the same row hash and
value); an interval's start, its end and its adjacency to the next interval
are the change events.

Defined results
- Rows of one key in one snapshot: the one with the greatest version columns
  counts (null versions are older than all others; the tracked values break
  ties, so the outcome never depends on row order).
- Snapshots are consecutive if no snapshot with a number between them exists
  anywhere in the table; numbers may have gaps. Rows with a null snapshot
  number belong to no snapshot and are left out.
- Null key parts are values like any other; null equals null in a tracked
  value, and null differs from the empty string.
- A key that is missing from a snapshot was removed there; if it comes back
  later it is added again. The first snapshot gives no events.
- An empty table, or one snapshot only, gives no rows. Extra columns are
  ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _latest(df: DataFrame, snapshot: str, key: list[str], value: list[str], version: list[str]) -> DataFrame:
    """One row per snapshot and key. max() combines before the shuffle, so a
    key that is repeated without bound inside a snapshot costs one row per task."""
    pick = F.max(F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(version)], F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(value)]).alias("v")))
    keyed = df.where(F.col(f"`{snapshot}`").isNotNull())
    return keyed.groupBy(F.col(f"`{snapshot}`").alias("snap"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]).agg(pick.alias("p")).select("snap", *[f"k{i}" for i in range(len(key))], "p.v")


def snapshot_index(df: DataFrame, snapshot: str) -> DataFrame:
    """(snap, idx): the existing snapshots, counted from 0 in their order. One
    row per snapshot, so the single-partition window holds the number of
    deliveries, not of records."""
    snaps = df.where(F.col(f"`{snapshot}`").isNotNull()).select(F.col(f"`{snapshot}`").alias("snap")).distinct()
    every = Window.orderBy("snap")
    return snaps.select("snap", (F.row_number().over(every) - 1).alias("idx"), F.lead("snap").over(every).alias("next_snap"))


def validity_intervals(df: DataFrame, snapshot: str, key: list[str], value: list[str], version: list[str]) -> DataFrame:
    """One row per key and run of consecutive snapshots with equal values:
    the key columns, ``first_idx``, ``last_idx`` (snapshot_index counts),
    ``first_snap``, ``after_snap`` (the snapshot after the run, null at the
    end of the table) and ``v`` (struct of the values).

    Both windows and the grouping share one hash partitioning on the key; a
    key holds at most one row per snapshot by then, so no task is unbounded.
    """
    k = [f"k{i}" for i in range(len(key))]
    rows = _latest(df, snapshot, key, value, version).join(snapshot_index(df, snapshot), "snap")
    rows = rows.withColumn("h", F.xxhash64("v"))
    by = Window.partitionBy(*k).orderBy("idx")
    same: Column = (F.lag("idx").over(by) == F.col("idx") - 1) & (F.lag("h").over(by) == F.col("h")) & F.lag("v").over(by).eqNullSafe(F.col("v"))
    rows = rows.withColumn("start", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*k, "island").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.min("snap").alias("first_snap"), F.max(F.struct("idx", "next_snap"))["next_snap"].alias("after_snap"),
        F.first("v").alias("v"))


def snapshot_changes(df: DataFrame, snapshot: str, key: list[str], value: list[str], version: list[str]) -> DataFrame:
    """(snapshot, *key, change): one row per event between two consecutive
    snapshots; ``change`` is added, removed or changed and the snapshot number
    is the later one."""
    k = [f"k{i}" for i in range(len(key))]
    by = Window.partitionBy(*k).orderBy("first_idx")
    runs = validity_intervals(df, snapshot, key, value, version)
    runs = runs.select(*k, "first_idx", "first_snap", "after_snap", (F.lag("last_idx").over(by) == F.col("first_idx") - 1).alias("touches"), (F.lead("first_idx").over(by) == F.col("last_idx") + 1).alias("touched"))
    began = F.when(F.coalesce("touches", F.lit(False)), F.lit("changed")).when(F.col("first_idx") > 0, F.lit("added"))
    ended = F.when(F.col("after_snap").isNotNull() & ~F.coalesce("touched", F.lit(False)), F.lit("removed"))
    event = F.explode(F.array(F.struct(F.col("first_snap").alias("s"), began.alias("c")), F.struct(F.col("after_snap").alias("s"), ended.alias("c"))))
    out = runs.select(*k, event.alias("e")).where("e.c is not null")
    return out.select(F.col("e.s").alias(snapshot), *[F.col(f"k{i}").alias(c) for i, c in enumerate(key)], F.col("e.c").alias("change"))
