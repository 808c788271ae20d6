import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from listweave.operators.snapshots import snapshot_changes, validity_intervals

SCHEMA = "snap_no int, source_name string, entry_id bigint, line_no bigint, origin string, loaded_at timestamp"
ARGS = {"snapshot": "snap_no", "key": ["source_name", "entry_id"], "value": ["origin"], "version": ["loaded_at", "line_no"]}


def table(spark, rows):
    df = spark.createDataFrame([(s, n, e, o, t) for s, n, e, o, t in rows], "snap_no int, source_name string, entry_id bigint, origin string, t int")
    return df.select("snap_no", "source_name", "entry_id", F.lit(1).cast("bigint").alias("line_no"), "origin", F.timestamp_seconds("t").alias("loaded_at"))


def changes(spark, rows):
    return sorted(map(tuple, snapshot_changes(table(spark, rows), **ARGS).collect()), key=str)


def brute(rows):
    latest = {}
    for s, n, e, o, t in rows:
        k = (s, n, e)
        if k not in latest or (t is not None, t, o is not None, o) > latest[k][0]:
            latest[k] = ((t is not None, t, o is not None, o), o)
    snaps = sorted({s for s, *_ in rows if s is not None})
    state = defaultdict(dict)
    for (s, n, e), (_, o) in latest.items():
        state[s][n, e] = o
    out = []
    for a, b in zip(snaps, snaps[1:]):
        out += [(b, *k, "added") for k in state[b].keys() - state[a].keys()]
        out += [(b, *k, "removed") for k in state[a].keys() - state[b].keys()]
        out += [(b, *k, "changed") for k in state[a].keys() & state[b].keys() if state[a][k] != state[b][k]]
    return sorted(out, key=str)


def test_defined_cases(spark):
    rows = [
        (1, "a", 1, "x", 1), (3, "a", 1, "x", 1), (4, "a", 1, "x ", 1),  # gap in numbers, changed byte
        (1, "a", 2, "x", 1), (4, "a", 2, "x", 1),  # gone and back
        (1, "a", 3, None, 1), (3, "a", 3, "", 1), (4, "a", 3, None, 1),  # null is not empty
        (1, None, 1, "x", 1), (3, None, 1, "x", 1),  # null key, removed at the end
        (3, "b", 9, "new", 5), (3, "b", 9, "old", 2), (3, "b", 9, "old", None), (4, "b", 9, "new", 1),  # last loaded counts
    ]
    assert changes(spark, rows) == brute(rows)
    assert (4, "b", 9, "changed") not in changes(spark, rows)


def test_small_tables(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(5, "a", 1, "x", 1), (5, "a", 1, "x", 1)]) == []
    assert changes(spark, [(None, "a", 1, "x", 1), (5, "a", 2, "x", 1)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 2, 5, 6, 9]), rnd.choice(["a", "b", None]), rnd.randrange(6), rnd.choice(["x", "y", "", None]), rnd.randrange(50)) for _ in range(160)]
    assert changes(spark, rows) == brute(rows)


def test_clashing_names_and_intervals(spark):
    df = table(spark, [(1, "a", 1, "x", 1), (2, "a", 1, "x", 2), (3, "a", 1, "y", 2)])
    df = df.withColumn("snap", F.lit(0)).withColumn("idx", F.lit(0)).withColumn("k0", F.lit("z")).withColumn("v", F.lit(1)).withColumn("change", F.lit("q")).withColumn("odd.name", F.lit(1))
    assert [tuple(r) for r in snapshot_changes(df, **ARGS).collect()] == [(3, "a", 1, "changed")]
    runs = validity_intervals(df, **ARGS).select("first_snap", "after_snap", "v.v0").orderBy("first_snap")
    assert [tuple(r) for r in runs.collect()] == [(1, 3, "x"), (3, None, "y")]
