"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens of its source
up to and including it, in shuffled order, divided by the source's target
weight (a further pass over a source begins where the last one ended). Read in
the order of that time, each prefix of the mixture follows the weights; the
mixture ends at the token budget.

Running sums are taken in two steps, so no task holds a source: the shuffled
order is a hash, its leading bits are a bucket of bounded size, bucket totals
give each bucket's offset, and the window runs inside a bucket.

Defined results
- The budget is the tokens of all documents together, also of those whose
  source is null or not listed; these are not used themselves.
- A source that has given all its permitted copies drops out and the others
  go on in the ratio of their weights, until the budget is full or nothing is
  left. A listed source without documents gives nothing and is reported.
- The mixture is a prefix of the global order: it ends before the first copy
  that would exceed the budget.
- Documents without tokens take their place in the order and cost nothing.
- Rows of equal id and size are separate documents; their order among
  themselves is free. Null weights, weights <= 0 and null or non-positive
  max_repeats give nothing; of several targets of one source the one with the
  greatest weight counts.
- Any number of sources: only the times of the queue come to the driver.
- Empty tables give an empty mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listweave.storage import materialize

#: Documents per bucket of the shuffled order, on average.
BUCKET_ROWS = 20_000
#: Up to so many sources (a name and three numbers each) are broadcast to the
#: documents; more are joined in SALTS shares, so that a large source is split.
BROADCAST_SOURCES, SALTS = 50_000, 64
_MIX = "source string, doc_id {id}, copy_no int, n_tokens bigint, finish double"


@dataclass(frozen=True)
class Plan:
    """The solved queue: ``sources`` (source, w, cap, size), one row for each
    of the ``count`` sources that have tokens and a target, and the virtual
    times before which everything, and after which nothing, is taken."""

    budget: int
    sources: DataFrame
    count: int
    sure: float
    possible: float


def _time_for(tokens: float, sources: DataFrame) -> float:
    """Virtual time at which the sources have given so many tokens together;
    infinite if they cannot. A source gives w tokens a unit of time until
    cap * size / w; between two such ends the sum is linear."""
    ends = sources.select((F.col("cap") * F.col("size") / F.col("w")).alias("end"), "w", (F.col("cap") * F.col("size")).cast("double").alias("all"))
    # one row of three numbers a source in this window
    until = Window.partitionBy(F.lit(0)).orderBy("end").rangeBetween(Window.unboundedPreceding, 0)
    rate = F.sum("w").over(Window.partitionBy(F.lit(0)))
    at = ends.select("end", "w", F.sum("all").over(until).alias("done"), (rate - F.sum("w").over(until)).alias("later"), F.sum("w").over(Window.partitionBy("end")).alias("ending"))
    spent = F.col("done") + F.col("end") * F.greatest("later", F.lit(0.0))
    first = at.where(spent >= tokens).agg(F.min(F.struct("end", spent.alias("spent"), (F.greatest("later", F.lit(0.0)) + F.col("ending")).alias("rate")))).first()[0]
    return math.inf if first is None else first["end"] - (first["spent"] - tokens) / first["rate"]


def plan(sized: DataFrame, targets: DataFrame) -> Plan:
    """``sized`` is (doc_id, source, n_tokens); ``targets`` (source, weight, max_repeats)."""
    wanted = targets.where("source is not null and weight > 0 and max_repeats > 0").groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t"))
    wanted = wanted.select("source", F.col("t.weight").cast("double").alias("w"), F.col("t.max_repeats").cast("bigint").alias("cap"))
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.max("n_tokens").alias("largest"))
    have = materialize(per_source.join(wanted, "source", "left"), "sources")
    budget = have.agg(F.sum("size")).first()[0] or 0
    sources = have.where("w is not null and size > 0")
    known = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("largest").alias("slack")).first()
    sources = sources.select("source", "w", "cap", "size")
    if not known["n"]:
        return Plan(budget, sources, 0, 0.0, 0.0)
    return Plan(budget, sources, known["n"], _time_for(budget, sources) * (1 - 1e-9), _time_for(budget + known["slack"], sources) * (1 + 1e-9))


def _with_source(rows: DataFrame, queue: Plan, broadcast_sources: int) -> DataFrame:
    if queue.count <= broadcast_sources:
        return rows.join(F.broadcast(queue.sources), "source")
    salted = queue.sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")


def mixture(sized: DataFrame, queue: Plan, seed: int = 42, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens, finish): one row per copy taken, in
    the order of ``finish`` over the partitions."""
    spark, kind = sized.sparkSession, sized.schema["doc_id"].dataType
    if not queue.count:
        return spark.createDataFrame([], _MIX.format(id=kind.simpleString()))
    bits = max(1, math.ceil(math.log2(max(sized.count() / BUCKET_ROWS, 2))))
    rows = _with_source(sized.select("source", "doc_id", "n_tokens"), queue, broadcast_sources)
    rows = rows.withColumn("r", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("r", 64 - bits))

    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("r", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("run", F.sum("n_tokens").over(inside)).join(offsets, ["source", "bucket"])
    placed = placed.select("source", "doc_id", "n_tokens", (F.col("offset") + F.col("run")).alias("at"), "w", F.col("cap").cast("int").alias("cap"), "size")
    reach = F.lit(float(queue.possible)) * F.col("w")
    passes = F.least(F.col("cap").cast("double"), F.floor((reach - F.col("at")) / F.col("size")) + 1).cast("int") if math.isfinite(queue.possible) else F.col("cap")
    taken = placed.withColumn("copy_no", F.explode(F.when(passes >= 1, F.sequence(F.lit(1), passes)).otherwise(F.array().cast("array<int>"))))
    taken = taken.select("source", "doc_id", "copy_no", "n_tokens", (((F.col("copy_no") - 1) * F.col("size") + F.col("at")) / F.col("w")).alias("finish"))
    if math.isfinite(queue.sure):
        sure = taken.where(F.col("finish") <= queue.sure)
        spent = sure.agg(F.sum("n_tokens")).first()[0] or 0
        # what lies between the two times is at most twice the largest document
        # of each source, whatever the size of the corpus: one task can order it
        edge = taken.where(F.col("finish") > queue.sure)
        order = Window.partitionBy(F.lit(0)).orderBy("finish", "source", "doc_id", "copy_no").rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("sum", F.sum("n_tokens").over(order)).where(F.col("sum") <= queue.budget - spent).drop("sum")
        taken = sure.unionByName(edge)
    return taken.repartitionByRange("finish").sortWithinPartitions("finish", "source", "doc_id", "copy_no")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """One row per listed source: source, weight, max_repeats, documents and
    available_tokens it has, copies and tokens in the mixture, most_copies of
    one document, share (of the mixture's tokens), budget_share and exhausted
    (all permitted copies are in)."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"), F.max("copy_no").alias("most_copies"))
    has = sized.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available_tokens"))
    out = targets.select("source", "weight", "max_repeats").join(has, "source", "left").join(got, "source", "left")
    out = out.fillna(0, ["documents", "available_tokens", "copies", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return out.select(
        "source", "weight", "max_repeats", "documents", "available_tokens", "copies", "tokens", "most_copies",
        F.coalesce(F.try_divide(F.col("tokens").cast("double"), total), F.lit(0.0)).alias("share"),
        F.lit(float(max(budget, 1))).alias("b"),
        (F.col("tokens") >= F.col("available_tokens") * F.col("max_repeats")).alias("exhausted"),
    ).withColumn("budget_share", F.col("tokens") / F.col("b")).drop("b")


def size_documents(documents: DataFrame, doc_id: str, text: str, source: str, **encoder: object) -> DataFrame:
    """(doc_id, source, n_tokens), written once because every later step needs it."""
    from listweave.llm.bpe import encode

    sized = encode(documents, doc_id, text, count_only=True, keep=[source], **encoder)
    return materialize(sized.withColumnRenamed(source, "source"), "sized")
