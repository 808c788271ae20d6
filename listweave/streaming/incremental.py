"""Lists that keep arriving: the same columns over a stream of lines.

Each micro-batch is parsed and deduplicated like a batch and then checked
against the rules kept so far by an anti join on the rule key; new ones are
appended under the number of their batch. A batch that is run again after a
failure replaces its own folder, so every rule is stored once.

First-wins is by arrival here: a rule that came in an earlier batch stays,
whatever the place of its source. A source that breaks off is cut where it
breaks within its batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listweave.operators import flow

LINES = "source_idx int, source_name string, source_type string, line_no bigint, line string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def keep_batch(batch: DataFrame, number: int, store: str) -> None:
    """Adds the new rules of one batch to the store."""
    spark = batch.sparkSession
    rules = flow.first_wins(flow.until_error(batch).where("status = 'OK'"))
    keys = flow.rule_key()
    named = rules.select("*", *keys)
    if _exists(spark, store):
        old = spark.read.option("basePath", store).parquet(store).where(F.col("batch") < number).select(*keys)
        names = [c for c in old.columns]
        old = old.select(*[F.col(c).alias(f"o_{c}") for c in names])
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
        named = named.join(old, same, "left_anti")
    named.select(*rules.columns).write.mode("overwrite").parquet(f"{store}/batch={number}")


def keep_rules(lines: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that keeps the rules of a stream of lines in ``store``."""
    writer = lines.writeStream.foreachBatch(lambda batch, number: keep_batch(batch, number, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay(lines: DataFrame, folder: str) -> DataFrame:
    """Sends ``lines`` through the stream in two arrivals (sources with even
    numbers, then odd ones) and reads the kept rules."""
    spark = lines.sparkSession
    root = f"{folder}/replay-{uuid.uuid4().hex}"
    for i in range(2):
        lines.where(F.col("source_idx") % 2 == i).select(*[x.split()[0] for x in LINES.split(", ")]).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(LINES).parquet(f"{root}/in")
        keep_rules(stream, f"{root}/store", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/store").drop("batch")
