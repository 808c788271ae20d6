"""Where intermediate tables go.

A plan whose early part is costly (tokenising, sentence scoring) is cut by
writing a parquet table into the folder all executors share. That folder is
``spark.checkpoint.dir``; it is read from the session and only set here when
the session has none and runs in one process.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_inside: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    Raises RuntimeError on a cluster that names none: a folder of one machine
    would be unreadable for the others.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="listweave-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application, or to
    the innermost ``scratch``."""
    return "/".join([shared_dir(spark), "listweave", spark.sparkContext.applicationId, *_inside])


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back, with a
    folder for each value of the columns ``by``.

    The result has no lineage before the files, so a lost executor costs only
    the tasks it was running. Rows, columns and types are those of ``df``. The
    files stay until ``clear`` is called, because results are lazy.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end."""
    _inside.append(f"run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clear(spark)
        _inside.pop()


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that were not
    written or collected can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
