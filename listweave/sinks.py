"""Writing the output files: header, ordered body, one file per output."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listweave.operators.dialects import HEAD, commented


def header(output: dict, common: str, total: int, now: str, line_end: str = os.linesep) -> str:
    """The commented header of a file. The output's own template comes before
    the common one; ${date}, ${name}, ${desc} and ${type} are filled in before
    commenting, ${total} after. A dialect's fixed head follows."""
    text = ""
    template = output.get("file_header") or ""
    template = template if template.strip() else common
    if template.strip():
        values = {"date": now, "name": output["name"], "desc": output.get("desc") or "", "type": output["type"].lower()}
        for name, value in values.items():
            template = template.replace("${" + name + "}", value)
        text += commented(template, output["type"]).replace("${total}", str(total)) + line_end
    return text + (HEAD[output["type"]] + line_end if HEAD[output["type"]] else "")


def write_outputs(spark: SparkSession, rendered: DataFrame, outputs: list[dict], folder: str, common_header: str = "", now: str | None = None) -> dict[str, int]:
    """Writes each output into ``folder`` and returns the row counts.

    One job writes all bodies in order (ranges of file, source and line);
    then the part files of a file are appended to its header by the file
    system's streams, never through driver memory. An output without rows
    still gets its file. Existing files are replaced when the new ones are
    complete, by one rename; a failure raises and leaves them.
    """
    now = now or dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")  # noqa: DTZ005
    jvm = spark._jvm  # noqa: SLF001
    conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    try:
        ordered = rendered.repartitionByRange("file", "source_idx", "line_no").sortWithinPartitions("file", "source_idx", "line_no")
        ordered.select("file", F.col("line").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(f"{staging}/body")
        body = spark.read.schema("value string, file string").option("lineSep", "\n").text(f"{staging}/body")
        totals = {r["file"]: r["n"] for r in body.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
        for o in outputs:
            whole = path(f"{staging}/whole-{uuid.uuid4().hex}")
            stream = fs.create(whole)
            try:
                stream.write(bytearray(header(o, common_header, totals.get(o["name"], 0), now).encode()))
                for part in _parts(jvm, fs, path, f"{staging}/body", o["name"]):
                    source = fs.open(part)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
                    finally:
                        source.close()
            finally:
                stream.close()
            _replace(spark, fs, whole, path(f"{folder.rstrip('/')}/{o['name']}"))
    finally:
        fs.delete(path(staging), True)
    return {o["name"]: totals.get(o["name"], 0) for o in outputs}


def _replace(spark: SparkSession, fs: object, made: object, final: object) -> None:
    """Moves a finished file over another of that name in one step."""
    if fs.getUri().getScheme() == "file":  # Hadoop would delete the old one first
        old = final.toUri().getPath()
        checksum = os.path.join(os.path.dirname(old), f".{os.path.basename(old)}.crc")
        if os.path.exists(checksum) and not os.path.isdir(old):
            os.remove(checksum)
        os.replace(made.toUri().getPath(), old)
        return
    hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)  # noqa: SLF001
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(made), fs.makeQualified(final), how)  # noqa: SLF001


def _parts(jvm: object, fs: object, path: object, body: str, name: str) -> list:
    """The part files of one output in the order of their numbers."""
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = path(f"{body}/file={escape(name)}")
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    return sorted(found, key=lambda p: p.getName())
