"""Reading lists: local files, HTTP, and raw contents, as numbered lines."""

from __future__ import annotations

import http.client as http_client
import logging
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from listweave.sources.config import Http, Input, Local

log = logging.getLogger(__name__)
_NO_LINES = "source_idx int, source_name string, source_type string, line_no bigint, line string"


def lines_of(contents: DataFrame, *keys: str) -> DataFrame:
    """(*keys, line_no, line) of whole contents: lines end with LF or CRLF, a
    lone CR stays in its line, numbers begin at 1. An unfinished last line
    counts; the nothing after a final line end does not."""
    cut = F.split("content", r"\r?\n", -1)
    whole = F.when(F.get(cut, F.size(cut) - 1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return contents.select(*[F.col(f"`{k}`") for k in keys], F.posexplode(whole).alias("no", "line")).select(*keys, (F.col("no") + 1).cast("bigint").alias("line_no"), "line")


def normalize_path(path: str, root: str | None = None) -> str:
    """Absolute paths (also like C:/x) stay; others lose one leading dot and
    one separator and go under ``root``, the working folder by default."""
    if path.startswith("/") or re.fullmatch(r"[a-zA-Z]:([/\\].*)?", path):
        return path
    path = path.removeprefix(".").removeprefix(os.sep)
    return f"{root or os.getcwd()}{os.sep}{path}"


def _marked(spark: SparkSession, uri: str) -> bool:
    """Whether the file begins with the UTF-8 byte order mark, which the text
    reader swallows and the lists keep."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)  # noqa: SLF001
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)  # noqa: SLF001
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def _numbered(spark: SparkSession, uri: str) -> DataFrame:
    """(line_no, line) of a UTF-8 file, read in as many tasks as it has splits.
    Splits count their lines first; a line's number is its place in its split
    behind the lines of the splits before it."""
    rows = spark.read.option("lineSep", "\n").text(uri)
    rows = rows.select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    # one row per split of the file: far below any broadcast limit
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    line = F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", "")
    if _marked(spark, uri):
        line = F.when(F.col("at") + F.col("shift") == 1, F.concat(F.lit("\ufeff"), line)).otherwise(line)
    return rows.join(F.broadcast(starts), "split").select((F.col("at") + F.col("shift")).alias("line_no"), line.alias("line"))


def read_local(spark: SparkSession, path: str, charset: str = "UTF-8", root: str | None = None) -> DataFrame:
    """(line_no, line) of a local file; a file that cannot be found is logged
    and gives no lines. Bytes that are no text in the charset become U+FFFD.
    UTF-8 files are read in splits; files of other charsets, and those whose
    name would have them unpacked, whole."""
    uri = "file://" + normalize_path(path, root)
    utf8 = charset.upper().replace("_", "-") in ("UTF-8", "UTF8")
    try:
        if utf8 and not re.search(r"\.(gz|bz2|zst|snappy|lz4|deflate)$", path):
            return _numbered(spark, uri)
        files = spark.read.format("binaryFile").load(uri)
    except AnalysisException as e:
        log.error("%s cannot be read: %s", path, e)
        return spark.createDataFrame([], "line_no bigint, line string")
    content = F.make_valid_utf8(F.col("content").cast("string")) if utf8 else F.decode("content", charset)
    return lines_of(files.select(content.alias("content")))


def _timed(kind: type, http: Http) -> type:
    """A connection class with a time limit for each phase of a request."""

    class Timed(kind):
        def connect(self) -> None:
            self.timeout = http.connect_timeout
            super().connect()
            self.sock.settimeout(http.write_timeout)

        def getresponse(self) -> http_client.HTTPResponse:
            self.sock.settimeout(http.response_timeout)
            sock = self.sock
            answer = super().getresponse()
            sock.settimeout(http.read_timeout)
            return answer

    return Timed


def _opener(http: Http) -> Callable:
    class Plain(urllib.request.HTTPHandler):
        def http_open(self, request: urllib.request.Request) -> object:
            return self.do_open(_timed(http_client.HTTPConnection, http), request)

    class Secure(urllib.request.HTTPSHandler):
        def https_open(self, request: urllib.request.Request) -> object:
            return self.do_open(_timed(http_client.HTTPSConnection, http), request)

    return urllib.request.build_opener(Plain, Secure).open


def fetch_http(url: str, http: Http, tries: int = 4, first_wait: float = 1.0, open_url: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The text behind a URL, or None. Connection failures and answers of 500
    and above are tried again three times, waiting twice as long each time;
    other answers are final. The body is taken in pieces of ``buffer_size``."""
    open_url = open_url or _opener(http)
    for attempt in range(tries):
        try:
            request = urllib.request.Request(url, headers={"Connection": "keep-alive"})  # noqa: S310
            with open_url(request) as answer:
                return b"".join(iter(lambda: answer.read(http.buffer_size), b"")).decode(http.charset, "replace")
        except urllib.error.HTTPError as e:
            failure: Exception = e
            if e.code < 500:
                break
        except (OSError, http_client.HTTPException) as e:
            failure = e
        if attempt < tries - 1:
            sleep(first_wait * 2**attempt)
    log.error("%s cannot be fetched: %s", url, failure)
    return None


_TIMES = ("connect_timeout", "read_timeout", "write_timeout", "response_timeout")


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("path", "").split("\n") if u]
        times = {k: float(options[k.replace("_", "")]) for k in _TIMES if k.replace("_", "") in options}
        self.http = Http(options.get("charset", "UTF-8"), **times, buffer_size=int(options.get("buffersize", 4096)))

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        content = fetch_http(partition.url, self.http)
        if content is not None:
            yield partition.url, content


class HttpLists(DataSource):
    """``spark.read.format("http_lists").load(url)``: (url, content), one task
    per URL. Register it with ``spark.dataSource.register(HttpLists)``."""

    @classmethod
    def name(cls) -> str:
        return "http_lists"

    def schema(self) -> str:
        return "url string, content string"

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return _HttpReader({k.lower(): v for k, v in self.options.items()})


def read_http(spark: SparkSession, url: str, http: Http | None = None) -> DataFrame:
    http = http or Http()
    spark.dataSource.register(HttpLists)
    reader = spark.read.format("http_lists").option("charset", http.charset).option("bufferSize", str(http.buffer_size))
    for name in _TIMES:
        reader = reader.option(name.replace("_", ""), str(getattr(http, name)))
    return lines_of(reader.load(url))


def transport_of(path: str) -> str:
    return "REMOTE" if path.startswith("http") else "LOCAL"


#: How lists are fetched, by transport.
TRANSPORTS: dict[str, Callable[[SparkSession, str, Http, Local, str | None], DataFrame]] = {
    "REMOTE": lambda spark, path, http, local, root: read_http(spark, path, http),  # noqa: ARG005
    "LOCAL": lambda spark, path, http, local, root: read_local(spark, path, local.charset, root),  # noqa: ARG005
}


def raw_lines(spark: SparkSession, inputs: tuple[Input, ...], http: Http | None = None, local: Local | None = None, root: str | None = None) -> DataFrame:
    """The lines of all inputs; source_idx is the place in the configuration,
    so that first-wins follows it however the sources are read."""
    out = spark.createDataFrame([], _NO_LINES)
    for i, item in enumerate(inputs):
        lines = TRANSPORTS[transport_of(item.path)](spark, item.path, http or Http(), local or Local(), root)
        out = out.unionByName(lines.select(F.lit(i).alias("source_idx"), F.lit(item.name).alias("source_name"), F.lit(item.type).alias("source_type"), "line_no", "line"))
    return out
