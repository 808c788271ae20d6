"""Rows that fail to parse: load the sound ones, set the others aside.

A text is assembled into one record quote-aware (separators and line breaks
inside quotes belong to the field), read by Python's csv reader in strict
mode inside ``mapInArrow`` (the DataFrame form of mapPartitions), and only
then do the typed constructors run on its fields. No shuffle.

Defined results (the first reason that applies)
- One carriage return at the end of a text is not part of it.
- ``quoting``: a quoted field is not closed, is followed by something other
  than a separator or the end, or a quote stands in a field that does not
  begin with one.
- ``columns``: not as many fields as the layout has. A null text is
  ``columns``; an empty text is one empty field, so ``columns`` too.
- ``value``: a field's constructor refuses its text.
- Everything else is loaded: ``reason`` is null and the typed fields are set.
  Repeated rows are judged one by one. Texts of any length are read whole.
- Line breaks outside quotes are ordinary characters of their field.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Line breaks are carried through the reader as lone surrogates, which no
# decoded text can hold, so the reader never takes them for record ends.
_SHIELD = {10: 0xDC0A, 13: 0xDC0D}
_UNSHIELD = {0xDC0A: 10, 0xDC0D: 13}
_BREAKS = re.compile("[\r\n]")
_TOKEN = re.compile(r'("(?:[^"]|"")*"|[^,]*)(?:,|\Z)', re.S)


class Structure(ValueError):
    """A text is not a record of the layout; args[0] is the reason."""


def split_record(text: str | None, width: int) -> list[str]:
    """The fields of one record, or Structure('quoting' | 'columns')."""
    if text is None:
        raise Structure("columns")
    if text.endswith("\r"):
        text = text[:-1]
    shielded = _BREAKS.search(text) is not None
    if shielded:
        text = text.translate(_SHIELD)
    csv.field_size_limit(2**31 - 1)
    try:
        fields = next(csv.reader((text,), strict=True), [])
    except csv.Error:
        raise Structure("quoting") from None
    if '"' in text and any(t and t[0] != '"' and '"' in t for t in _TOKEN.findall(text)):
        raise Structure("quoting")
    if len(fields) != width:
        raise Structure("columns")
    return [f.translate(_UNSHIELD) for f in fields] if shielded else fields


# -- typed field constructors: text -> value, or ValueError --------------------

def required(text: str) -> str:
    if not text.strip(" "):
        raise ValueError(text)
    return text


def free(text: str) -> str:
    return text


def one_of(*names: str, any_case: bool = False) -> Callable[[str], str | None]:
    known = frozenset(names)

    def read(text: str) -> str | None:
        name = text.upper() if any_case and text.isascii() else text
        if name not in known:
            raise ValueError(text)
        return name or None

    return read


def positive(text: str, digits: int = 12) -> int:
    if not re.fullmatch(r"[0-9]{1,%d}" % digits, text) or int(text) < 1:
        raise ValueError(text)
    return int(text)


def optional_ipv4(text: str) -> str | None:
    if not text:
        return None
    if not re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text) or any(int(x) > 255 for x in text.split(".")):
        raise ValueError(text)
    return text


def timestamp(text: str) -> dt.datetime:
    m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})", text)
    if not m:
        raise ValueError(text)
    return dt.datetime(*map(int, m.groups()))  # noqa: DTZ001


#: The exported rule: name, Spark type, constructor.
RULE_LAYOUT: list[tuple[str, T.DataType, Callable]] = [
    ("source_name", T.StringType(), required),
    ("source_type", T.StringType(), one_of("EASYLIST", "DNS", "DNSMASQ", "CLASH", "SMARTDNS", "HOSTS", any_case=True)),
    ("line_no", T.LongType(), positive),
    ("origin", T.StringType(), required),
    ("target", T.StringType(), free),
    ("dest", T.StringType(), optional_ipv4),
    ("mode", T.StringType(), one_of("", "DENY", "ALLOW", "REWRITE")),
    ("type", T.StringType(), one_of("BASIC", "WILDCARD", "REGEX", "UNKNOWN")),
    ("fetched_at", T.TimestampNTZType(), timestamp),
]
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.TimestampNTZType(): pa.timestamp("us")}


def parse_rows(df: DataFrame, row_id: str, text: str, layout: list[tuple[str, T.DataType, Callable]] | None = None) -> DataFrame:
    """(row_id, reason, *fields): every row of ``df`` once. ``reason`` is null
    for a loaded row and the fields are null for a refused one. Only the two
    named columns are read, so other columns may have any names."""
    layout = layout or RULE_LAYOUT
    source = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{text}`").alias("row_text"))
    schema = T.StructType([T.StructField("row_id", source.schema["row_id"].dataType), T.StructField("reason", T.StringType())] + [T.StructField(n, t) for n, t, _ in layout])
    makers, kinds, names = [f for _, _, f in layout], [_ARROW[t] for _, t, _ in layout], [n for n, _, _ in layout]
    width = len(layout)
    nothing = (None,) * width

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons, rows = [], []
            for line in batch.column(1).to_pylist():
                try:
                    row = tuple(make(field) for make, field in zip(makers, split_record(line, width)))
                    reason = None
                except Structure as e:
                    row, reason = nothing, e.args[0]
                except ValueError:
                    row, reason = nothing, "value"
                reasons.append(reason)
                rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(reasons, pa.string())] + [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["row_id", "reason", *names])

    return source.mapInArrow(parse, schema)


def rejected(parsed: DataFrame) -> DataFrame:
    """(row_id, reason) of the refused rows."""
    return parsed.where("reason is not null").select("row_id", "reason")


def loaded(parsed: DataFrame) -> DataFrame:
    """The sound rows with their typed fields."""
    return parsed.where("reason is null").drop("reason")
