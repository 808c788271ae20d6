import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listweave.operators.reject_rows import Structure, loaded, parse_rows, rejected, split_record

GOOD = "L,HOSTS,1,0.0.0.0 a.de,a.de,0.0.0.0,DENY,BASIC,2025-01-31 23:59:59"


def reasons(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, row_text string")
    got = {r["row_id"]: r["reason"] for r in parse_rows(df, "row_id", "row_text").collect()}
    return [got[i] for i in range(len(texts))]


def with_(i, value):
    parts = GOOD.split(",")
    parts[i] = value
    return ",".join(parts)


def test_reasons(spark):
    cases = {
        GOOD: None, GOOD + "\r": None, GOOD + "\r\r": "value", GOOD + "\n": "value",
        with_(3, '"a,b ""q""\nc"'): None, with_(4, '""'): None, with_(4, "a b"): None, with_(4, "a\nb"): None,
        with_(3, '"a'): "quoting", with_(3, '"a"b'): "quoting", with_(3, 'a"b'): "quoting", with_(3, ' "a"'): "quoting", with_(8, '"2025-01-31 23:59:59'): "quoting",
        "a,b": "columns", "": "columns", GOOD + ",": "columns", 'a"b': "quoting",
        with_(0, "  "): "value", with_(0, "\t"): None, with_(3, ""): "value", with_(1, "hOsTs"): None, with_(1, "HOST"): "value", with_(1, "HO\u017fTS"): "value",
        with_(2, "0"): "value", with_(2, "000000000001"): None, with_(2, "0000000000001"): "value", with_(2, "+1"): "value", with_(2, "\u0663"): "value", with_(2, " 1"): "value",
        with_(5, ""): None, with_(5, "256.0.0.0"): "value", with_(5, "001.2.3.4"): None, with_(5, "1.2.3"): "value", with_(5, "0001.2.3.4"): "value",
        with_(6, ""): None, with_(6, "deny"): "value", with_(7, ""): "value", with_(7, "basic"): "value",
        with_(8, "2025-02-29 00:00:00"): "value", with_(8, "2024-02-29 00:00:00"): None, with_(8, "2025-01-31 24:00:00"): "value", with_(8, "2025-1-31 23:59:59"): "value", with_(8, "2025-01-31T23:59:59"): "value",
    }
    assert dict(zip(cases, reasons(spark, *cases))) == cases
    assert reasons(spark, None) == ["columns"]


def test_loaded_fields(spark):
    df = spark.createDataFrame([(1, with_(3, '"x,""y"""')), (2, None), (2, None), (3, with_(6, ""))], "row_id bigint, row_text string")
    parsed = parse_rows(df.selectExpr("*", "'x' as reason", "'y' as origin", "1 as `a.b`"), "row_id", "row_text")
    first, third = loaded(parsed).orderBy("row_id").collect()
    assert tuple(first) == (1, "L", "HOSTS", 1, 'x,"y"', "a.de", "0.0.0.0", "DENY", "BASIC", dt.datetime(2025, 1, 31, 23, 59, 59))  # noqa: DTZ001
    assert third["mode"] is None
    assert [tuple(r) for r in rejected(parsed).collect()] == [(2, "columns"), (2, "columns")]
    assert parse_rows(df.limit(0), "row_id", "row_text").count() == 0


def test_very_long(spark):
    assert reasons(spark, with_(4, "x" * 3_000_000), with_(4, '"' + ',"",\n' * 300_000 + '"')) == [None, None]


def machine(text):
    """The definition, character by character."""
    text = text.removesuffix("\r")
    fields, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if text[i] == '"':
                    if i + 1 < n and text[i + 1] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + text[i], i + 1
            if i < n and text[i] != ",":
                return "quoting"
        else:
            j = text.find(",", i)
            j = n if j < 0 else j
            value, i = text[i:j], j
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= n:
            return fields
        i += 1


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='a",\r\n \x00\u00e9', max_size=14))
def test_against_the_definition(text):
    expected = machine(text)
    try:
        got = split_record(text, len(expected) if isinstance(expected, list) else 3)
    except Structure as e:
        got = e.args[0]
    assert got == expected or (text.removesuffix("\r") == "" and got == "columns")


def test_width():
    with pytest.raises(Structure, match="columns"):
        split_record("a,b", 3)
