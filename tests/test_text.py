from pyspark.sql import functions as F

from listweave.functions import text


def values(spark, make, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, c string")
    return [r[0] for r in df.select(make(F.col("c")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_blank_and_trim(spark):
    assert values(spark, lambda c: text.has_text(c), "", " \t", "\u3000", "\x1c", "\u00a0", "a", None) == [False, False, False, False, True, True, None]
    assert values(spark, lambda c: text.java_trim(c), "\x00 a \x1f", "\u00a0a", "a b") == ["a", "\u00a0a", "a b"]
    assert values(spark, lambda c: text.utf16_len(c), "", "ab", "é", "\U0001f600a", None) == [0, 2, 1, 3, None]


def test_cutting(spark):
    assert values(spark, lambda c: text.sub_after(c, "ab", last=True), "xabyabz", "xyz", "xab", None) == ["z", "", "", None]
    assert values(spark, lambda c: text.sub_after(c, "ab"), "xabyabz", "xyz") == ["yabz", ""]
    assert values(spark, lambda c: text.sub_before(c, "ab"), "xabyabz", "xyz") == ["x", ""]
    assert values(spark, lambda c: text.sub_before(c, "ab", last=True), "xabyabz", "xyz") == ["xaby", ""]
    assert values(spark, lambda c: text.sub_between(c, "'", "'"), "- 'a'b' c", "'", "''", "x") == ["a'b", "", "", ""]
    assert values(spark, lambda c: text.split_ignore_blank(c, "/"), "/a/ /b//", "", "a") == [["a", "b"], [], ["a"]]
    assert values(spark, lambda c: text.between(c, "[", "]"), "[a]", "[", "a]") == [True, False, False]
    assert values(spark, lambda c: text.starts_with_any(c, "#", "!"), "#a", "!a", " #", "") == [True, True, False, False]
    assert values(spark, lambda c: text.equals_any(c, "a", "b"), "a", "", "c") == [True, False, False]


def test_base_rule(spark):
    lines = ("a.example", "*.a.example", ".a.example", "a.example.", "ads", "", "a_b.example", "x" * 64 + ".de", "a..b", "a/b", "ads-*", "1.2.3.4", "a.example\r")
    assert values(spark, lambda c: text.base_rule(c), *lines) == ["BASIC", "WILDCARD", "WILDCARD", "WILDCARD", "WILDCARD", "WILDCARD", None, None, None, None, "WILDCARD", "BASIC", None]
    assert values(spark, lambda c: text.base_rule(c), "a." + "b" * 62 + "." + "c" * 200) == [None]
    assert values(spark, lambda c: text.is_ipv4(c), "1.2.3.4", "256.1.1.1", "01.002.3.4", "::1", "1.2.3.4\n") == [True, False, True, False, False]
