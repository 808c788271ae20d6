from listweave.operators import flow

LINES = "source_idx int, source_name string, source_type string, line_no bigint, line string"


def lines(spark, *sources):
    rows = [(i, f"s{i}", kind, n + 1, x) for i, (kind, *texts) in enumerate(sources) for n, x in enumerate(texts)]
    return spark.createDataFrame(rows, LINES)


def test_gate(spark):
    df = lines(spark, ("HOSTS", "", " ", "# c", "x" * 1024, "x" * 1025, "\U0001f600" * 513, "ab", None))
    assert [r["line_no"] for r in flow.gate(df).orderBy("line_no").collect()] == [4, 7]
    assert [r["line_no"] for r in flow.gate(df, 3, 0).orderBy("line_no").collect()] == [4, 5, 6]


def test_error_ends_only_its_source(spark):
    df = lines(spark, ("SMARTDNS", "address /a.de/#", "nonsense", "address /-b.de/#", "address /c.de/#"), ("SMARTDNS", "address /d.de/#"))
    assert sorted((r["source_idx"], r["line_no"], r["status"]) for r in flow.until_error(df).collect()) == [(0, 1, "OK"), (0, 2, "INVALID"), (1, 1, "OK")]


def test_exclude_is_exact_and_keeps_null_targets(spark):
    df = flow.parsed(lines(spark, ("EASYLIST", "||a.de^", "||A.de^", "@@||a.de^", "||x.a.de^", "||y.de^$popup")))
    listed = spark.createDataFrame([("a.de",), ("a.de",), (None,)], "target string")
    assert [r["line_no"] for r in flow.exclude(df, listed).orderBy("line_no").collect()] == [2, 4, 5]
    assert flow.exclude(df, listed.limit(0)).count() == 5


def test_first_wins_in_source_order(spark):
    df = lines(spark, ("DNS", "a.de", "1.2.3.4 b.de", "odd$x"), ("EASYLIST", "||a.de^", "@@a.de", "odd$x", "A.de"), ("HOSTS", "0.0.0.0 a.de", "9.9.9.9 b.de"))
    kept = flow.first_wins(flow.parsed(df).repartition(3))
    assert sorted((r["source_idx"], r["line_no"]) for r in kept.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 4)]
    assert flow.first_wins(kept).count() == kept.count()


def test_stats_add_up(spark):
    df = lines(spark, ("HOSTS", "0.0.0.0 a.de", "0.0.0.0 b.de", "junk", "0.0.0.0 a.de"), ("HOSTS", "0.0.0.0 a.de", "# c"), ("HOSTS", "junk"))
    excludes = spark.createDataFrame([("b.de",), ("b.de",), (None,)], "target string")
    read = flow.mark_excluded(flow.until_error(df), excludes)
    stats = {r["source_name"]: tuple(r)[1:] for r in flow.source_stats(read).collect()}
    assert stats == {"s0": (4, 1, 1, 1), "s1": (1, 0, 1, 0), "s2": (1, 0, 0, 1)}


def test_audit_trail(spark):
    df = lines(spark, ("HOSTS", "0.0.0.0 a.de", "0.0.0.0 b.de", "junk", "0.0.0.0 a.de", "# c"), ("SMARTDNS", "address /a.de/#", "address /-b.de/#", "address /c.de/#"), ("EASYLIST", "x.y", "||gone.de^"))
    excludes = spark.createDataFrame([("b.de",)], "target string")
    gone = spark.createDataFrame([(2, 2)], "source_idx int, line_no bigint")
    got = {(r["source_idx"], r["line_no"]): (r["event"], r["suspicious"]) for r in flow.audit_trail(df, excludes, unresolved=gone).collect()}
    assert [got[0, i][0] for i in range(1, 6)] == ["effective", "excluded", "invalid", "repeat", "comment"]
    assert [got[1, i][0] for i in range(1, 4)] == ["repeat", "error", "lost"]
    assert got[2, 1] == ("effective", True) and got[2, 2] == ("unresolved", False)


def test_no_join_shuffles_lines_by_source(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = lines(spark, ("SMARTDNS", "address /a.de/#"))
        plan = flow.until_error(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


OUTPUTS = [
    {"name": "all", "type": "EASYLIST", "filter": [], "rule": []},
    {"name": "one", "type": "HOSTS", "filter": ["BASIC"], "rule": ["s1"]},
    {"name": "none", "type": "CLASH", "filter": ["REGEX"], "rule": []},
]


def test_fan_out(spark):
    rules = flow.first_wins(flow.parsed(lines(spark, ("EASYLIST", "||a.de^", "/x+/"), ("HOSTS", "0.0.0.0 a.de", "1.1.1.1 b.de"))))
    out = flow.fan_out(rules, OUTPUTS)
    assert sorted((r["file"], r["line"]) for r in out.collect()) == [("all", "/x+/"), ("all", "||a.de^"), ("one", "1.1.1.1\tb.de")]
    assert {r["file"]: r["total"] for r in flow.output_totals(out, OUTPUTS).collect()} == {"all": 2, "one": 1, "none": 0}
    assert flow.fan_out(rules, []).count() == 0


def test_empty_tables(spark):
    df = lines(spark, ("HOSTS", "x")).limit(0)
    assert flow.fan_out(flow.first_wins(flow.until_error(df)), OUTPUTS).count() == 0
    assert flow.audit(df, spark.createDataFrame([], "target string")).count() == 0
