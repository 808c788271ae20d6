"""One case per defined behaviour of the six dialects."""

import pytest
from pyspark.sql import functions as F

from listweave.operators import flow
from listweave.operators.dialects import commented, dialect_of, parse_lines, renderings

FIELDS = ("source_type", "target", "dest", "mode", "scope", "type", "controls", "status")


def parse(spark, dialect, *lines):
    df = spark.createDataFrame([(i, dialect, x) for i, x in enumerate(lines)], "i int, source_type string, line string")
    return [tuple(r) for r in parse_lines(df).orderBy("i").select(*FIELDS).collect()]


NOTHING = (None, None, None, None, None, None, [], "INVALID")


def ok(tag, target, dest, mode, scope, type, *controls):
    return (tag, target, dest, mode, scope, type, list(controls), "OK")


CASES = [
    ("EASYLIST", "||a.example^", ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC", "OVERLAY", "QUALIFIER")),
    ("EASYLIST", "@@||a.example^$important", ok("EASYLIST", "a.example", None, "ALLOW", "DOMAIN", "BASIC", "IMPORTANT", "OVERLAY", "QUALIFIER")),
    ("EASYLIST", "||a.example^$ all ", ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC", "OVERLAY", "QUALIFIER", "ALL")),
    ("EASYLIST", "||a.example^$important,popup", ok("EASYLIST", None, None, "DENY", None, "UNKNOWN", "OVERLAY")),
    ("EASYLIST", "||a.example^$popup$x", ok("EASYLIST", None, None, "DENY", None, "UNKNOWN", "OVERLAY")),
    ("EASYLIST", "||^", ok("EASYLIST", "", "0.0.0.0", "DENY", "DOMAIN", "WILDCARD", "OVERLAY", "QUALIFIER")),
    ("EASYLIST", "@@", ok("EASYLIST", "", None, "ALLOW", "DOMAIN", "WILDCARD")),
    ("EASYLIST", "$important", ok("EASYLIST", "", "0.0.0.0", "DENY", "DOMAIN", "WILDCARD", "IMPORTANT")),
    ("EASYLIST", "/ads/", ok("EASYLIST", "ads", "0.0.0.0", "DENY", "DOMAIN", "WILDCARD")),
    ("EASYLIST", "/a.example/", ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC")),
    ("EASYLIST", "/ad[0-9]+x/", ok("EASYLIST", "ad[0-9]+x", None, "DENY", "DOMAIN", "REGEX")),
    ("EASYLIST", "//", ok("EASYLIST", None, None, "DENY", "DOMAIN", "UNKNOWN")),
    ("EASYLIST", "||a.example^ ", ok("EASYLIST", None, None, "DENY", "DOMAIN", "UNKNOWN", "OVERLAY")),
    ("EASYLIST", "*.a.example", ok("EASYLIST", "*.a.example", "0.0.0.0", "DENY", "DOMAIN", "WILDCARD")),
    ("DNS", "127.0.0.1\ta.example", ok("HOSTS", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC")),
    ("DNS", "1.2.3.4 a.example", ok("HOSTS", "a.example", "1.2.3.4", "REWRITE", "DOMAIN", "BASIC")),
    ("DNS", "1.2.3.4 1.2.3.4", ok("HOSTS", "1.2.3.4", "1.2.3.4", "REWRITE", "DOMAIN", "BASIC")),
    ("DNS", "127.0.0.1 localhost", ok("DNS", None, None, "DENY", "DOMAIN", "UNKNOWN")),
    ("DNS", "||a.example^$client=x", ok("DNS", None, None, "DENY", None, "UNKNOWN", "OVERLAY")),
    ("DNSMASQ", "address=/a.example/", ok("DNSMASQ", "a.example", None, "DENY", "DOMAIN", "BASIC")),
    ("DNSMASQ", "address=/a.example/127.0.0.1", ok("DNSMASQ", "a.example", "127.0.0.1", "DENY", "DOMAIN", "BASIC")),
    ("DNSMASQ", "address=/a.example/#", ok("DNSMASQ", "a.example", "#", "REWRITE", "DOMAIN", "BASIC")),
    ("DNSMASQ", "address=/a /10.0.0.1 # c", ok("DNSMASQ", "a ", "10.0.0.1 # c", "REWRITE", "DOMAIN", "BASIC")),
    ("DNSMASQ", "address=/x/1 address=/y/2", ok("DNSMASQ", "y", "2", "REWRITE", "DOMAIN", "BASIC")),
    ("DNSMASQ", "address=/a/b/c", NOTHING),
    ("DNSMASQ", "server=/a/", NOTHING),
    ("CLASH", "payload:", NOTHING),
    ("CLASH", "- '+.a.example'", ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC", "OVERLAY")),
    ("CLASH", "  - '+.a.example'", ok("EASYLIST", "- '+.a.example'", "0.0.0.0", "DENY", "DOMAIN", "UNKNOWN")),
    ("CLASH", '- "a.example" # x', ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC")),
    ("CLASH", "*.a.example", ok("EASYLIST", None, None, None, None, "UNKNOWN")),
    ("CLASH", "ads.*.a.example", ok("EASYLIST", "ads.*.a.example", "0.0.0.0", "DENY", "DOMAIN", "WILDCARD")),
    ("CLASH", "+a.example", ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC", "OVERLAY")),
    ("CLASH", "- '", ok("EASYLIST", "", "0.0.0.0", "DENY", "DOMAIN", "UNKNOWN")),
    ("SMARTDNS", "address /a.example/#", ok("EASYLIST", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC", "OVERLAY")),
    ("SMARTDNS", "address /*.a.example/-", ok("EASYLIST", "*.a.example", "0.0.0.0", "ALLOW", "DOMAIN", "WILDCARD", "OVERLAY")),
    ("SMARTDNS", "address /a.example/#6", ok("EASYLIST", None, None, None, None, "UNKNOWN")),
    ("SMARTDNS", "address /a.example/", NOTHING),
    ("SMARTDNS", "address /-.a.example/#", (None, None, None, None, None, None, [], "ERROR")),
    ("SMARTDNS", "address /.a.example/-", (None, None, None, None, None, None, [], "ERROR")),
    ("SMARTDNS", "address /-a.example/#6", ok("EASYLIST", None, None, None, None, "UNKNOWN")),
    ("HOSTS", "127.0.0.1 localhost.localdomain", ok("HOSTS", "localhost.localdomain", "127.0.0.1", "REWRITE", "DOMAIN", "BASIC")),
    ("HOSTS", "  0.0.0.0 \t a.example ", ok("HOSTS", "a.example", "0.0.0.0", "DENY", "DOMAIN", "BASIC")),
    ("HOSTS", "127.0.0.1 localhost", NOTHING),
    ("HOSTS", "0.0.0.0 0.0.0.0", NOTHING),
    ("HOSTS", "::1 a.example", NOTHING),
    ("HOSTS", "0.0.0.0 a.example # c", NOTHING),
    ("HOSTS", None, NOTHING),
    (None, "a.example", NOTHING),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, d, x) for i, (d, x, _) in enumerate(CASES)], "i int, source_type string, line string")
    got = [tuple(r) for r in parse_lines(df).orderBy("i").select(*FIELDS).collect()]
    assert {CASES[i][:2]: g for i, g in enumerate(got)} == {c[:2]: c[2] for c in CASES}


RULES = [  # type, mode, target, dest, tag, controls -> easylist, dns, dnsmasq, clash, smartdns, hosts
    (("BASIC", "DENY", "a.de", "0.0.0.0", "EASYLIST", ["OVERLAY", "QUALIFIER"]), ("||a.de^", "||a.de^", "address=/a.de/", '  - "+.a.de"', "address /a.de/#", "0.0.0.0\ta.de")),
    (("BASIC", "DENY", "a.de", None, "DNSMASQ", []), ("a.de", "a.de", "address=/a.de/", '  - "a.de"', "address /*.a.de/#", "0.0.0.0\ta.de")),
    (("BASIC", "ALLOW", "a.de", None, "EASYLIST", ["IMPORTANT", "ALL"]), ("@@a.de$important,all", "@@a.de$important", None, None, "address /*.a.de/-", None)),
    (("BASIC", "REWRITE", "a.de", "1.2.3.4", "HOSTS", []), (None, "1.2.3.4\ta.de", "address=/a.de/1.2.3.4/", None, None, "1.2.3.4\ta.de")),
    (("WILDCARD", "DENY", "*.a.de", "0.0.0.0", "EASYLIST", ["ALL"]), ("/*.a.de/$all", "/*.a.de/", None, '  - "*.a.de"', "address /*.a.de/-", None)),
    (("WILDCARD", "DENY", "*.*.de", "0.0.0.0", "EASYLIST", []), ("/*.*.de/", "/*.*.de/", None, '  - "*.*.de"', None, None)),
    (("WILDCARD", "ALLOW", "x*", None, "EASYLIST", []), ("@@/x*/", "@@/x*/", None, None, None, None)),
    (("WILDCARD", "DENY", "", "0.0.0.0", "EASYLIST", ["OVERLAY", "QUALIFIER"]), ("||//^", "||//^", None, '  - "+."', None, None)),
    (("REGEX", "DENY", "a+", None, "EASYLIST", []), ("/a+/", None, None, None, None, None)),
    (("UNKNOWN", None, None, None, "EASYLIST", []), ("line", None, None, None, None, None)),
    (("UNKNOWN", "DENY", None, None, "DNS", []), (None, "line", None, None, None, None)),
]


def test_render(spark):
    rows = [(i, "line", *rule, None if rule[0] == "UNKNOWN" else "DOMAIN") for i, (rule, _) in enumerate(RULES)]
    df = spark.createDataFrame(rows, "i int, origin string, type string, mode string, target string, dest string, source_type string, controls array<string>, scope string")
    got = df.select("i", *[r.alias(d) for d, r in renderings().items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [texts for _, texts in RULES]


def test_rendered_basic_rules_keep_their_key(spark):
    lines = [("EASYLIST", "||a.example^"), ("EASYLIST", "@@b.example"), ("HOSTS", "0.0.0.0 c.example"), ("SMARTDNS", "address /d.example/#")]
    df = spark.createDataFrame([(i, d, x) for i, (d, x) in enumerate(lines)], "line_no int, source_type string, line string")
    rules = parse_lines(df)
    again = parse_lines(rules.select("line_no", F.lit("EASYLIST").alias("source_type"), renderings()["EASYLIST"].alias("line")))
    keys = lambda r: {tuple(x) for x in r.select("line_no", *flow.rule_key()).collect()}
    assert keys(rules) == keys(again)


@pytest.mark.parametrize(("dialect", "line", "is_it"), [
    ("EASYLIST", "##.ad", True), ("EASYLIST", "! x", True), ("EASYLIST", "[Adblock]", True), ("EASYLIST", " ! x", False),
    ("DNS", "# x", True), ("HOSTS", "! x", False), ("CLASH", "# x", True), ("DNSMASQ", "[x]", False)])
def test_comments(spark, dialect, line, is_it):
    df = spark.createDataFrame([(dialect, line)], "source_type string, line string")
    assert (df.select(flow.gate_reason(F.col("line"), F.col("source_type"))).first()[0] == "comment") == is_it


def test_commented():
    assert commented("a\n\n  b \r\n\u3000\n", "EASYLIST") == "! a\r\n! b"
    assert commented("a\nb", "CLASH") == "#a\r\n#b"
    assert commented("\u00a0", "HOSTS") == "# \u00a0"
    assert dialect_of("dnsMasq") == "DNSMASQ"
    with pytest.raises(ValueError, match="unknown dialect"):
        dialect_of("bind")
