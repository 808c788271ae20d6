"""The six list dialects as column expressions.

Parsing adds staged columns to a DataFrame, so every step is computed once
per line and the whole parse is one code-generated projection over the scan,
without a union of per-dialect scans: each dialect's chain starts from the
line where the source has that dialect and from null elsewhere, and nulls
pass through its functions unevaluated.

Rendering is one expression per dialect that gives the text of a rule, or
null where the dialect cannot express it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.functions.text import LOCAL_DOMAINS, LOCAL_IPS, UNKNOWN_IP, base_rule, between, is_domain, is_ipv4, java_trim, split_ignore_blank, starts_with_any, sub_after, sub_between, undotted

DIALECTS = ("EASYLIST", "DNS", "DNSMASQ", "CLASH", "SMARTDNS", "HOSTS")
CONTROLS = ("IMPORTANT", "OVERLAY", "QUALIFIER", "ALL")
FIELDS = ("source_type", "target", "dest", "mode", "scope", "type", "controls")
# Marks of the formats
DNSMASQ_MARK, SMARTDNS_MARK, CLASH_HEAD = "address=/", "address /", "payload"
COMMENT_MARK = {"EASYLIST": "! ", "DNS": "! ", "DNSMASQ": "# ", "SMARTDNS": "# ", "HOSTS": "# ", "CLASH": "#"}
HEAD = {d: "payload:" if d == "CLASH" else "" for d in DIALECTS}
# No dialect closes its files with a line of its own.
TAIL = dict.fromkeys(DIALECTS, "")


def dialect_of(name: str) -> str:
    """The dialect of that name in any letter case."""
    if name.upper() not in DIALECTS:
        raise ValueError(f"unknown dialect {name!r}")
    return name.upper()


def is_comment(line: Column, source_type: Column) -> Column:
    adblock = starts_with_any(line, "#", "!") | between(line, "[", "]")
    return F.when(source_type.isin("EASYLIST", "DNS"), adblock).when(source_type.isin(*DIALECTS), line.startswith("#")).otherwise(False)


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _controls(**on: Column) -> Column:
    """The set controls in their fixed order."""
    marks = [F.when(on[name.lower()], F.lit(name)) for name in CONTROLS if name.lower() in on]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def _rule(ok: Column, source_type: Column | str, target: Column, dest: Column, mode: Column, scope: Column, type: Column, controls: Column) -> Column:
    """Null where the line is no rule."""
    source_type = F.lit(source_type) if isinstance(source_type, str) else source_type
    values = zip(FIELDS, (source_type, target, dest, mode, scope, type, controls))
    return F.when(ok, F.struct(*[v.alias(n) for n, v in values]))


class _Chain:
    """Columns that build on one another, in order. They become one select in
    which later columns name earlier ones, so that the plan is analysed once
    and not once per step."""

    def __init__(self) -> None:
        self.made: dict[str, Column] = {}

    def withColumns(self, made: dict[str, Column]) -> _Chain:  # noqa: N802 - as on a DataFrame
        self.made.update(made)
        return self

    def of(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[c.alias(name) for name, c in self.made.items()])


def _adblock(df: _Chain) -> tuple[_Chain, Column]:
    """Exceptions @@, anchors ||, modifiers after $, separators ^, /patterns/."""
    c = F.col
    df = df.withColumns({"_e0": F.when(c("source_type").isin("EASYLIST", "DNS"), c("line"))})
    df = df.withColumns({"_allow": c("_e0").startswith("@@"), "_e1": F.when(c("_e0").startswith("@@"), F.substr(c("_e0"), F.lit(3))).otherwise(c("_e0"))})
    df = df.withColumns({"_over": c("_e1").startswith("||"), "_e2": F.when(c("_e1").startswith("||"), F.substr(c("_e1"), F.lit(3))).otherwise(c("_e1"))})
    df = df.withColumns({"_at": F.instr("_e2", "$")})
    df = df.withColumns({"_mod": F.when(c("_at") > 0, java_trim(F.substr(c("_e2"), c("_at") + 1))), "_e3": F.when(c("_at") > 0, F.left(c("_e2"), c("_at") - 1)).otherwise(c("_e2"))})
    df = df.withColumns({"_odd": c("_mod").isNotNull() & ~c("_mod").isin("important", "all"), "_qual": c("_e3").endswith("^")})
    df = df.withColumns({"_e4": F.when(c("_qual"), F.left(c("_e3"), F.length("_e3") - 1)).otherwise(c("_e3"))})
    df = df.withColumns({"_pat": between(c("_e4"), "/", "/") & (F.length("_e4") > 2)})
    df = df.withColumns({"_e5": F.when(c("_odd"), None).when(c("_pat"), F.substr(c("_e4"), F.lit(2), F.length("_e4") - 2)).otherwise(c("_e4"))})
    df = df.withColumns({"_bare": undotted(c("_e5"))})
    df = df.withColumns({"_base": base_rule(c("_e5"), c("_bare"))})
    based = c("_base").isNotNull()
    rule = _rule(
        c("_e0").isNotNull(), c("source_type"),
        F.when(based | c("_pat"), c("_e5")), F.when(based & ~c("_allow"), UNKNOWN_IP),
        F.when(c("_allow"), "ALLOW").otherwise("DENY"), F.when(~c("_odd"), "DOMAIN"),
        F.when(c("_odd"), "UNKNOWN").when(based, c("_base")).when(c("_pat"), "REGEX").otherwise("UNKNOWN"),
        _controls(important=c("_mod") == "important", overlay=c("_over"), qualifier=c("_qual") & ~c("_odd"), all=c("_mod") == "all"))
    return df, rule


def _address(df: _Chain) -> tuple[_Chain, Column]:
    """Address and name, as in a hosts file; for HOSTS and, first of all, DNS."""
    c = F.col
    df = df.withColumns({"_h": F.when(c("source_type").isin("HOSTS", "DNS"), split_ignore_blank(F.translate("line", "\t", " "), " "))})
    df = df.withColumns({"_ip": F.when(F.size("_h") == 2, java_trim(F.get("_h", F.lit(0)))), "_name": F.when(F.size("_h") == 2, java_trim(F.get("_h", F.lit(1))))})
    df = df.withColumns({"_named": F.coalesce(is_ipv4(c("_ip")) & is_domain(c("_name")), F.lit(False)) & ((c("source_type") == "DNS") | (c("_ip") != c("_name")))})
    deny = c("_ip").isin(*LOCAL_IPS) & ~c("_name").isin(*LOCAL_DOMAINS)
    return df, _rule(c("_named"), "HOSTS", c("_name"), F.when(deny, UNKNOWN_IP).otherwise(c("_ip")), F.when(deny, "DENY").otherwise("REWRITE"), F.lit("DOMAIN"), F.lit("BASIC"), _controls())


def _dnsmasq(df: _Chain) -> tuple[_Chain, Column]:
    c = F.col
    df = df.withColumns({"_q": F.when(c("source_type") == "DNSMASQ", split_ignore_blank(sub_after(c("line"), DNSMASQ_MARK, last=True), "/"))})
    ip = F.get("_q", F.lit(1))
    mode = F.when(ip.isNull() | ip.isin(*LOCAL_IPS), "DENY").otherwise("REWRITE")
    return df, _rule(F.size("_q").isin(1, 2), "DNSMASQ", F.get("_q", F.lit(0)), ip, mode, F.lit("DOMAIN"), F.lit("BASIC"), _controls())


def _clash(df: _Chain) -> tuple[_Chain, Column]:
    c = F.col
    df = df.withColumns({"_k0": F.when((c("source_type") == "CLASH") & ~c("line").startswith(CLASH_HEAD), c("line"))})
    df = df.withColumns({"_k1": java_trim(F.when(c("_k0").startswith("-"), F.substr(c("_k0"), F.lit(2))).otherwise(c("_k0")))})
    quoted = F.when(c("_k1").startswith("'"), java_trim(sub_between(c("_k0"), "'", "'"))).when(c("_k1").startswith('"'), java_trim(sub_between(c("_k0"), '"', '"')))
    df = df.withColumns({"_k2": quoted.otherwise(c("_k1"))})
    df = df.withColumns({"_star": c("_k2").startswith("*"), "_plus": c("_k2").startswith("+"), "_k3": F.regexp_replace("_k2", r"\A\+\.?", "")})
    wild = F.instr("_k3", "*") > 0
    kind = F.when(~c("_star") & is_domain(F.replace(c("_k3"), F.lit("*"), F.lit("a"))), F.when(wild, "WILDCARD").otherwise("BASIC")).otherwise("UNKNOWN")
    sure = ~c("_star")
    return df, _rule(c("_k0").isNotNull(), "EASYLIST", F.when(sure, c("_k3")), F.when(sure, UNKNOWN_IP), F.when(sure, "DENY"), F.when(sure, "DOMAIN"), kind, _controls(overlay=c("_plus")))


def _smartdns(df: _Chain) -> tuple[_Chain, Column]:
    c = F.col
    df = df.withColumns({"_s": F.when(c("source_type") == "SMARTDNS", split_ignore_blank(sub_after(c("line"), SMARTDNS_MARK, last=True), "/"))})
    df = df.withColumns({"_dom": F.get("_s", F.lit(0)), "_act": F.when(F.get("_s", F.lit(1)) == "#", "DENY").when(F.get("_s", F.lit(1)) == "-", "ALLOW")})
    done = c("_act").isNotNull()
    kind = F.when(~done, "UNKNOWN").when(c("_dom").startswith("*"), "WILDCARD").otherwise("BASIC")
    df = df.withColumns({"_fails": F.coalesce((F.size("_s") == 2) & done & (c("_dom").startswith("-") | c("_dom").startswith(".")), F.lit(False))})
    rule = _rule((F.size("_s") == 2) & ~c("_fails"), "EASYLIST", F.when(done, c("_dom")), F.when(done, UNKNOWN_IP), c("_act"), F.when(done, "DOMAIN"), kind, _controls(overlay=done))
    return df, rule


def parse_lines(df: DataFrame) -> DataFrame:
    """Adds origin and the rule's fields and status to rows with ``line`` and
    ``source_type``. status is OK, INVALID (no rule; its fields are null and
    controls empty) or ERROR (the line breaks the reading of its source). The
    column source_type becomes the type the parser tags, declared_type keeps
    the source's own. A null line or an unknown dialect is INVALID."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("line", "source_type")]
    parts, chain = [], _Chain()
    for stage in (_address, _adblock, _dnsmasq, _clash, _smartdns):
        chain, rule = stage(chain)
        parts.append(rule)
    df = chain.withColumns({"_rule": F.coalesce(*parts)}).of(df)
    status = F.when(F.col("_fails"), "ERROR").when(F.col("_rule").isNull(), "INVALID").otherwise("OK")
    fields = [F.col(f"_rule.{f}").alias(f) for f in FIELDS if f != "controls"]
    controls = F.coalesce(F.col("_rule.controls"), F.array().cast("array<string>")).alias("controls")
    # One-row generator: predicates on the parsed fields stay above it. Pushed
    # below, the optimizer would write the whole chain of stages out into them,
    # which takes minutes to plan and parses each line once more per use.
    once = F.inline(F.array(F.struct(*fields, controls, status.alias("status"))))
    return df.select(*kept, F.col("source_type").alias("declared_type"), F.col("line").alias("origin"), once)


def breaking(df: DataFrame) -> DataFrame:
    """The rows of ``df`` whose line would have the status ERROR. Only one
    dialect can break off, so its stage alone is run."""
    kept = df.columns
    return _smartdns(_Chain())[0].of(df).where("_fails").select(*[F.col(f"`{c}`") for c in kept])


# -- rendering ----------------------------------------------------------------

def _has(control: str) -> Column:
    return F.array_contains("controls", control)


def _opt(when: Column, text: str) -> Column:
    return F.when(when, text).otherwise("")


def _kept_as(tag: str) -> Column:
    """Unknown rules come out as they came in, for the dialect they came from."""
    return F.when(F.col("source_type") == tag, F.col("origin"))


def _pattern(bare: Column) -> Column:
    t = F.col("target")
    return F.when(bare, t).otherwise(F.concat(F.lit("/"), t, F.lit("/")))


def renderings() -> dict[str, Column]:
    """Per dialect the text of the rule in the current row, or null."""
    c = F.col
    unknown, basic, wild = c("type") == "UNKNOWN", c("type") == "BASIC", c("type") == "WILDCARD"
    domain, deny, allow, rewrite = c("scope") == "DOMAIN", c("mode") == "DENY", c("mode") == "ALLOW", c("mode") == "REWRITE"
    # conditions on null fields count as not met
    yes = lambda x: F.coalesce(x, F.lit(False))
    front = [_opt(yes(allow), "@@"), _opt(_has("OVERLAY"), "||")]
    back = [_opt(_has("QUALIFIER"), "^"), _opt(_has("IMPORTANT"), "$important")]
    everything = F.when(~_has("ALL"), "").when(_has("IMPORTANT") | F.contains(c("target"), F.lit("$")), ",all").otherwise("$all")
    address = F.concat(F.coalesce(c("dest"), F.lit(UNKNOWN_IP)), F.lit("\t"), c("target"))
    easylist = F.when(unknown, _kept_as("EASYLIST")).when(~yes(rewrite), F.concat(*front, _pattern(basic), *back, everything))
    dns = F.when(unknown, _kept_as("DNS")).when(yes(rewrite), F.when(domain & basic, address)).when(basic | wild, F.concat(*front, _pattern(basic), *back))
    dnsmasq = F.when(domain & basic & ~yes(allow), F.concat(F.lit(DNSMASQ_MARK), c("target"), F.lit("/"), F.when(yes(rewrite), F.concat(c("dest"), F.lit("/"))).otherwise("")))
    clash = F.when(unknown, _kept_as("CLASH")).when((basic | wild) & deny & domain, F.concat(F.lit('  - "'), _opt(_has("OVERLAY"), "+."), c("target"), F.lit('"')))
    smart_basic = F.concat(F.lit(SMARTDNS_MARK), _opt(~_has("OVERLAY"), "*."), c("target"), F.lit("/"), F.when(yes(deny), "#").otherwise("-"))
    one_star = c("target").startswith("*") & (F.instr(F.substr(c("target"), F.lit(2)), "*") == 0)
    smartdns = F.when(unknown, _kept_as("SMARTDNS")).when(~yes(rewrite) & domain, F.when(basic, smart_basic).when(wild & one_star, F.concat(F.lit(SMARTDNS_MARK), c("target"), F.lit("/-"))))
    hosts = F.when(domain & basic & ~yes(allow), address)
    return {"EASYLIST": easylist, "DNS": dns, "DNSMASQ": dnsmasq, "CLASH": clash, "SMARTDNS": smartdns, "HOSTS": hosts}


def commented(text: str, dialect: str) -> str:
    """The lines of a text that are not blank, as comments joined by CRLF."""
    lines = [x for x in text.split("\n") if any(not _java_space(ch) for ch in x)]
    return "\r\n".join(COMMENT_MARK[dialect] + x.strip("".join(map(chr, range(33)))) for x in lines)


def _java_space(ch: str) -> bool:
    return (ch.isspace() and ch not in "\u00a0\u2007\u202f\x85") or ch in "\x1c\x1d\x1e\x1f"
