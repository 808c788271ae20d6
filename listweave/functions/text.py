"""String helpers as Column expressions, with the JVM's notions of blank, trim and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
LOCAL_IPS = ("0.0.0.0", "127.0.0.1", "::1")
LOCAL_DOMAINS = ("localhost", "localhost.localdomain", "local", "ip6-localhost", "ip6-loopback")
UNKNOWN_IP = "0.0.0.0"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
IPV4 = rf"\A(?:{_OCTET}\.){{3}}{_OCTET}\z"
_LABEL = "[a-zA-Z0-9][-a-zA-Z0-9]{0,62}"
DOMAIN = rf"\A{_LABEL}(?:\.{_LABEL})+\z"
DOMAIN_PART = r"\A[-a-zA-Z0-9]*\z"


def has_text(c: Column) -> Column:
    """At least one character that is no white space (a no-break space is text)."""
    return c.rlike(r"[^\p{javaWhitespace}]")


def java_trim(c: Column) -> Column:
    """Without characters up to U+0020 at the ends."""
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice. Lines
    whose bytes equal their characters take the cheap way."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def starts_with_any(c: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return has_text(c) & out


def between(c: Column, start: str, end: str) -> Column:
    """Starts with one and ends with the other; false if any of them is empty."""
    if not start or not end:
        return F.lit(False)
    return c.startswith(start) & c.endswith(end)


def sub_before(c: Column, flag: str, last: bool = False) -> Column:
    """Text before the first or last flag, empty if there is none."""
    return F.when(F.instr(c, flag) > 0, F.substring_index(c, flag, 1) if not last else F.left(c, F.length(c) - F.length(F.substring_index(c, flag, -1)) - len(flag))).when(c.isNotNull(), "")


def sub_after(c: Column, flag: str, last: bool = False) -> Column:
    """Text after the first or last flag, empty if there is none."""
    return F.when(F.instr(c, flag) > 0, F.substring_index(c, flag, -1) if last else F.substr(c, F.instr(c, flag) + len(flag))).when(c.isNotNull(), "")


def sub_between(c: Column, start: str, end: str) -> Column:
    """Text from the first start to the last end, empty if the end is not behind the start."""
    cut = F.regexp_extract(c, rf"(?s)\A.*?\Q{start}\E(.*)\Q{end}\E", 1)
    return F.when(c.isNotNull(), cut)


def split_ignore_blank(c: Column, flag: str) -> Column:
    """Parts between the flags that are not blank; parts are not trimmed."""
    return F.filter(F.split(c, rf"\Q{flag}\E"), has_text)


def equals_any(c: Column, *values: str) -> Column:
    return (c != "") & c.isin(*values)


def is_ipv4(c: Column) -> Column:
    return c.rlike(IPV4)


def is_domain(c: Column) -> Column:
    return F.length(c).between(3, 255) & c.rlike(DOMAIN)


def undotted(c: Column) -> Column:
    """With * read as a letter and without dots at the ends."""
    return F.regexp_replace(F.replace(c, F.lit("*"), F.lit("a")), r"\A\.+|\.+\z", "")


def base_rule(c: Column, bare: Column | None = None) -> Column:
    """BASIC for a plain domain, WILDCARD for one with * or outer dots or a
    piece of one (the empty text too), else null. ``bare`` is undotted(c) where
    it has been computed before."""
    bare = undotted(c) if bare is None else bare
    return F.when(is_domain(bare), F.when(c == bare, "BASIC").otherwise("WILDCARD")).when(bare.rlike(DOMAIN_PART), "WILDCARD")
