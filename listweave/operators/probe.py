"""Dropping rules whose domain does not resolve.

Each distinct name is looked up once, by a thread pool in each task; the
answer is joined back. A lookup says no for an unknown host and for a name
without an address; every other failure lets the rule pass.

``parallel`` bounds the lookups in flight of the whole job: it is divided over
the tasks that can run at once, and with fewer than one a task the names are
gathered in fewer tasks.
"""

from __future__ import annotations

import secrets
import socket
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lookup = Callable[[str], bool]
_A, _AAAA = 1, 28


def system_lookup(name: str) -> bool:
    """The platform's resolver; IPv4 addresses suffice."""
    try:
        socket.getaddrinfo(name, None, socket.AF_UNSPEC)
    except socket.gaierror as e:
        return e.errno not in (socket.EAI_NONAME, getattr(socket, "EAI_NODATA", socket.EAI_NONAME))
    except OSError:
        return True
    return True


def _question(name: str, number: int, kind: int) -> bytes:
    labels = b"".join(bytes([len(x)]) + x for x in name.encode("idna").split(b".") if x)
    return number.to_bytes(2, "big") + b"\x01\x00\x00\x01\x00\x00\x00\x00\x00\x00" + labels + b"\x00" + kind.to_bytes(2, "big") + b"\x00\x01"


class ServerLookup:
    """Asks the given (host, port) servers over UDP for IPv4 and then IPv6
    addresses. The first server asked moves on with every name; the next one
    is asked where a server is silent or refuses. No is said for NXDOMAIN and
    where neither kind of question has an answer record; silence, refusals and
    garbage are yes."""

    def __init__(self, servers: list[tuple[str, int]], timeout: float = 1.0, tries: int = 2):
        self.servers, self.timeout, self.tries = servers, timeout, max(tries, 1)
        self.turn = 0

    def __call__(self, name: str) -> bool:
        self.turn += 1
        for kind in (_A, _AAAA):
            try:
                found = self._ask(name, kind, self.turn)
            except UnicodeError:
                return True
            if found is None or found > 0:
                return True
            if found < 0:
                return False
        return False

    def _ask(self, name: str, kind: int, turn: int) -> int | None:
        """The number of answer records, -1 for NXDOMAIN, None for no answer of use."""
        number = secrets.randbelow(1 << 16)
        ask = _question(name, number, kind)
        for i in range(self.tries):
            server = self.servers[(turn + i) % len(self.servers)]
            try:
                with socket.socket(socket.AF_INET6 if ":" in server[0] else socket.AF_INET, socket.SOCK_DGRAM) as s:
                    s.connect(server)
                    s.send(ask)
                    until = time.monotonic() + self.timeout
                    while (left := until - time.monotonic()) > 0:
                        s.settimeout(left)
                        answer = s.recv(4096)
                        # number, the response bit and the question must be ours
                        if len(answer) >= len(ask) and answer[:2] == ask[:2] and answer[2] & 0x80 and answer[12 : len(ask)].lower() == ask[12:].lower():
                            code = answer[3] & 0x0F
                            if code == 3:
                                return -1
                            if code == 0:
                                return int.from_bytes(answer[6:8], "big")
                            break
            except OSError:
                continue
        return None


def resolvable(names: DataFrame, lookup: Lookup = system_lookup, parallel: int = 128) -> DataFrame:
    """(name, resolves) for each distinct non-null name, lower-cased and trimmed
    for the lookup. Empty names resolve."""
    slots = max(names.sparkSession.sparkContext.defaultParallelism, 1)
    each = max(parallel // slots, 1)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(name: str) -> bool:
            try:
                bare = name.lower().strip()
                return not bare or bool(lookup(bare))
            except Exception:  # noqa: BLE001 - a failing resolver must not drop rules
                return True

        with ThreadPoolExecutor(each) as pool:
            for batch in batches:
                yield pd.DataFrame({"name": batch["name"], "resolves": list(pool.map(one, batch["name"]))})

    distinct = names.select(F.col(names.columns[0]).alias("name")).where("name is not null").distinct()
    if parallel < slots:
        distinct = distinct.coalesce(max(parallel, 1))
    return distinct.mapInPandas(ask, "name string, resolves boolean")


def asked_for(rules: DataFrame, among: Column | None = None) -> DataFrame:
    """The rules whose name is looked up: BASIC ones of DOMAIN scope."""
    asks = (F.col("type") == "BASIC") & (F.col("scope") == "DOMAIN")
    return rules.where(asks if among is None else asks & among)


def probed(rules: DataFrame, lookup: Lookup = system_lookup, parallel: int = 128, among: Column | None = None) -> DataFrame:
    """``rules`` with ``resolves``; rules that are not asked for (see
    ``asked_for``) resolve."""
    names = resolvable(asked_for(rules, among).select("target"), lookup, parallel).where("not resolves")
    failing = names.select(F.col("name").alias("target"), F.lit("BASIC").alias("type"), F.lit("DOMAIN").alias("scope"), F.lit(True).alias("_fails"))
    resolves = ~F.coalesce("_fails", F.lit(False))
    resolves = resolves if among is None else resolves | ~among
    return rules.join(failing, ["target", "type", "scope"], "left").withColumn("resolves", resolves).drop("_fails")


def drop_unresolved(rules: DataFrame, lookup: Lookup = system_lookup, parallel: int = 128) -> DataFrame:
    return probed(rules, lookup, parallel).where("resolves").drop("resolves")
