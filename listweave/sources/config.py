"""Configuration: inputs, outputs, parser and fetcher settings, from YAML or tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from listweave.operators.dialects import dialect_of

RULE_TYPES = ("BASIC", "WILDCARD", "REGEX", "UNKNOWN")


@dataclass(frozen=True)
class Input:
    path: str
    name: str
    type: str = "EASYLIST"


@dataclass(frozen=True)
class Output:
    name: str
    type: str
    desc: str = ""
    file_header: str = ""
    filter: tuple[str, ...] = ()
    rule: tuple[str, ...] = ()

    def item(self) -> dict:
        return {"name": self.name, "type": self.type, "desc": self.desc, "file_header": self.file_header, "filter": list(self.filter), "rule": list(self.rule)}


@dataclass(frozen=True)
class DnsProbe:
    enable: bool = False
    timeout: float = 1.0
    cache_ttl_min: float = 600.0
    cache_ttl_max: float = 86400.0
    cache_negative_ttl: float = 300.0
    parallel: int = 128
    provider: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Parser:
    log_level: str = "trace"
    alert_length: int = 6
    expected: int = 1000
    excludes: tuple[str, ...] = ()
    min_length: int = 0
    max_length: int = 1024
    dns_probe: DnsProbe = DnsProbe()


@dataclass(frozen=True)
class Http:
    charset: str = "UTF-8"
    connect_timeout: float = 10.0
    read_timeout: float = 30.0
    write_timeout: float = 30.0
    response_timeout: float = 30.0
    buffer_size: int = 4096


@dataclass(frozen=True)
class Local:
    charset: str = "UTF-8"
    buffer_size: int = 4096


@dataclass(frozen=True)
class Config:
    input: tuple[Input, ...] = ()
    output: tuple[Output, ...] = ()
    file_header: str = ""
    path: str = "rule"
    parser: Parser = Parser()
    http: Http = Http()
    local: Local = Local()
    extra: dict = field(default_factory=dict)


def seconds(value: Any) -> float:
    """A duration: 500ms, 10s, 2m, 1h, 1d, PT10S or a number of seconds."""
    m = re.fullmatch(r"(?:PT)?(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|)", str(value).strip(), re.I)
    if not m:
        raise ValueError(f"no duration: {value!r}")
    return float(m[1]) * {"ms": 0.001, "": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2].lower()]


def size_bytes(value: Any) -> int:
    m = re.fullmatch(r"(\d+)\s*(B|KB|MB|GB|)", str(value).strip(), re.I)
    if not m:
        raise ValueError(f"no size: {value!r}")
    return int(m[1]) * {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}[m[2].upper()]


def _keys(d: Any) -> dict:
    """Keys in one spelling: file-header, file_header and fileHeader are the same."""
    return {re.sub(r"(?<=[a-z])([A-Z])", r"_\1", str(k)).replace("-", "_").lower(): v for k, v in (d or {}).items()}


def _pick(cls: type, d: dict, **read: Any) -> Any:
    return cls(**{k: read.get(k, lambda x: x)(v) for k, v in d.items() if k in cls.__dataclass_fields__ and v is not None})


def _input(d: dict) -> Input:
    d = _keys(d)
    if not str(d.get("path") or "").strip():
        raise ValueError("an input needs a path")
    return Input(str(d["path"]), str(d.get("name") or d["path"]), dialect_of(str(d.get("type") or "EASYLIST")))


def _rule_type(name: str) -> str:
    if str(name).upper() not in RULE_TYPES:
        raise ValueError(f"unknown rule type {name!r}")
    return str(name).upper()


def _output(d: dict) -> Output:
    d = _keys(d)
    if not str(d.get("name") or "").strip() or not d.get("type"):
        raise ValueError("an output needs a name and a type")
    unique = lambda xs: tuple(dict.fromkeys(xs))
    return Output(str(d["name"]), dialect_of(str(d["type"])), str(d.get("desc") or ""), str(d.get("file_header") or ""), unique(map(_rule_type, d.get("filter") or ())), unique(map(str, d.get("rule") or ())))


def parse_config(tree: dict) -> Config:
    """Reads the ``application`` tree. The older ``rule`` map adds its inputs
    to ``input``; of inputs with one path the first stays. Output names must
    differ. The fetcher may stand under config or beside it."""
    app = _keys(tree.get("application", tree))
    legacy = [x for xs in (app.get("rule") or {}).values() for x in xs or ()]
    by_path: dict[str, Input] = {}
    for item in map(_input, [*(app.get("input") or ()), *legacy]):
        by_path.setdefault(item.path, item)
    inputs = list(by_path.values())
    out = _keys(app.get("output"))
    outputs = [_output(x) for x in out.get("files") or ()]
    if len({o.name for o in outputs}) < len(outputs):
        raise ValueError("two outputs have the same name")
    if not inputs or not outputs:
        raise ValueError("inputs and outputs are both needed")
    conf = _keys(app.get("config"))
    fetcher = _keys(app.get("fetcher") or conf.get("fetcher"))
    p = _keys(conf.get("parser"))
    probe = _keys(p.pop("dns_probe", None))
    servers = tuple((str(_keys(x).get("host") or "1.1.1.1"), int(_keys(x).get("port") or 53)) for x in probe.pop("provider", None) or ())
    dns = _pick(DnsProbe, probe, timeout=lambda v: seconds(f"{v}ms" if str(v).isdigit() else v), cache_ttl_min=seconds, cache_ttl_max=seconds, cache_negative_ttl=seconds, parallel=int)
    dns = DnsProbe(**{**dns.__dict__, "provider": servers})
    parser = _pick(Parser, p, excludes=lambda xs: tuple(dict.fromkeys(map(str, xs))), min_length=int, max_length=int, alert_length=int, expected=int)
    times = dict.fromkeys(("connect_timeout", "read_timeout", "write_timeout", "response_timeout"), seconds)
    return Config(
        tuple(inputs), tuple(outputs), str(out.get("file_header") or ""), str(out.get("path") or "rule"), Parser(**{**parser.__dict__, "dns_probe": dns}),
        _pick(Http, _keys(fetcher.get("http")), buffer_size=size_bytes, **times), _pick(Local, _keys(fetcher.get("local")), buffer_size=size_bytes))


def load_config(path: str) -> Config:
    try:
        import yaml
    except ImportError:
        raise RuntimeError("reading YAML needs the yaml package; pass a dict to parse_config") from None
    with open(path, encoding="utf-8") as f:
        return parse_config(yaml.safe_load(f) or {})


def output_items(outputs: DataFrame) -> list[dict]:
    """The rows of an outputs table as configuration; nulls are empty."""
    return [_output(r.asDict()).item() for r in outputs.select("name", "type", "desc", "file_header", "filter", "rule").collect()]
