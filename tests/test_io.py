"""Sources, configuration, sinks, probe, streaming and the whole job."""

import socket
import threading
import time
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from listweave.operators import probe
from listweave.plans import pipeline
from listweave.sinks import header, write_outputs
from listweave.sources import lists
from listweave.sources.config import Http, parse_config, seconds, size_bytes
from listweave.streaming.incremental import keep_batch, replay

TREE = {
    "application": {
        "input": [{"name": "A", "path": "a.txt"}, {"path": "b.txt", "type": "hosts"}, {"name": "twice", "path": "a.txt"}],
        "rule": {"old": [{"name": "C", "path": "./c.txt", "type": "smartdns"}]},
        "output": {
            "file_header": "${name} ${type} ${desc}\n\n ${total} of ${date}", "path": "out",
            "files": [
                {"name": "easy.txt", "type": "easylist", "desc": "D", "rule": ["A", "b.txt"]},
                {"name": "hosts", "type": "hosts", "file-header": "own ${total}", "filter": ["basic"]},
                {"name": "none.yaml", "type": "clash", "filter": ["regex"]},
            ],
        },
        "config": {
            "fetcher": {"http": {"charset": "latin-1", "connect-timeout": "500ms"}, "local": {"buffer-size": "8KB"}},
            "parser": {"excludes": ["ex.de"], "max-length": 40, "dns-probe": {"enable": False, "timeout": 1500, "provider": [{"host": "9.9.9.9"}]}},
        },
    }
}
FILES = {"a.txt": "||a.de^\r\n! c\n||ex.de^\n@@||b.de^\nx\rx$y", "b.txt": "0.0.0.0 a.de\n1.2.3.4 d.de\n\n", "c.txt": "address /e.de/#\naddress /-f.de/#\naddress /g.de/#\n"}


def test_config():
    c = parse_config(TREE)
    assert [(i.name, i.path, i.type) for i in c.input] == [("A", "a.txt", "EASYLIST"), ("b.txt", "b.txt", "HOSTS"), ("C", "./c.txt", "SMARTDNS")]
    assert c.http == Http("latin-1", 0.5) and c.local.buffer_size == 8192
    assert c.parser.dns_probe.timeout == 1.5 and c.parser.dns_probe.provider == (("9.9.9.9", 53),) and c.parser.max_length == 40 and c.parser.alert_length == 6
    assert c.output[1].file_header == "own ${total}" and c.output[1].filter == ("BASIC",)
    assert (seconds("2s"), seconds("1000ms"), size_bytes("4KB")) == (2, 1, 4096)


@pytest.mark.parametrize(("change", "message"), [
    ({"input": []}, "both needed"), ({"input": [{"name": "x"}]}, "path"), ({"output": {"files": [{"name": "x", "type": "bind"}]}}, "dialect"),
    ({"output": {"files": [{"name": "x", "type": "dns"}, {"name": "x", "type": "dns"}]}}, "same name"), ({"output": {"files": [{"name": "x", "type": "dns", "filter": ["odd"]}]}}, "rule type")])
def test_bad_config(change, message):
    with pytest.raises(ValueError, match=message):
        parse_config({**TREE["application"], "rule": None, **change})


def test_paths():
    assert lists.normalize_path("/x") == "/x" and lists.normalize_path("C:/x") == "C:/x"
    assert lists.normalize_path("./x", "/r") == "/r/x" and lists.normalize_path("x", "/r") == "/r/x" and lists.normalize_path("../x", "/r") == "/r/./x"
    assert lists.transport_of("http-list.txt") == "REMOTE" and lists.transport_of("rule/x") == "LOCAL"


def test_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("a\r\nb\rc\n\n\u00e9".encode("latin-1"))
    got = lists.read_local(spark, "l.txt", "ISO-8859-1", str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, "b\rc"), (3, ""), (4, "\u00e9")]
    (tmp_path / "e.txt").write_bytes(b"")
    assert lists.read_local(spark, "e.txt", root=str(tmp_path)).count() == 0
    assert lists.read_local(spark, "missing.txt", root=str(tmp_path)).count() == 0


def test_whole_job(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_text(content, newline="")
    config = parse_config(TREE)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "hosts").write_text("stale")
    report = pipeline.run(spark, config, now="2025-01-01 00:00:00", root=str(tmp_path), audit_path=f"file://{tmp_path}/audit")
    assert report.totals == {"easy.txt": 3, "hosts": 3, "none.yaml": 0}
    assert report.sources == {"A": {"total": 4, "effective": 3, "repeat": 0, "invalid": 0}, "b.txt": {"total": 2, "effective": 1, "repeat": 1, "invalid": 0}, "C": {"total": 1, "effective": 1, "repeat": 0, "invalid": 0}}
    assert report.events == {"comment": 1, "excluded": 1, "effective": 5, "repeat": 1, "blank": 1, "error": 1, "lost": 1, "suspicious": 1}
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 11 and report.seconds > 0
    out = {p.name: p.read_bytes().decode() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert out["easy.txt"] == "! easy.txt easylist D\r\n! 3 of 2025-01-01 00:00:00\n||a.de^\n@@||b.de^\nx\rx$y\n"
    assert out["hosts"] == "# own 3\n0.0.0.0\ta.de\n1.2.3.4\td.de\n0.0.0.0\te.de\n"
    assert out["none.yaml"] == "#none.yaml clash\r\n#0 of 2025-01-01 00:00:00\npayload:\n"
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")]
    lines = lists.raw_lines(spark, config.input, root=str(tmp_path))
    stats = {r["source_name"]: tuple(r)[1:] for r in pipeline.plan(lines, config).stats.collect()}
    assert stats == {"A": (4, 3, 0, 0), "b.txt": (2, 1, 1, 0), "C": (1, 1, 0, 0)}


def test_local_files_are_read_in_splits(spark, tmp_path):
    content = "\ufeffx\r\n" + "".join(f"line {i}\n" if i % 3 else f"l\u00e9{i}\r\n" for i in range(4000)) + "\xffrest".encode("latin-1").decode("utf-8", "surrogateescape")
    (tmp_path / "big.txt").write_bytes(content.encode("utf-8", "surrogateescape"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = lists.read_local(spark, "big.txt", root=str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        got = [tuple(r) for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = ["\ufeffx", *[f"line {i}" if i % 3 else f"l\u00e9{i}" for i in range(4000)], "\ufffdrest"]
    assert got == list(enumerate(expected, 1))


def test_a_failing_move_keeps_the_old_file(spark, tmp_path):
    (tmp_path / "o" / "hosts").mkdir(parents=True)
    (tmp_path / "o" / "hosts" / "old").write_text("kept")
    rendered = spark.createDataFrame([("hosts", 0, 1, "x")], "file string, source_idx int, line_no bigint, line string")
    with pytest.raises(OSError):
        write_outputs(spark, rendered, [{"name": "hosts", "type": "HOSTS"}], str(tmp_path / "o"))
    assert (tmp_path / "o" / "hosts" / "old").read_text() == "kept" and len(list((tmp_path / "o").iterdir())) == 1


def test_a_url_is_fetched_once_and_nothing_is_left(spark, server):
    from listweave.storage import own_folder, shared_dir

    url, hits = server
    tree = {"input": [{"name": "r", "path": f"{url}/list", "type": "smartdns"}, {"name": "h", "path": f"{url}/hosts", "type": "hosts"}], "output": {"files": [{"name": "f", "type": "hosts"}]}}
    before = list(Path(own_folder(spark).removeprefix("file://")).glob("run-*"))
    report = pipeline.run(spark, parse_config(tree), root=shared_dir(spark).removeprefix("file://"))
    assert sorted(hits) == ["/hosts", "/list"] and report.sources["h"]["effective"] == 1
    assert list(Path(own_folder(spark).removeprefix("file://")).glob("run-*")) == before


@pytest.fixture
def resolver():
    """A UDP server: NXDOMAIN for no.*, no records for empty.*, refusal for
    refuse.*, silence for silent.*, an IPv6 address alone for six.*, else an IPv4 one."""
    asked = []
    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sock.bind(("127.0.0.1", 0))

    def serve():
        while True:
            try:
                data, peer = sock.recvfrom(512)
            except OSError:
                return
            if not data:
                return
            first, kind = data[13 : 13 + data[12]].decode(), data[-3]
            asked.append((first, kind))
            code = {"no": 3, "refuse": 5}.get(first, 0)
            records = 0 if code or first == "empty" or (first == "six" and kind == 1) else 1
            if first == "forged":
                sock.sendto(data[:2] + b"\x81\x83" + data[4:12] + b"\x01x" + data[14:], peer)
            if first != "silent":
                sock.sendto(data[:2] + bytes([0x81, 0x80 | code]) + data[4:6] + bytes([0, records]) + data[8:], peer)

    threading.Thread(target=serve, daemon=True).start()
    yield sock.getsockname(), asked
    sock.close()


def test_resolver_answers(resolver):
    server, asked = resolver
    ask = probe.ServerLookup([server], timeout=0.2)
    names = ["a.de", "no.de", "empty.de", "six.de", "refuse.de", "silent.de", "forged.de", "." * 3, "x" * 70 + ".de"]
    assert [ask(n) for n in names] == [True, False, False, True, True, True, True, True, True]
    assert asked.count(("no", 1)) == 1 and asked.count(("empty", 1)) == asked.count(("empty", 28)) == 1 and asked.count(("silent", 1)) == 2


def test_resolvers_take_turns(resolver):
    server, asked = resolver
    dead = ("127.0.0.1", 1)
    ask = probe.ServerLookup([dead, server], timeout=0.2)
    assert not any(ask("no.de") for _ in range(4)) and asked.count(("no", 1)) == 4
    assert probe.ServerLookup([dead], timeout=0.05)("no.de")


def test_lookups_in_flight_are_bounded_for_the_job(spark, tmp_path):
    def lookup(name):
        began = time.time()
        time.sleep(0.01)
        (tmp_path / name).write_text(f"{began} {time.time()}")
        return True

    names = spark.createDataFrame([(f"n{i}",) for i in range(60)], "n string")
    for parallel in (2, 8):
        assert probe.resolvable(names, lookup, parallel).count() == 60
        spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
        assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= parallel


def test_lookups_of_the_job_are_counted(spark, tmp_path):
    (tmp_path / "h.txt").write_text("0.0.0.0 a.de\n0.0.0.0 b.de\n0.0.0.0 a.de\njunk\n")
    tree = {"input": [{"name": "h", "path": "h.txt", "type": "hosts"}], "output": {"files": [{"name": "f", "type": "hosts"}]}, "config": {"parser": {"dns-probe": {"enable": True}}}}
    report = pipeline.run(spark, parse_config(tree), lookup=lambda name: name != "b.de", root=str(tmp_path))
    assert report.lookups == {"wanted": 3, "queries": 2, "cache_hits": 1}
    assert report.events == {"effective": 1, "repeat": 1, "unresolved": 1, "invalid": 1, "suspicious": 0}
    assert report.sources["h"] == {"total": 4, "effective": 1, "repeat": 1, "invalid": 2}


def test_probe_in_the_job(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_text(content, newline="")
    tree = {**TREE["application"], "config": {"parser": {"dns-probe": {"enable": True, "parallel": 4}}}}
    config = parse_config(tree)
    made = pipeline.plan(lists.raw_lines(spark, config.input, root=str(tmp_path)), config, lookup=lambda name: name != "a.de")
    stats = {r["source_name"]: tuple(r)[1:] for r in made.stats.collect()}
    assert stats == {"A": (4, 3, 0, 1), "b.txt": (2, 1, 0, 1), "C": (1, 1, 0, 0)}


def test_probe(spark):
    rows = [("a.de", "BASIC", "DOMAIN"), ("A.de ", "BASIC", "DOMAIN"), ("bad.de", "BASIC", "DOMAIN"), ("bad.de", "WILDCARD", "DOMAIN"), ("boom.de", "BASIC", "DOMAIN"), (None, "UNKNOWN", None)]

    def lookup(name):
        if name == "boom.de":
            raise TimeoutError
        return name == "a.de"

    kept = probe.drop_unresolved(spark.createDataFrame(rows, "target string, type string, scope string"), lookup, 2)
    assert sorted(map(str, (r["target"] for r in kept.collect()))) == ["A.de ", "None", "a.de", "bad.de", "boom.de"]
    assert probe.ServerLookup([("127.0.0.1", 1)], timeout=0.05)("a.de")


@pytest.fixture
def server():
    hits = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            hits.append(self.path)
            code = {"/gone": 404, "/down": 503}.get(self.path, 503 if self.path == "/flaky" and hits.count("/flaky") < 3 else 200)
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b"0.0.0.0 a.de\r\n\xe9")

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", hits
    s.shutdown()


def test_http(spark, server):
    url, hits = server
    waits = []
    latin = Http("latin-1")
    assert lists.fetch_http(f"{url}/flaky", latin, sleep=waits.append) == "0.0.0.0 a.de\r\n\u00e9" and waits == [1, 2]
    assert lists.fetch_http(f"{url}/gone", latin, sleep=waits.append) is None and hits.count("/gone") == 1
    assert lists.fetch_http(f"{url}/down", latin, sleep=lambda _: None) is None and hits.count("/down") == 4
    assert [tuple(r) for r in lists.read_http(spark, f"{url}/x", latin).orderBy("line_no").collect()] == [(1, "0.0.0.0 a.de"), (2, "\u00e9")]
    assert lists.read_http(spark, f"{url}/gone", latin).count() == 0


def test_http_connection_failure():
    def refuse(*_, **__):
        raise urllib.error.URLError("refused")

    waits = []
    assert lists.fetch_http("http://x", Http(), open_url=refuse, sleep=waits.append) is None and waits == [1, 2, 4]


def test_header():
    out = {"name": "n", "type": "CLASH", "desc": None, "file_header": " "}
    assert header(out, "", 1, "now", "\n") == "payload:\n"
    assert header({**out, "type": "HOSTS"}, "${total}${date}", 7, "${total}", "\n") == "# 77\n"


def test_stream_keeps_first_and_survives_a_rerun(spark, tmp_path):
    rows = [(0, "a", "HOSTS", 1, "0.0.0.0 a.de"), (1, "b", "HOSTS", 1, "0.0.0.0 a.de"), (1, "b", "HOSTS", 2, "0.0.0.0 b.de")]
    df = spark.createDataFrame(rows, "source_idx int, source_name string, source_type string, line_no bigint, line string")
    assert sorted((r["source_idx"], r["line_no"]) for r in replay(df, f"file://{tmp_path}").collect()) == [(0, 1), (1, 2)]
    store = f"file://{tmp_path}/again"
    for number, batch in ((0, df.where("source_idx = 0")), (1, df.where("source_idx = 1")), (1, df.where("source_idx = 1"))):
        keep_batch(batch, number, store)
    assert spark.read.parquet(store).count() == 2
