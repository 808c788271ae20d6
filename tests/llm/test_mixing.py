import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import DATA
from pyspark.sql import functions as F

from listweave.llm import mixing

SIZED, TARGETS = "doc_id bigint, source string, n_tokens bigint", "source string, weight double, max_repeats int"


def mix(spark, docs, targets, rows=20_000, monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    sized, wanted = spark.createDataFrame(docs, SIZED), spark.createDataFrame(targets, TARGETS)
    queue = mixing.plan(sized, wanted)
    out = mixing.mixture(sized, queue)
    return out.collect(), {r["source"]: r for r in mixing.shares(out, sized, wanted, queue.budget).collect()}, queue


def check(got, docs, targets, budget):
    """Against the definition: one queue, served by finish time."""
    taken = Counter(r["doc_id"] for r in got)
    source, size = {d: s for d, s, _ in docs}, {d: n for d, _, n in docs}
    caps = {s: c for s, _, c in targets}
    assert all(n <= caps[source[d]] for d, n in taken.items())
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    for s, w, cap in targets:
        rows = [r for r in got if r["source"] == s]
        total, run = sum(n for d, x, n in docs if x == s), 0
        for r in rows:  # the running tokens of a source over its weight are the finish times
            run += r["n_tokens"]
            assert r["finish"] == pytest.approx(run / w)
            assert r["n_tokens"] == size[r["doc_id"]]
        assert run <= cap * total
    assert sum(r["n_tokens"] for r in got) <= budget
    return taken


def test_weights_are_met(spark, monkeypatch):
    rnd = random.Random(2)
    docs = [(i, rnd.choice("aaaab"), rnd.randrange(1, 60)) for i in range(3000)] + [(5000 + i, "c", rnd.randrange(1, 60)) for i in range(20)] + [(9000, None, 500), (9001, "other", 700), (9002, "a", 0)]
    targets = [("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.3, 4), ("nobody", 0.1, 2)]
    budget = sum(n for *_, n in docs)
    got, shares, queue = mix(spark, docs, targets, 100, monkeypatch)
    assert queue.budget == budget
    check(got, docs, targets, budget)
    total = sum(r["n_tokens"] for r in got)
    assert budget - total < 60
    assert shares["c"]["exhausted"] and shares["c"]["most_copies"] == 4 and shares["nobody"]["tokens"] == 0
    assert shares["a"]["tokens"] / shares["b"]["tokens"] == pytest.approx(1, abs=0.01)
    assert sum(r["share"] for r in shares.values()) == pytest.approx(1)
    again, *_ = mix(spark, docs, targets, 100, monkeypatch)
    assert again == got


def test_everything_is_taken_where_the_budget_is_out_of_reach(spark):
    docs = [(1, "a", 10), (2, "b", 5), (3, None, 100)]
    got, shares, _ = mix(spark, docs, [("a", 0.5, 2), ("b", 0.5, 1)])
    assert sorted((r["doc_id"], r["copy_no"]) for r in got) == [(1, 1), (1, 2), (2, 1)]
    assert shares["a"]["exhausted"] and shares["b"]["exhausted"]


def brute(order, docs, targets, budget):
    """The queue served one copy after the other. ``order`` gives each document's place in the shuffle."""
    copies = []
    for s, w, cap in targets:
        own, run = sorted((order[d], d, n) for d, x, n in docs if x == s), 0
        for copy in range(1, cap + 1):
            for _, d, n in own:
                run += n
                copies.append((run / w, s, d, copy, n))
    out, spent = [], 0
    for finish, s, d, copy, n in sorted(copies):
        spent += n
        if spent > budget:
            break
        out.append((s, d, copy, n))
    return out


def shuffled(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(42), "doc_id"), 1).alias("r"))
    return {r["doc_id"]: r["r"] for r in df.collect()}


@pytest.mark.parametrize("broadcast", [0, mixing.BROADCAST_SOURCES])
def test_against_a_queue_served_copy_by_copy(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rnd = random.Random(4)
    docs = [(i, rnd.choice("aaaaab"), rnd.randrange(0, 60)) for i in range(900)] + [(2000 + i, f"s{i % 30}", rnd.randrange(1, 60)) for i in range(90)]
    targets = [("a", 0.4, 1), ("b", 0.3, 3)] + [(f"s{i}", 0.01, 2) for i in range(29)]
    sized, wanted = spark.createDataFrame(docs, SIZED), spark.createDataFrame([*targets, ("a", 0.1, 9)], TARGETS)
    queue = mixing.plan(sized, wanted)
    got = [(r["source"], r["doc_id"], r["copy_no"], r["n_tokens"]) for r in mixing.mixture(sized, queue, broadcast_sources=broadcast).collect()]
    assert got == brute(shuffled(spark, [d for d, *_ in docs]), docs, targets, sum(n for *_, n in docs))


def test_the_queries_against_a_queue_served_copy_by_copy(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    from listweave.llm import bpe, queries

    enc = bpe.Encoder()
    docs = [(r["doc_id"], r["source"], len(enc.whole(r["text"])) if r["text"] else 0) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()]
    targets = [tuple(r) for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").select("source", "weight", "max_repeats").collect()]
    budget, total = sum(n for *_, n in docs), Counter()
    expected = brute(shuffled(spark, [d for d, *_ in docs]), docs, targets, budget)
    got = queries.p7_mixture(spark, str(DATA)).collect()
    assert [(r["source"], r["doc_id"], r["copy_no"], r["n_tokens"]) for r in got] == expected
    for s, _, _, n in expected:
        total[s] += n
    shares = {r["source"]: r for r in queries.p7_shares(spark, str(DATA)).collect()}
    assert set(shares) == {s for s, *_ in targets}
    for s, w, cap in targets:
        r, has = shares[s], [n for _, x, n in docs if x == s]
        assert (r["weight"], r["max_repeats"], r["documents"], r["available_tokens"], r["tokens"]) == (w, cap, len(has), sum(has), total[s])
        assert r["copies"] == sum(x == s for x, *_ in expected) and r["most_copies"] == max([c for x, _, c, _ in expected if x == s], default=0)
        assert r["share"] == pytest.approx(total[s] / sum(total.values())) and r["budget_share"] == pytest.approx(total[s] / budget)
        assert r["exhausted"] == (total[s] >= cap * sum(has))


def test_edges(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0] == []
    assert mix(spark, [(1, "a", 5)], [])[0] == []
    assert mix(spark, [(1, "a", 5)], [("a", None, 1), ("a", 0.0, 1), (None, 1.0, 1)])[0] == []
    got, *_ = mix(spark, [(1, "a", 5), (1, "a", 5), (2, "a", 5)], [("a", 1.0, 1)])
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2]
