import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listweave.llm import bpe

if not Path(bpe.TOKENIZERS, bpe.VOCABULARY).exists():
    pytest.skip("no public tokenizers here", allow_module_level=True)
ENC = bpe.Encoder()
PARTS = [" ", "  ", "\n", "\t", "a", "b", "'s", "'re", "'", "1", "22", "é", "日本", "語", "　", "\U0001f600", "x" * 50, "\x1c", "\x85", ".", "--", "’", " ", " \n ", "<|endoftext|>", "�", "é"]


def joined(text, size):
    return bpe.join_all(ENC, [ENC.piece(text[i : i + size]) for i in range(0, len(text), size)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=50).map("".join), st.sampled_from([1, 2, 3, 7, 16, 100]))
def test_joined_pieces_equal_the_whole(text, size):
    got = joined(text, size)
    assert got.ids.tolist() == ENC.whole(text) and got.starts.tolist() == ENC.starts(text).tolist()


def climbed(text, size, fan, edge):
    """The tree with edges: all tokens in order, and the largest node that went on to a next level."""
    nodes, done, at, most = [], [], 0, 0
    for i in range(0, len(text), size):
        node, made = bpe.compact(ENC, bpe.Node(at, ENC.piece(text[i : i + size])), edge)
        at += len(text[i : i + size].encode())
        nodes.append(node)
        done += made
    while len(nodes) > 1:
        most = max(most, *[len(n.left.data) + (len(n.right.data) if n.right else 0) for n in nodes])
        groups = [bpe.join_level(ENC, nodes[i : i + fan], edge) for i in range(0, len(nodes), fan)]
        nodes, done = [n for n, _ in groups], done + [x for _, made in groups for x in made]
    last = nodes[0]
    done.append((last.at, last.left.ids))
    if last.right:
        done.append((last.right_at, last.right.ids))
    return [int(x) for _, ids in sorted(done, key=lambda d: d[0]) for x in ids], most


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=200).map("".join), st.sampled_from([1, 5, 17, 100]), st.sampled_from([2, 3, 16]), st.sampled_from([1, 4, 40]))
def test_edges_suffice(text, size, fan, edge):
    assert climbed(text, size, fan, edge)[0] == ENC.whole(text)


def test_edges_stay_small():
    rnd = random.Random(8)
    text = "".join(rnd.choice(["word", " the ", "日本語", "。", "1234", ", ", "\n", "e's "]) for _ in range(60_000))
    ids, most = climbed(text, 4096, 16, bpe.EDGE)
    assert ids == ENC.whole(text) and most < 4 * bpe.EDGE


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz", "日本語学", "=-", "0123456789", " ", "aé"])
def test_runs_without_any_border(alphabet):
    rnd = random.Random(alphabet)
    for n, size in ((9000, 1024), (5000, 2048), (3000, 333)):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        assert joined(text, size).ids.tolist() == ENC.whole(text)


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ["", "Hello  world\n", *PARTS, "".join(PARTS), "can't we'll THEY'RE"]:
        assert ENC.whole(text) == other.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    texts = {1: "a b", 2: "", 3: None, 4: "word " * 900 + "z" * 5000, 5: "<|endoftext|>", 6: "日本" * 700, 7: " " * 3000}
    rows = [(i, t, "s") for i, t in texts.items()] + [(4, texts[4], "s"), (4, texts[4][:-1], "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h string").withColumn("ids", F.lit("clash")).withColumn("no", F.lit(1)).withColumn("head", F.lit(2))
    out = bpe.encode(df, "doc_id", "text", long_chars=1000, piece_chars=300, fan=2, edge=20)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = sorted((r["doc_id"], r["ids"]) for r in out.collect())
    assert got == sorted((i, ENC.whole(t) if t else []) for i, t, _ in rows)
    counts = bpe.encode(df, "doc_id", "text", count_only=True, keep=["h"], long_chars=1000, piece_chars=300)
    assert sorted(map(tuple, counts.collect())) == sorted((i, s, len(ENC.whole(t)) if t else 0) for i, t, s in rows)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", [" " * 60_000, " " * 60_000 + "x", "\n" * 40_000 + "x\n \n" * 9000, "　" * 30_000, "0123456789" * 5000], ids=["spaces", "spaces and a word", "line ends", "wide spaces", "digits"])
def test_long_runs_against_the_other_library(text):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    assert joined(text, bpe.PIECE).ids.tolist() == other.encode(text, add_special_tokens=False).ids
