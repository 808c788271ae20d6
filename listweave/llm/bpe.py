"""Encoding with a public byte-level BPE vocabulary, also of very long texts.

Texts up to ``LONG`` characters are encoded whole where they are read. A
longer text is cut into pieces that are encoded in parallel and put together
as a tree: two neighbours become the exact encoding of their joined text by
re-encoding a window around the join, which grows until it agrees with both
sides. No cut has to fall on a word border, and a run of letters of any
length without any border is joined in the same way token by token.

The tree spans tasks: ``FAN`` neighbours meet in one task of a level, and of
what they are joined to only the two edges go on to the next level; the tokens
between are done. An edge reaches to a border that no text before or behind it
can move (the end of a run of letters or of digits), so the joins of the next
levels find all they need in it. Only a text without such a border, one run
from end to end, is carried whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listweave.storage import materialize

#: Folder of the public vocabularies and the one used here; both are parameters.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts of more characters are encoded in pieces of PIECE characters.
LONG, PIECE = 16384, 8192
#: Neighbours that are joined in one task of a level, and the least bytes of an edge.
FAN, EDGE = 16, 256

# Fixed value: the published word pattern of this vocabulary; \s is spelled as
# the Unicode property because the two regex engines differ on control codes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word's end is settled once so many characters follow it in the same text.
_AHEAD = 3


class Encoder:
    """A tiktoken encoder of one vocabulary file; strings that look like
    special tokens are ordinary text."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        import regex
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.whole = self.encoding.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        spelled = WORDS.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(spelled)
        # No match of WORDS goes on from a letter to anything else, nor from a digit.
        self.fixed = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")

    def run(self, data: bytes) -> list[int]:
        """BPE of bytes taken as one word."""
        return self.encoding._encode_single_piece(data)  # noqa: SLF001

    def starts(self, text: str) -> np.ndarray:
        """Byte offsets at which the words of the text begin."""
        at = np.fromiter((m.start() for m in self.words.finditer(text)), np.int64)
        if text.isascii():
            return at
        widths = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))
        return np.where(at > 0, ends[at - 1], 0)

    def piece(self, text: str) -> Piece:
        return Piece(text.encode(), np.array(self.whole(text), np.int64), self.starts(text))


@dataclass
class Piece:
    """The exact encoding of ``data`` as a text of its own."""

    data: bytes
    ids: np.ndarray
    starts: np.ndarray


@dataclass
class Node:
    """A joined part of a text, from byte ``at``: ``left`` alone if it is held
    whole, else its two edges; the tokens between them are done."""

    at: int
    left: Piece
    right_at: int = 0
    right: Piece | None = None

    @property
    def end(self) -> int:
        return self.right_at + len(self.right.data) if self.right else self.at + len(self.left.data)


def _back(data: bytes, chars: int) -> int:
    """Offset so many characters before the end, 0 at least."""
    i = len(data)
    while i > 0 and chars > 0:
        i -= 1
        chars -= (data[i] & 0xC0) != 0x80
    return i


def _boundary(data: bytes, i: int) -> int:
    """The first character border at or after i."""
    while i < len(data) and (data[i] & 0xC0) == 0x80:
        i += 1
    return i


def join_run(enc: Encoder, left: np.ndarray, right: np.ndarray, data: bytes) -> list[int]:
    """BPE of one word from those of its two halves. ``data`` is the word.

    A sequence of tokens is the BPE of its text exactly if every two
    neighbours are, so the window's encoding fits as soon as its outermost
    tokens are the ones the halves have there.
    """
    lens, cut = enc.size, int(enc.size[left].sum())
    w = 4
    while True:
        n, m = min(w, len(left)), min(w, len(right))
        a, b = cut - int(lens[left[-n:]].sum()), cut + int(lens[right[:m]].sum())
        mid = enc.run(data[a:b])
        if (n == len(left) or mid[0] == left[-n]) and (m == len(right) or mid[-1] == right[m - 1]):
            return [*left[:-n].tolist(), *mid, *right[m:].tolist()]
        w *= 2


def join(enc: Encoder, left: Piece, right: Piece) -> Piece:
    """The exact encoding of left.data + right.data. Either may be an edge:
    a left one begins with a word, a right one has a border that cannot move."""
    if not left.data or not right.data:
        return right if not left.data else left
    data, cut, end = left.data + right.data, len(left.data), len(left.data) + len(right.data)
    settled = left.starts[left.starts <= _back(left.data, _AHEAD)]
    a = int(settled[-1]) if len(settled) else 0
    width = 64
    while True:
        b = _boundary(data, min(cut + width, end))
        window = data[a:b]
        words = a + enc.starts(window.decode())
        known = words if b == end else words[words <= a + _back(window, _AHEAD)]
        shared = known[(known >= cut) & np.isin(known - cut, right.starts)]
        if len(shared) or b == end:
            y = int(shared[0]) if len(shared) else end
            break
        width *= 4
    fresh = words[words < y]
    left_end, right_start = np.cumsum(enc.size[left.ids]), np.cumsum(enc.size[right.ids]) - enc.size[right.ids]
    ids = left.ids[left_end <= a].tolist()
    for p, q in zip(fresh.tolist(), [*fresh[1:].tolist(), y]):
        first = int(right.starts[1]) if len(right.starts) > 1 else len(right.data)
        if q - p > 1024 and p < cut < q and p == int(left.starts[-1]) and q - cut == first:
            ids += join_run(enc, left.ids[left_end > p], right.ids[right_start < q - cut], data[p:q])
        else:
            ids += enc.run(data[p:q])
    kept = right.starts[right.starts >= y - cut] + cut
    return Piece(data, np.concatenate([np.array(ids, np.int64), right.ids[right_start >= y - cut]]), np.concatenate([left.starts[left.starts < a], fresh, kept]))


def join_all(enc: Encoder, pieces: list[Piece]) -> Piece:
    """Neighbours are joined two by two until one piece is left."""
    while len(pieces) > 1:
        pairs = [join(enc, *pieces[i : i + 2]) for i in range(0, len(pieces) - 1, 2)]
        pieces = pairs + pieces[len(pieces) - len(pieces) % 2 :]
    return pieces[0]


def _part(enc: Encoder, piece: Piece, a: int, b: int) -> Piece:
    """The words of a piece between two word borders."""
    ends = np.cumsum(enc.size[piece.ids])
    i, j = (int(np.searchsorted(ends, a, "right")) if a else 0), int(np.searchsorted(ends, b, "right"))
    starts = piece.starts[(piece.starts >= a) & (piece.starts < b)] - a
    return Piece(piece.data[a:b], piece.ids[i:j], starts)


def _front(enc: Encoder, piece: Piece, edge: int) -> int | None:
    """Where a left edge may end: at a word start with a fixed border and some
    characters before it, EDGE bytes at least."""
    width = 4 * edge
    while True:
        stop = _boundary(piece.data, min(width, len(piece.data)))
        text = piece.data[:stop].decode()
        at = [len(text[: m.start()].encode()) for m in enc.fixed.finditer(text) if 0 < m.start() < len(text)]
        far = [x for x in at if x >= edge]
        if len(far) >= 2 and (ok := [x for x in far if x >= far[0] + 16]):
            return ok[0]
        if stop == len(piece.data):
            return None
        width *= 4


def compact(enc: Encoder, node: Node, edge: int = EDGE) -> tuple[Node, list[tuple[int, np.ndarray]]]:
    """The node with edges as short as they may be, and (offset, ids) of the
    tokens that are done by that."""
    done = []
    if node.right is None:
        p = _front(enc, node.left, edge)
        q = node.left.starts[node.left.starts <= len(node.left.data) - edge]
        if p is None or not len(q) or q[-1] <= p:
            return node, done
        q = int(q[-1])
        middle = _part(enc, node.left, p, q)
        done.append((node.at + p, middle.ids))
        return Node(node.at, _part(enc, node.left, 0, p), node.at + q, _part(enc, node.left, q, len(node.left.data))), done
    p = _front(enc, node.left, edge)
    if p is not None and p < len(node.left.data):
        done.append((node.at + p, _part(enc, node.left, p, len(node.left.data)).ids))
        node = Node(node.at, _part(enc, node.left, 0, p), node.right_at, node.right)
    q = node.right.starts[node.right.starts <= len(node.right.data) - edge]
    if len(q) and q[-1] > 0:
        q = int(q[-1])
        done.append((node.right_at, _part(enc, node.right, 0, q).ids))
        node = Node(node.at, node.left, node.right_at + q, _part(enc, node.right, q, len(node.right.data)))
    return node, done


def join_nodes(enc: Encoder, left: Node, right: Node, edge: int = EDGE) -> tuple[Node, list[tuple[int, np.ndarray]]]:
    """Two neighbouring nodes as one, and the tokens that are done by that."""
    at = left.right_at if left.right else left.at
    met = join(enc, left.right or left.left, right.left)
    if left.right and right.right:
        return Node(left.at, left.left, right.right_at, right.right), [(at, met.ids)]
    if left.right:
        node = Node(left.at, left.left, at, met)
    elif right.right:
        node = Node(left.at, met, right.right_at, right.right)
    else:
        node = Node(left.at, met)
    return compact(enc, node, edge)


def join_level(enc: Encoder, nodes: list[Node], edge: int = EDGE) -> tuple[Node, list[tuple[int, np.ndarray]]]:
    """Neighbours two by two until one node is left."""
    done = []
    while len(nodes) > 1:
        pairs = []
        for i in range(0, len(nodes) - 1, 2):
            node, made = join_nodes(enc, nodes[i], nodes[i + 1], edge)
            pairs.append(node)
            done += made
        nodes = pairs + nodes[len(nodes) - len(nodes) % 2 :]
    return nodes[0], done


_NODE = T.StructType([T.StructField(n, T.BinaryType() if n in ("data", "data2") else T.LongType() if n in ("at", "at2") else T.ArrayType(T.LongType())) for n in ("at", "data", "ids", "starts", "at2", "data2", "ids2", "starts2")])


def _fields(node: Node) -> tuple:
    right = node.right or Piece(None, None, None)
    return node.at, node.left.data, node.left.ids, node.left.starts, node.right_at, right.data, right.ids, right.starts


def _node(r: dict) -> Node:
    piece = lambda n: Piece(r[f"data{n}"], np.array(r[f"ids{n}"], np.int64), np.array(r[f"starts{n}"], np.int64))
    return Node(r["at"], piece(""), r["at2"], piece("2") if r["data2"] is not None else None)


def encode(df: DataFrame, doc_id: str, text: str, count_only: bool = False, keep: list[str] | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, long_chars: int = LONG, piece_chars: int = PIECE, fan: int = FAN, edge: int = EDGE) -> DataFrame:
    """(doc_id, *keep, ids ARRAY<INT>), or n_tokens BIGINT for count_only.

    One row per input row. Null and empty texts give an empty list (0
    tokens). Rows with equal ids and texts stay separate rows. Only the
    named columns are read. Texts up to ``long_chars`` are not shuffled.
    """
    keep = keep or []
    head = df.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep]).schema.fields
    rows = df.select(F.col(f"`{text}`").alias("text"), F.struct(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep]).alias("head"))
    result = T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    out = T.StructType([*head, result])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder, vocabulary)
        for batch in batches:
            lists = [enc.whole(x) if x else [] for x in batch.column(0).to_pylist()]
            shown = pa.array([len(x) for x in lists], pa.int64()) if count_only else pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.column(1).flatten(), shown], out.names)

    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    joined = _encode_long(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), folder, vocabulary, piece_chars, fan, edge)
    size = F.sum("n") if count_only else F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda c: c["ids"]))
    whole = joined.groupBy("row").agg(F.first("head", ignorenulls=True).alias("head"), size.alias(result.name))
    return rows.where(~is_long).mapInArrow(short, out).unionByName(whole.select("head.*", result.name))


def _encode_long(rows: DataFrame, folder: str, vocabulary: str, piece_chars: int, fan: int, edge: int) -> DataFrame:
    """(row, head, offset, ids, n) of ``rows`` (text, head, row): runs of tokens
    and where they begin. Only the first run of a row has its head."""
    head = rows.schema["head"]
    cut_schema = T.StructType([T.StructField("row", T.LongType()), head, T.StructField("no", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(0).to_pylist()):
                offset = 0
                for first in range(0, len(text), 256 * piece_chars):
                    pieces = [text[j : j + piece_chars] for j in range(first, min(first + 256 * piece_chars, len(text)), piece_chars)]
                    ends = offset + np.cumsum([len(p.encode()) for p in pieces])
                    n = pa.array(np.full(len(pieces), i))
                    no = np.arange(len(pieces)) + first // piece_chars
                    yield pa.RecordBatch.from_arrays([batch.column(2).take(n), batch.column(1).take(n), pa.array(no), pa.array(np.r_[offset, ends[:-1]]), pa.array(pieces)], cut_schema.names)
                    offset = int(ends[-1])

    # ``node`` goes on to the next level, ``ids`` are done
    level_schema = T.StructType([T.StructField("row", T.LongType()), head, T.StructField("no", T.LongType()), T.StructField("node", _NODE), T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    node_type = pa.struct([(f.name, pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.list_(pa.int64())) for f in _NODE.fields])

    def table(row: pa.Array, heads: pa.Array, no: pa.Array, nodes: list[Node], done: list[list[tuple[int, np.ndarray]]]) -> pa.RecordBatch:
        """A node and its finished tokens for each entry of ``row``."""
        of = pa.array([i for i, d in enumerate(done) for _ in range(len(d) + 1)], pa.int64())
        states = pa.array([x for n, d in zip(nodes, done) for x in [dict(zip(_NODE.names, _fields(n))), *[None] * len(d)]], node_type)
        offset = pa.array([x for d in done for x in [None, *[o for o, _ in d]]], pa.int64())
        ids = pa.array([x for d in done for x in [None, *[i for _, i in d]]], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([row.take(of), heads.take(of), no.take(of), states, offset, ids], level_schema.names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [compact(enc, Node(o, enc.piece(x)), edge) for o, x in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                yield table(part.column(0), part.column(1), part.column(2), [n for n, _ in made], [d for _, d in made])

    def climb(group: pa.Table) -> pa.Table:
        enc = Encoder(folder, vocabulary)
        group = group.combine_chunks()
        nodes = [_node(r) for r in group.sort_by("no").column("node").to_pylist()]
        node, done = join_level(enc, nodes, edge)
        first = group.slice(0, 1).to_batches()[0]
        return pa.Table.from_batches([table(first.column(0), first.column(1), pa.array([first.column(2)[0].as_py() // fan]), [node], [done])])

    pieces = rows.select("text", "head", "row").mapInArrow(cut, cut_schema).repartition("row", "no")
    level = materialize(pieces.mapInArrow(leaves, level_schema), "pieces")
    finished = level.where("node is null").select("row", "offset", "ids")
    last = level.where("node is not null").agg(F.max("no")).first()[0] or 0
    while last > 0:
        nodes = level.where("node is not null").select("row", "head", "no", "node")
        level = materialize(nodes.groupBy("row", F.floor(F.col("no") / fan)).applyInArrow(climb, level_schema), "joined")
        finished = finished.unionByName(level.where("node is null").select("row", "offset", "ids"))
        last //= fan
    ends = level.where("node is not null")
    edges = F.array(F.struct(F.col("head"), F.col("node.at").alias("offset"), F.col("node.ids").cast("array<int>").alias("ids")), F.struct(F.lit(None).cast(head.dataType).alias("head"), F.col("node.at2").alias("offset"), F.coalesce(F.col("node.ids2"), F.array().cast("array<bigint>")).cast("array<int>").alias("ids")))
    ends = ends.select("row", F.inline(edges))
    return ends.unionByName(finished.withColumn("head", F.lit(None).cast(head.dataType))).withColumn("n", F.size("ids").cast("bigint"))
