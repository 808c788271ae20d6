"""Subject areas of documents by an anchored non-negative factorisation.

The document-term matrix X is factored as W H with non-negative parts by
alternating multiplicative updates (Kullback-Leibler form). Each subject
anchors one component and one more is common to all documents (sentence
frames, menus, notices, names). Labels enter through W alone: a labelled
document may use the components of its subjects and the common one, nothing
else. H starts without any difference between the components.

1. Anchoring: updates over the labelled documents, of which there are at most
   ``max_labelled``. They decide for the terms of ``SEEN`` or more labelled
   documents which components may hold them; under multiplicative updates a
   zero stays zero, so a component keeps meaning its subject.
2. Corpus: updates over all documents, in which every other term starts open,
   nearly all of it in the common component, and goes where the mixtures of
   its documents take it.

After each update a subject keeps of a term only what exceeds ``EVEN`` of the
term's mass in all subjects (and of ``DOUBT`` occurrences more; large
subjects count less), the rest becomes common; so what subjects share, and what is too rare to tell, speaks
for none.

Each task solves W for its documents with H fixed and adds up its part of the
numerator; the parts are summed per term, and H is updated per partition of
the terms. Terms are hashed into ``BUCKETS``, which bounds H whatever the size
of the corpus. Only the terms that speak for a subject return to the tasks;
neither W nor the vocabulary comes to the driver.

A document's units (sentences or list items) are judged by the
responsibilities of the components for their words, H[s, t] W[s, d] over the
sum of all components: a unit is about the subject that has more of them than
the other subjects together, if they come to ``ABOUT`` words.

Defined results
- One row per document and subject found; none, one or several per document.
  Copies of a document are judged alike, each for itself.
- Null, empty and blank texts give no rows. Texts of any length are used whole.
- Headings, single short lines, and lines of menu items are no units.
- Labels are folded to lower case and trimmed; labels that are not in the
  list of subjects are ignored, repeated ones count once; a null label says
  that the document has no subject. Without usable labels nothing is found.
- Labels of at most ``max_labelled`` documents (smallest hashes of the id) are
  used; the corpus updates and the judgement run over every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.storage import materialize

#: Terms (words) are hashed into so many buckets.
BUCKETS = 1 << 20
MAX_LABELLED = 50_000
#: Terms of so many labelled documents are placed by the labels.
SEEN = 3
#: What a subject may share with the others, and the occurrences a term has to outweigh.
EVEN, DOUBT = 0.5, 5.0
#: The part of each subject in a term that nothing is known of.
OPEN = 0.02
#: Words whose responsibility a subject must have in a unit.
ABOUT = 0.5
#: Multiplicative steps that solve W.
STEPS = 6
#: Words of one block of documents (a longer document is a block of its own).
_BLOCK = 1 << 20
_ITEM, _SHORT, _SENTENCE = 1, 2, 0
# UTF-8 bytes that were read as one-byte characters (Windows-1252, with the
# bytes it leaves undefined as control codes): a lead and its followers.
_BYTE_OF = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)}
_TAIL = "[" + "".join(re.escape(ch) for ch, b in _BYTE_OF.items() if b < 0xC0) + "]"
_GARBLED = re.compile(f"[\u00c2-\u00df]{_TAIL}|[\u00e0-\u00ef]{_TAIL}{{2}}|[\u00f0-\u00f4]{_TAIL}{{3}}")
_ENDS = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+|(?<=[.!?…][\"”’»)])\s+|(?<=[。！？])")
_WORD = re.compile("[a-zß-ɏͰ-῿\ufffd]+|[一-鿿々ァ-ヺー]+")
_BREAK = re.compile(r"[\r\n\v\f\x85  ]+")
_MENU = re.compile(r"\s[·|»›•]\s|  +")
_STOP = re.compile(r"[.!?…。！？]")
_BULLET = re.compile(r"\s*[-*•–]\s")


def _restored(found: re.Match) -> str:
    try:
        return bytes(_BYTE_OF[ch] for ch in found[0]).decode()
    except UnicodeDecodeError:
        return found[0]


def units(text: str) -> Iterator[tuple[list[str], int]]:
    """(words, kind) of each unit that has words, in order. Garbled characters
    are restored where their bytes are whole."""
    for line in _BREAK.split(_GARBLED.sub(_restored, text)):
        stops = _STOP.search(line)
        if not stops and len(_MENU.findall(line)) >= 2:
            continue
        held: list[str] = []
        for part in _ENDS.split(line) if stops else (line,):
            words = _WORD.findall(part.lower())
            if not words:
                continue
            if held:
                words, held = held + words, []
            if len(words) <= 4 and part.rstrip().endswith("?"):
                held = words  # a short question belongs to its answer
                continue
            if _BULLET.match(part):
                yield words, _ITEM
            elif len(words) <= 5 and not _STOP.search(part):
                yield words, _SHORT
            else:
                yield words, _SENTENCE
        if held:
            yield held, _SENTENCE


def tokenized(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, toks, lens, kinds): the words' buckets, and length and kind of
    each unit. Documents without words are left out: they have no subject."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null and text <> ''")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[str, int] = {}
        for batch in batches:
            toks, lens, kinds = [], [], []
            for text in batch.column(1).to_pylist():
                t, n, k = [], [], []
                for words, kind in units(text):
                    n.append(len(words))
                    k.append(kind)
                    for w in words:
                        b = bucket.get(w)
                        if b is None:
                            b = bucket[w] = zlib.crc32(w.encode()) % BUCKETS
                        t.append(b)
                toks.append(t)
                lens.append(n)
                kinds.append(k)
            if len(bucket) > 1 << 20:
                bucket.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(toks, pa.list_(pa.int32())), pa.array(lens, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int8()))], ["doc_id", "toks", "lens", "kinds"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, toks array<int>, lens array<int>, kinds array<tinyint>").where("size(toks) > 0")


@dataclass
class Block:
    """Some documents as flat arrays."""

    docs: int
    tok: np.ndarray  # bucket of each word
    unit: np.ndarray  # unit of each word
    unit_doc: np.ndarray  # document of each unit
    kind: np.ndarray  # kind of each unit

    @classmethod
    def of(cls, batch: pa.RecordBatch, first: int) -> Block:
        toks, lens, kinds = (batch.column(i) for i in (first, first + 1, first + 2))
        n = np.asarray(lens.flatten())
        per_doc = np.diff(np.asarray(lens.offsets))
        return cls(batch.num_rows, np.asarray(toks.flatten()).astype(np.int64), np.repeat(np.arange(len(n)), n), np.repeat(np.arange(batch.num_rows), per_doc), np.asarray(kinds.flatten()))


def _blocks(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The batches in slices of about _BLOCK words."""
    for batch in batches:
        ends = np.asarray(batch.column(first).offsets)[1:].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            begin = ends[at - 1] if at else np.asarray(batch.column(first).offsets)[0]
            to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
            part = batch.slice(at, to - at)
            yield part, Block.of(part, first)
            at = to


@dataclass
class Model:
    """H by its columns: the components' parts in each term that speaks for a
    subject (component x term; the last component is the common one), the mass
    of each component, and the terms that labels have placed. Every other term
    is common if it is placed, and open if not."""

    terms: np.ndarray
    parts: np.ndarray
    mass: np.ndarray
    known: np.ndarray

    def columns(self, others: str) -> tuple[np.ndarray, np.ndarray]:
        """(H, index): columns 0 (an open term), 1 (a common one), then the
        terms; ``index`` gives each bucket's column. ``others`` says what terms
        are that labels have not placed: open, common or left out (-1)."""
        k = len(self.mass) - 1
        fixed = np.zeros((k + 1, 2))
        fixed[:, 0] = [OPEN] * k + [1 - OPEN * k]
        fixed[k, 1] = 1
        index = np.full(BUCKETS, {"open": 0, "common": 1, "none": -1}[others], np.int32)
        index[self.known] = 1
        index[self.terms] = np.arange(len(self.terms)) + 2
        return (np.concatenate([fixed, self.parts], 1) / np.maximum(self.mass, 1e-9)[:, None]).astype(np.float32), index


def blank(known: np.ndarray, sizes: np.ndarray) -> Model:
    """The start: components differ in nothing but the documents of their subject."""
    mass = np.append(np.maximum(sizes, 1.0), max(sizes.sum(), 1.0))
    return Model(known, np.repeat(mass[:, None] / mass.sum(), len(known), 1), mass, known)


def _scaled(h: np.ndarray) -> np.ndarray:
    return h / (h.sum(0) + 1e-30)


def mixtures(block: Block, H: np.ndarray, col: np.ndarray, allowed: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """W (component x document) with H fixed. ``col`` gives each word's column
    of H (-1: not in it), ``allowed`` the subjects a document may have."""
    k, doc = len(H) - 1, block.unit_doc[block.unit]
    plain = [np.bincount(doc[col == c], minlength=block.docs).astype(np.float32) for c in (0, 1)]
    told = np.flatnonzero(col >= 2)
    cell, n = np.unique(doc[told] * H.shape[1] + col[told], return_counts=True)
    row, h, n = cell // H.shape[1], H[:, cell % H.shape[1]], n.astype(np.float32)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    W = np.ones((k + 1, block.docs), np.float32)
    for step in range(steps):
        if allowed is not None:
            W[:k] *= allowed
        new = _scaled(H[:, :1] * W) * plain[0]
        new[k] += plain[1]
        if len(row):
            new[:, row[first]] += np.add.reduceat(_scaled(h * W[:, row]) * n, first, axis=1)
        W = new
    return W


def _sums(block: Block, H: np.ndarray, col: np.ndarray, W: np.ndarray, acc: np.ndarray) -> None:
    """Adds the responsibilities of the components for every word to ``acc``
    (component x bucket); words that can only be common are added to its last
    column."""
    doc = block.unit_doc[block.unit]
    acc[-1, -1] += np.count_nonzero(col == 1)
    opened = _scaled(H[:, :1] * W)
    for at, part in ((np.flatnonzero(col == 0), None), (np.flatnonzero(col >= 2), col)):
        own, place = np.unique(block.tok[at], return_inverse=True)
        if not len(at):
            continue
        r = opened[:, doc[at]] if part is None else _scaled(H[:, col[at]] * W[:, doc[at]])
        for s in range(len(H)):
            acc[s, own] += np.bincount(place, r[s], len(own))


def apart(N: np.ndarray, mass: np.ndarray, doubt: float, even: float = EVEN) -> np.ndarray:
    """Numerators (component x term) after what subjects share has become common.
    Large subjects count less by the square root of their ``mass``."""
    size = np.maximum(mass[:-1, None], 1e-9)
    weight = np.sqrt(size.mean() / size)
    level = N[:-1] * weight
    share = level / (level.sum(0) + doubt * weight + 1e-20)
    kept = N[:-1] * np.clip((share - even) / (1 - even), 0, 1)
    return np.concatenate([kept, N[-1:] + (N[:-1] - kept).sum(0)])


def unit_subjects(block: Block, H: np.ndarray, col: np.ndarray, W: np.ndarray, about: float = ABOUT) -> np.ndarray:
    """(document x subject): units about the subject."""
    k, n_units = len(H) - 1, len(block.unit_doc)
    at = np.flatnonzero(col >= 2)
    unit = block.unit[at]
    r = _scaled(H[:, col[at]] * W[:, block.unit_doc[unit]])
    score = np.stack([np.bincount(unit, r[s], n_units) for s in range(k)])
    best, most = score.argmax(0), score.max(0)
    speaks = (most >= about) & (2 * most > score.sum(0))
    brief = block.kind != _SENTENCE
    same = block.unit_doc[1:] == block.unit_doc[:-1]
    pairs = same & (brief & speaks)[1:] & (brief & speaks)[:-1]
    listed = np.r_[pairs, False] | np.r_[False, pairs]
    counts_as = speaks & ((block.kind != _SHORT) | listed)
    found = np.zeros((block.docs, k), np.int64)
    np.add.at(found, (block.unit_doc[counts_as], best[counts_as]), 1)
    return found


# -- over the corpus ----------------------------------------------------------

_PARTS = "term int, v array<double>"


def _rows(term: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Rows (term, v); ``values`` is (column x term)."""
    v = pa.ListArray.from_arrays(pa.array(np.arange(len(term) + 1) * len(values), pa.int32()), pa.array(values.T.ravel().astype(np.float64)))
    return pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), v], ["term", "v"])


def _table(batch: pa.RecordBatch | pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(batch.column("term")).astype(np.int64), np.asarray(v.flatten()).reshape(-1, columns).T


def label_masks(labels: DataFrame, subjects: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, mask): bit s for subject s; 0 for documents labelled as having none."""
    name = F.lower(F.regexp_replace("subject", r"^\s+|\s+$", ""))
    clean = labels.where("doc_id is not null").select("doc_id", name.alias("subject"))
    bit = F.lit(0).cast("bigint")
    for i, s in enumerate(subjects):
        bit = F.when(F.col("subject") == s, F.lit(1 << i).cast("bigint")).otherwise(bit)
    clean = clean.where(F.col("subject").isNull() | F.col("subject").isin(subjects)).select("doc_id", bit.alias("bit"))
    return clean.groupBy("doc_id").agg(F.bit_or("bit").alias("mask")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def placed_terms(labelled: DataFrame) -> np.ndarray:
    """The terms of SEEN or more labelled documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(BUCKETS, np.int64)
        for _, block in _blocks(batches, 2):
            cell = np.unique(block.unit_doc[block.unit] * BUCKETS + block.tok)
            docs += np.bincount(cell % BUCKETS, minlength=BUCKETS)
        own = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(docs[own])], ["term", "n"])

    sums = labelled.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = sums.where(F.col("n") >= SEEN).select("term").toArrow()
    return np.sort(np.asarray(found.column("term")).astype(np.int64))


def updated(matrix: DataFrame, model: Model, others: str, doubt: float) -> Model:
    """The model after one update over the documents of ``matrix``
    (doc_id, mask, toks, lens, kinds). What comes back to the driver are the
    terms that speak for a subject and a row of masses per partition."""
    shared = matrix.sparkSession.sparkContext.broadcast(model)
    parts = len(model.mass)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        H, index = shared.value.columns(others)
        acc = np.zeros((parts, BUCKETS + 1))
        for batch, block in _blocks(batches, 2):
            mask = np.asarray(batch.column(1).fill_null(-1))  # no label: every bit is set
            allowed = ((mask >> np.arange(parts - 1)[:, None]) & 1).astype(np.float32)
            col = index[block.tok]
            _sums(block, H, col, mixtures(block, H, col, allowed), acc)
        own = np.flatnonzero(acc.any(0))
        yield _rows(own, acc[:, own])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(parts)
        for batch in batches:
            term, N = _table(batch, parts)
            N = apart(N, shared.value.mass, doubt)
            mass += N.sum(1)
            speaks = (N[:-1].max(0) > 0) & (term < BUCKETS)
            yield _rows(term[speaks], _scaled(N[:, speaks]))
        yield _rows(np.array([-1]), mass[:, None])

    sums = matrix.mapInArrow(solve, _PARTS).groupBy("term").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(parts)]).alias("v"))
    term, values = _table(sums.mapInArrow(place, _PARTS).toArrow(), parts)
    shared.unpersist()
    order = np.argsort(term, kind="stable")
    term, values = term[order], values[:, order]
    n = int(np.searchsorted(term, 0))
    return Model(term[n:], values[:, n:], values[:, :n].sum(1), model.known)


def fit(matrix: DataFrame, subjects: list[str], anchoring: int = 3, passes: int = 2) -> Model | None:
    """The factorisation of ``matrix`` (doc_id, mask, toks, lens, kinds, labelled)."""
    labelled = matrix.where("labelled")
    known = placed_terms(labelled)
    if not len(known):
        return None
    bits = [F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).alias(f"n{i}") for i in range(len(subjects))]
    model = blank(known, np.array(labelled.agg(*bits).first(), float))
    for _ in range(anchoring):
        model = updated(labelled, model, "none", 0.0)
    for _ in range(passes):
        model = updated(matrix, model, "open", DOUBT)
    return model


def judged(matrix: DataFrame, model: Model | None, subjects: list[str], mixed: bool = True) -> DataFrame:
    """(doc_id, subject, units, weight): subjects with at least one unit, and
    their share of the document's mixture (the common component included).
    ``mixed`` False holds every mixture at one, to show what W does."""
    spark, kind = matrix.sparkSession, matrix.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject string, units bigint, weight double"
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        H, index = shared.value.columns("common")
        names = pa.array(subjects)
        for batch, block in _blocks(batches, 2):
            col = index[block.tok]
            W = mixtures(block, H, col) if mixed else np.ones((len(H), block.docs), np.float32)
            found = unit_subjects(block, H, col, W)
            d, s = np.nonzero(found)
            weight = _scaled(W)[s, d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), names.take(pa.array(s)), pa.array(found[d, s]), pa.array(weight.astype(np.float64))], ["doc_id", "subject", "units", "weight"])

    return matrix.mapInArrow(judge, schema)


def document_terms(documents: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The matrix (doc_id, mask, toks, lens, kinds, labelled), written once with
    the labelled documents in files of their own."""
    masks = F.broadcast(label_masks(labels, subjects, max_labelled))  # at most max_labelled rows of 16 bytes
    matrix = tokenized(documents, doc_id, text).join(masks, "doc_id", "left")
    return materialize(matrix.select("doc_id", "mask", "toks", "lens", "kinds", F.col("mask").isNotNull().alias("labelled")), "matrix", "labelled")


def subject_units(documents: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Fits on the corpus and judges every document of it; see ``judged``."""
    matrix = document_terms(documents, labels, subjects, doc_id, text, max_labelled)
    return judged(matrix, fit(matrix, subjects), subjects)
