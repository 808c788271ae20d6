"""Mergeable Bloom filters as tables of 64-bit words.

A key's 64-bit hash picks one word (by its upper 40 bits) and four bits in it
(by its lower 24 bits). The filter is the table of its non-zero words, so it
is built and merged by ordinary aggregation, partition by partition, and never
has to fit on the driver.

To be probed the words are packed, ``SLOTS`` to a block, and the blocks are
cut into segments of at most ``SEGMENT_BLOCKS`` (about 64 MB). A segment is
broadcast and the rows whose hashes fall into it are tested where they stand:
no row is shuffled to be probed, whatever the size of the filter. A filter of
one segment takes one reading of the rows; for a larger one the rows are first
written into a folder per segment, so that each is still read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.storage import materialize

BITS_PER_KEY = 12
#: Words of a block, and the blocks of a segment: 2^19 blocks of 128 bytes, enough for 44 million keys.
SLOTS, SEGMENT_BLOCKS = 16, 1 << 19
#: Hashes that one task holds at a time while it builds its part of a filter.
_FLUSH = 1 << 21


def words_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(keys * bits_per_key // 64, 1)


def word_of(h: Column, n_words: int) -> Column:
    return F.shiftrightunsigned(h, 24) % F.lit(n_words).cast("bigint")


def mask_of(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def membership_filter(hashes: DataFrame, n_words: int) -> DataFrame:
    """(word, bits) of the hashes in column ``h``; nulls are left out."""
    rows = hashes.where("h is not null").select(word_of(F.col("h"), n_words).alias("word"), mask_of(F.col("h")).alias("mask"))
    return rows.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def _words(hashes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, bits of the hashes seen at least once, and at least twice."""
    u, times = np.unique(hashes.view(np.uint64), return_counts=True)
    word = (u >> np.uint64(24)) % np.uint64(n_words)
    order = np.argsort(word, kind="stable")
    u, times, word = u[order], times[order], word[order]
    mask = np.zeros(len(u), np.uint64)
    for i in range(4):
        mask |= np.uint64(1) << ((u >> np.uint64(6 * i)) & np.uint64(63))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    once = np.bitwise_or.reduceat(mask, first)
    again = np.bitwise_or.reduceat(np.where(times > 1, mask, np.uint64(0)), first)
    return word[first].astype(np.int64), once.view(np.int64), again.view(np.int64)


def repeat_filter(hashes: DataFrame, n_words: int) -> DataFrame:
    """(word, bits): the filter of repeatedly seen hashes in column ``h``.

    Each task builds the words of its once-seen and of its repeatedly-seen
    hashes; merging two parts gives once = o1|o2 and repeated = r1|r2|(o1&o2),
    so a hash that two parts hold once each is repeated in the whole. There
    are no false negatives. Nulls are left out; words without repeats are not
    kept. What is shuffled are words, at most min(n_words, distinct hashes) a
    task, and one word gathers at most two values a flush of a task.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= _FLUSH:
                yield from emit(held)
                held = []
        yield from emit(held)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, held)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _words(np.concatenate(held), n_words)], ["word", "once", "again"])

    parts = hashes.select("h").where("h is not null").mapInArrow(build, "word bigint, once bigint, again bigint")
    merged = parts.groupBy("word").agg(F.collect_list("once").alias("once"), F.bit_or("again").alias("again"))
    folded = F.expr("aggregate(once, named_struct('o', 0L, 'r', again), (s, x) -> named_struct('o', s.o | x, 'r', s.r | (s.o & x)), s -> s.r)")
    return merged.select("word", folded.alias("bits")).where("bits <> 0")


def packed(words: DataFrame) -> DataFrame:
    """(block, b0, b1, ...): SLOTS words a row, 0 for absent ones."""
    slot = F.pmod("word", F.lit(SLOTS))
    return words.groupBy(F.shiftright("word", SLOTS.bit_length() - 1).alias("block")).agg(*[F.coalesce(F.bit_or(F.when(slot == i, F.col("bits"))), F.lit(0).cast("bigint")).alias(f"b{i}") for i in range(SLOTS)])


def might_contain(df: DataFrame, words: DataFrame, h: str, n_words: int, name: str, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """``df`` with a boolean column ``name``: whether the filter may hold the
    hash in column ``h``. False is certain. Null hashes give false."""
    word, mask = word_of(F.col(h), n_words), mask_of(F.col(h))
    block = F.shiftright(word, SLOTS.bit_length() - 1)
    kept = [F.col(f"`{c}`") for c in df.columns]
    segments = -(-(n_words // SLOTS + 1) // segment_blocks)
    blocks = packed(words)
    if segments > 1:
        segment = F.coalesce(F.floor(block / segment_blocks), F.lit(0)).cast("int")
        df = materialize(df.withColumn("_segment", segment), "segments", "_segment")
        blocks = materialize(blocks.withColumn("_segment", F.floor(F.col("block") / segment_blocks).cast("int")), "filter", "_segment")

    def probed(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = F.broadcast(side.select(F.col("block").alias("_block"), *[F.col(f"b{i}").alias(f"_b{i}") for i in range(SLOTS)]))
        bits = F.lit(0).cast("bigint")
        for i in range(SLOTS):
            bits = F.when(F.pmod(word, F.lit(SLOTS)) == i, F.col(f"_b{i}")).otherwise(bits)
        return rows.join(side, block == F.col("_block"), "left").select(*kept, F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False)).alias(name))

    if segments == 1:
        return probed(df, blocks)
    out = None
    for i in range(segments):
        part = probed(df.where(F.col("_segment") == i), blocks.where(F.col("_segment") == i))
        out = part if out is None else out.unionByName(part)
    return out
