"""Frequency of every distinct value or term, in vertical layout.

Every term has a compressed bitmap of the records that hold it and, beside
it, a counter of its occurrences. A bitmap is kept as its non-zero 64-bit
words, one row (field, term, word, bits, occurrences) per word: a term of one
record costs one word, a term of all records one row per 64 records, and no
term's bitmap ever stands in one task as a whole. Bitmaps merge by union
(bit_or) and the document frequency is read from the cardinality (bit_count).

Defined results
- A record counts once per term however often it holds it; ``occurrences``
  counts each time. Records with equal content but different ids all count.
- Null and empty term lists give nothing; null terms are dropped.
- Record ids are unique BIGINTs (negative ones too). Rows with a null id
  cannot be told apart and are left out.
- An empty table gives no rows. Input columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = 6  # 2**6 bits in a word


def term_bitmaps(df: DataFrame, record_id: str | Column, fields: dict[str, Column]) -> DataFrame:
    """(field, term, word, bits, occurrences). ``fields`` maps a field's name
    to an array<string> column with the terms of a record. The words are
    unioned inside each task before they are shuffled."""
    rid = F.col(f"`{record_id}`") if isinstance(record_id, str) else record_id
    lists = F.array(*[F.struct(F.lit(name).alias("field"), terms.cast("array<string>").alias("terms")) for name, terms in fields.items()])
    rows = df.select(rid.cast("bigint").alias("rid"), F.inline(lists)).where("rid is not null")
    rows = rows.select("rid", "field", F.explode("terms").alias("term")).where("term is not null")
    bit = F.expr(f"shiftleft(1L, cast(rid & {2**_WORD - 1} as int))")
    rows = rows.select("field", "term", F.shiftright("rid", _WORD).alias("word"), bit.alias("bit"))
    return rows.groupBy("field", "term", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("occurrences"))


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Union of bitmap tables, e.g. of yesterday's collection and today's
    arrivals. The parts must not share records, or their occurrences add up."""
    return reduce(DataFrame.unionByName, parts).groupBy("field", "term", "word").agg(F.bit_or("bits").alias("bits"), F.sum("occurrences").alias("occurrences"))


def frequencies(bitmaps: DataFrame) -> DataFrame:
    """(field, term, occurrences, records)."""
    return bitmaps.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.bit_count("bits")).cast("bigint").alias("records"))


def records_with_terms(df: DataFrame, record_id: str | Column, fields: dict[str, Column]) -> DataFrame:
    """(field, field_records): how many records have a term in the field. One
    row per field, so at most len(fields) rows."""
    rid = F.col(f"`{record_id}`") if isinstance(record_id, str) else record_id
    counts = [F.struct(F.lit(name).alias("field"), F.count_if(rid.isNotNull() & F.exists(terms, lambda t: t.isNotNull())).alias("field_records")) for name, terms in fields.items()]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def marked_frequencies(df: DataFrame, record_id: str | Column, fields: dict[str, Column], rare_below: int = 3, common_above: int = 20) -> DataFrame:
    """(field, term, occurrences, records, mark): mark is ``rare`` for terms in
    fewer than ``rare_below`` records, else ``common`` for terms in more than
    one in ``common_above`` of the records that have a term in the field, else
    null. The broadcast side has one row per field."""
    freq = frequencies(term_bitmaps(df, record_id, fields))
    totals = F.broadcast(records_with_terms(df, record_id, fields))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_above > F.col("field_records"), "common")
    return freq.join(totals, "field").select("field", "term", "occurrences", "records", mark.alias("mark"))


def dotted_terms(text: Column) -> Column:
    """Parts of the lower-cased text between dots, without spaces and tabs at
    their ends; empty ones are dropped."""
    return F.filter(F.transform(F.split(F.lower(text), "[.]", -1), whole_term), lambda t: t != "")


def whole_term(text: Column) -> Column:
    """The lower-cased text without spaces and tabs at its ends."""
    return F.btrim(F.lower(text), F.lit(" \t"))
