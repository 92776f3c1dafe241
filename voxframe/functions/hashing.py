"""Hashes of rows, columns, corpora and definitions (SF-01 .. SF-05)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ZERO, ONE = "\x00", "\x01"


def row_hash(cells: list[Column]) -> Column:
    """SF-01: SHA-256 over the cells in file order, a zero byte after each; null counts as blank."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(c, F.lit("")), F.lit(ZERO)) for c in cells]), 256)


def array_hash(values: Column) -> Column:
    """SF-01 for a row whose cells are an array."""
    return F.sha2(F.array_join(F.transform(values, lambda v: F.concat(F.coalesce(v, F.lit("")), F.lit(ZERO))), ""), 256)


def ordered_fingerprint(df: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """SF-02: SHA-256 over a group's values in the order of ``order``, a zero byte after each.

    A group is one column of one file.  Its hash runs over all of it in order, so it is one task's work, but a stream: rows are sorted on disk if need
    be and only the running hash is held, whatever the length of the file.  ``block_fingerprint`` splits the work as well.
    """
    laid = df.select(*by, F.col(order).alias("_at"), F.coalesce(value, F.lit("")).alias("_cell")).repartition(*by).sortWithinPartitions(*by, "_at")
    kinds = dict(df.dtypes)
    schema = T._parse_datatype_string(", ".join(f"`{c}` {kinds[c]}" for c in by) + ", fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done: list[tuple] = []
            for *now, cell in zip(*(batch.column(c).to_pylist() for c in [*by, "_cell"])):
                if now != key:
                    if running is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = now, hashlib.sha256()
                running.update(cell.encode("utf-8") + b"\x00")
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip([*by, "fingerprint"], d)) for d in done], schema=arrow)
        if running is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*by, "fingerprint"], (*key, running.hexdigest())))], schema=arrow)

    arrow = to_arrow_schema(schema)
    return laid.mapInArrow(run, schema)


def block_fingerprint(df: DataFrame, by: list[str], order: str, value: Column, block: int = 10_000) -> DataFrame:
    """A fingerprint for columns of any length: the hash of the hashes of blocks of consecutive rows.

    It differs from SF-02 and compares only with itself.
    """
    blocks = ordered_fingerprint(df.withColumn("_block", F.floor(F.col(order) / block)), [*by, "_block"], order, value)
    return ordered_fingerprint(blocks, by, "_block", F.col("fingerprint"))


def corpus_fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """SF-03: one row that changes with any key or text, whatever the order of rows; no row is collected.

    The sums of two 32-bit halves of each row's hash, so partial aggregation does all the work.
    """
    h = F.sha2(F.concat(F.col(key), F.lit(ZERO), F.coalesce(F.col(text), F.lit("")), F.lit(ONE)), 256)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(half(1)).alias("sum_a"), F.sum(half(9)).alias("sum_b"))


def concept_fingerprint(concepts: DataFrame) -> DataFrame:
    """SF-03: one hash of what a sweep reads: names and spans (name, span), whatever the order of rows, and nothing else about the concepts."""
    each = concepts.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("span")), ONE).alias("spans"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(ZERO), "spans"))), ZERO + ONE)
    return each.agg(F.count(F.lit(1)).alias("n_concepts"), F.sha2(whole, 256).alias("fingerprint"))  # a lexicon is as long as a list a person keeps


def definition_hash(name: Column, description: Column, include: Column, exclude: Column) -> Column:
    """SF-04: 16 hex digits over a category's definition, blind to case and outer blanks."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.substring(F.sha2(F.concat_ws(ONE, part(name), part(description), part(include), part(exclude)), 256), 1, 16)


def pair_key(a: Column, b: Column, *salt: Column) -> Column:
    """SF-04: one key for an unordered pair."""
    return F.substring(F.sha2(F.concat_ws(ZERO, F.least(a, b), F.greatest(a, b), *salt), 256), 1, 20)


def canonical_key(payload: object) -> str:
    """SF-05 (driver side): 32 hex digits over a JSON document with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]
