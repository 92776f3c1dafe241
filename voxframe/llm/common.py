"""Shared helpers of the training-text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_table, ship_package

#: A word: an unbroken run of letters, combining marks and digits, of the lower-cased text.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+"
#: What a squeezed text drops after lower-casing.
NON_WORD_PATTERN = r"[^\p{L}\p{M}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one test table; pruning reaches the Parquet scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def squeezed(column):
    """Lower-cased with every character that is no letter, mark or digit dropped (stays in the JVM)."""
    return F.regexp_replace(F.lower(column), NON_WORD_PATTERN, "")


#: Cuts the lineage with a table in the folder all executors share.
shared_checkpoint = shared_table


def map_columns(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, Iterable]], schema: str
) -> DataFrame:
    """Run ``function`` over Arrow batches, columns as Python lists in, columns as iterables out."""
    ship_package(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            got = function({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def spread(held: DataFrame, asked: DataFrame, keys: list[str], point: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``keys`` with a further key ``block``, so that no key is one task's work however many rows it holds.

    Keys with more than ``block_rows`` held rows are cut into blocks of about that many by a hash of ``point``; an asked row goes to each
    block of its key.  Keys are counted with map-side combining, and only the hot ones are written down and joined (by size: Spark
    broadcasts them where they are few).  Every pair of a held and an asked row still meets exactly once.
    """
    n = F.count(F.lit(1))
    hot = held.groupBy(*keys).agg(n.alias("n")).where(F.col("n") > block_rows)
    hot = shared_checkpoint(hot.select(*keys, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    left = held.join(hot, keys, "left").withColumn("block", F.pmod(F.xxhash64(point), blocks.cast("long")).cast("int")).drop("blocks")
    right = asked.join(hot, keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    return left, right

def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer file; every operator takes another path as a parameter."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
