"""Appending waves as a stream (ST-01 .. ST-04).

Deduplication is by multiset, not by set: a file may hold a row twice because two people said the same.  So every batch is compared
with the stored multiplicities, and a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.dates import bucket_label, parse_date
from ..operators.matching import flag_duplicates

ROW = "dataset_id bigint, upload_id bigint, row_index bigint, row_hash string"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """What is held so far; only a path that is not there yet means nothing, any other failure is one."""
    schema = T._parse_datatype_string(ROW + ", source_row_index bigint, batch_id bigint")
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


def wave_numbers(rows: DataFrame) -> DataFrame:
    """Rows (dataset_id, row_offset) with the number of their file in its dataset, ``wave`` from 1."""
    files = rows.select("dataset_id", "row_offset").distinct()
    numbered = files.withColumn("wave", F.row_number().over(Window.partitionBy("dataset_id").orderBy("row_offset")))
    return rows.join(numbered, ["dataset_id", "row_offset"])


def append_new(batch: DataFrame, batch_id: int, path: str) -> None:
    """ST-01, ST-02: of one batch the rows not held yet, each with its lasting index; earlier rows keep theirs.

    Rows that this batch already wrote (a replay) are left out of the comparison and written over.
    """
    spark = batch.sparkSession
    held = _stored(spark, path).where(F.col("batch_id") < batch_id)
    flagged = flag_duplicates(batch.select("dataset_id", "upload_id", "row_index", "row_hash"), held, ["dataset_id"])
    fresh = flagged.where("NOT is_duplicate").drop("is_duplicate")
    start = held.groupBy("dataset_id").agg((F.max("source_row_index") + 1).alias("start"))
    placed = fresh.join(start, "dataset_id", "left").withColumn("source_row_index", F.col("row_index") + F.coalesce("start", F.lit(0))).drop("start")
    placed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of hashed rows appended to ``path``; call ``start()`` on it."""
    return rows.writeStream.foreachBatch(lambda df, i: append_new(df, i, path)).option("checkpointLocation", checkpoint)


def unseen(stream: DataFrame, assignments: DataFrame) -> DataFrame:
    """ST-03: streamed responses without a record (stream-static anti join)."""
    return stream.join(assignments.select(F.col("response_key").alias("_k")), F.col("response_key") == F.col("_k"), "left_anti")


def period_stream(stream: DataFrame, date: str, granularity: str) -> DataFrame:
    """ST-04: responses per calendar period while they arrive, one total each (write with output mode complete or update).

    The state is one count per period, which is as many as a survey has quarters or months, so none ever needs to be dropped and no row is too late.
    """
    return stream.groupBy(bucket_label(parse_date(F.col(date)), granularity).alias("period")).agg(F.count(F.lit(1)).alias("n"))
