"""Schema drift over wave_rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.drift import Drift
from ..registry import query


def _drift(spark: SparkSession, d: str) -> Drift:
    read = lambda t, *c: spark.read.parquet(f"{d}/{t}.parquet").select(*c)
    return Drift(
        read("wave_rows", "dataset_id", "upload_id", "row_index", "cells"),
        read("uploads", "dataset_id", "upload_id", "row_offset"),
        read("column_fingerprints", "dataset_id", "upload_id", "column_name"),
    )


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).changes()


@query()
def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).unified()
