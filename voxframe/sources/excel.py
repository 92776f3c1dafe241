"""Spreadsheets as a Python data source (SC-02); needs ``openpyxl`` or ``xlrd``, which are optional."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def _frame(path: str):
    import pandas as pd

    try:
        return pd.read_excel(path, sheet_name=0, dtype=str, keep_default_na=False)
    except ImportError as e:
        raise ImportError(f"reading {path} needs an Excel library (openpyxl for .xlsx, xlrd for .xls): {e}") from e


class WideSheet(DataSource):
    """The first sheet of a workbook, every cell a string."""

    @classmethod
    def name(cls) -> str:
        return "wide_sheet"

    def schema(self) -> StructType:
        return StructType([StructField(str(c), StringType()) for c in _frame(self.options["path"]).columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a workbook is one file with one first sheet

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _frame(self.path).itertuples(index=False, name=None)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WideSheet)
    return spark.read.format("wide_sheet").option("path", path).load()
