"""Row numbers over whole groups of any size, without a task that holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table


def ranked(rows: DataFrame, scope: list[str], order: list[str], name: str = "rank", with_size: bool = False) -> DataFrame:
    """``rows`` with their 1-based number within ``scope`` in the order of ``order`` (ascending, nulls first; ties are numbered in any order).

    Rows are laid out in ranges of (scope, order), which Spark samples to be of equal size, and numbered range by range; what lies before a range is a
    prefix sum over one count per range and scope.  So a scope that holds a third of all rows is as many tasks as it has ranges.  ``with_size`` adds
    ``<name>_of``, the rows of the scope.
    """
    laid = rows.repartitionByRange(*scope, *order).withColumn("_range", F.spark_partition_id())
    laid = shared_table(laid)  # a range's number has to stay what it is
    at = Window.partitionBy("_range", *scope).orderBy(*order)
    counts = laid.groupBy(*scope, "_range").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*scope).orderBy("_range")
    before = counts.select(*scope, "_range", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*scope)).alias("_of"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*scope, "_range"]]
    numbered = laid.withColumn("_at", F.row_number().over(at)).alias("r").join(before.alias("b"), keys).select("r.*", "_before", "_of")
    out = numbered.withColumn(name, (F.col("_at") + F.col("_before")).cast("long"))
    if with_size:
        out = out.withColumn(f"{name}_of", F.col("_of"))
    return out.drop("_range", "_at", "_before", "_of")
