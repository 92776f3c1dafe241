"""Duplicate rows and columns by multisets of hashes (JN-07 .. JN-09, WN-01, AG-22, AG-23, AG-31, ST-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def multiset(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def dataset_matches(file: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-07, AG-22: per stored dataset the rows it shares with the file, as multisets: sum of least(n_file, n_stored).

    ``file`` has file_id and row_hash, ``stored`` dataset_id and row_hash.  Outcome exact: every stored row is matched, or every row of
    the file; partial: some.
    """
    f, s = multiset(file, ["file_id", "row_hash"]), multiset(stored, ["dataset_id", "row_hash"])
    matched = (
        f.withColumnRenamed("n", "n_file").join(s.withColumnRenamed("n", "n_stored"), "row_hash")
        .groupBy("file_id", "dataset_id").agg(F.sum(F.least("n_file", "n_stored")).alias("matched"))
    )
    return (
        matched.join(multiset(file, ["file_id"]).withColumnRenamed("n", "file_rows"), "file_id")
        .join(multiset(stored, ["dataset_id"]).withColumnRenamed("n", "dataset_rows"), "dataset_id")
        .withColumn("outcome", F.when((F.col("matched") == F.col("file_rows")) & (F.col("matched") == F.col("dataset_rows")), "exact").otherwise("partial"))
    )


def flag_duplicates(file: DataFrame, stored: DataFrame, scope: list[str], order: str = "row_index") -> DataFrame:
    """WN-01: in file order, the k-th occurrence of a hash is a duplicate while k is at most its stored multiplicity.

    Only hashes that are stored at all are numbered, and those in ranges (``ranking.ranked``), so a hash that fills a third of a file is no one task's work.
    """
    known = multiset(stored, [*scope, "row_hash"]).withColumnRenamed("n", "stored_n")
    joined = file.join(known, [*scope, "row_hash"], "left")
    fresh = joined.where("stored_n IS NULL").select(*file.columns, F.lit(False).alias("is_duplicate"))
    numbered = ranked(joined.where("stored_n IS NOT NULL"), [*scope, "row_hash"], [order], "k")
    return fresh.unionByName(numbered.select(*file.columns, (F.col("k") <= F.col("stored_n")).alias("is_duplicate")))


def column_matches(file: DataFrame, stored: DataFrame) -> DataFrame:
    """AG-23, JN-09: how the columns of a file relate to those of a stored file, by name and by fingerprint.

    ``file``: file_id, column_name, fingerprint; ``stored``: upload_id, column_name, fingerprint.  Same name and content: matched; same
    name, other content: changed; of the rest, columns of equal content pair up in order of their names: renamed; what is left is
    missing or added.
    """
    pair = ["file_id", "upload_id"]
    pairs = file.select("file_id").distinct().join(
        file.select("file_id", "fingerprint").join(stored.select("upload_id", "fingerprint"), "fingerprint").select(*pair).distinct(), "file_id"
    )
    f = file.select("file_id", F.col("column_name"), F.col("fingerprint").alias("file_fp")).join(pairs, "file_id")
    s = stored.select("upload_id", F.col("column_name"), F.col("fingerprint").alias("stored_fp")).join(pairs, "upload_id")
    named = f.join(s, [*pair, "column_name"], "full")
    stable = named.where("file_fp IS NOT NULL AND stored_fp IS NOT NULL").select(
        *pair, F.when(F.col("file_fp") == F.col("stored_fp"), "matched").otherwise("changed").alias("kind"),
        F.col("column_name").alias("stored_name"), F.col("column_name").alias("file_name"),
    )
    order = lambda fp: Window.partitionBy(*pair, fp).orderBy("column_name")
    left = named.where("file_fp IS NULL").withColumn("k", F.row_number().over(order("stored_fp"))).select(
        *pair, F.col("stored_fp").alias("fp"), "k", F.col("column_name").alias("stored_name")
    )
    right = named.where("stored_fp IS NULL").withColumn("k", F.row_number().over(order("file_fp"))).select(
        *pair, F.col("file_fp").alias("fp"), "k", F.col("column_name").alias("file_name")
    )
    moved = left.join(right, [*pair, "fp", "k"], "full").select(
        *pair,
        F.when(F.col("stored_name").isNull(), "added").when(F.col("file_name").isNull(), "missing").otherwise("renamed").alias("kind"),
        F.coalesce("stored_name", F.lit("")).alias("stored_name"), F.coalesce("file_name", F.lit("")).alias("file_name"),
    )
    return stable.unionByName(moved)


def column_match_report(matches: DataFrame, file_columns: DataFrame, stored_columns: DataFrame, least: int = 2) -> DataFrame:
    """AG-23: counts per kind; alike when at least ``least`` columns and half of the larger set are matched or renamed."""
    counts = matches.groupBy("file_id", "upload_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("matched", "changed", "renamed", "missing", "added")]
    )
    sizes = counts.join(multiset(file_columns, ["file_id"]).withColumnRenamed("n", "n_file"), "file_id").join(
        multiset(stored_columns, ["upload_id"]).withColumnRenamed("n", "n_stored"), "upload_id"
    )
    hits = F.col("matched") + F.col("renamed")
    return sizes.withColumn("is_alike", (hits >= least) & (2 * hits >= F.greatest("n_file", "n_stored")))


def history(uploads: DataFrame) -> DataFrame:
    """AG-31: a dataset's files in the order of their offsets, the first created, the others appended."""
    at = Window.partitionBy("dataset_id").orderBy("row_offset", "upload_id")
    return uploads.withColumn("position", F.row_number().over(at)).withColumn("kind", F.when(F.col("position") == 1, "created").otherwise("appended"))
