"""Wide files into long rows, previews, ownership and upserts (PR-01 .. PR-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.encoding import with_repair
from ..functions.text import stripped


def unpivot_answers(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """PR-01: one row per non-blank cell of the given columns: ids, source_column, raw_text."""
    long = wide.select(*ids, *[F.col(c).cast("string") for c in columns]).unpivot(ids, columns, "source_column", "raw_text")
    return long.where(F.col("raw_text").isNotNull() & (stripped(F.col("raw_text")) != ""))


def with_global_index(rows: DataFrame, uploads: DataFrame, local: str = "row_index") -> DataFrame:
    """PR-02: the index of a row in its dataset, from the offset of its file."""
    offsets = uploads.select("dataset_id", "upload_id", "row_offset")
    return rows.join(offsets, ["dataset_id", "upload_id"]).withColumn("source_row_index", F.col(local) + F.col("row_offset"))


def owned(rows: DataFrame, row_hashes: DataFrame) -> DataFrame:
    """PR-02: rows whose hash is known not to be a duplicate; unchecked rows are not owned yet."""
    mine = row_hashes.where("NOT is_duplicate").select("dataset_id", "row_index").distinct()
    return rows.join(mine, ["dataset_id", "row_index"], "left_semi")


def unpivot_attributes(wide: DataFrame, ids: list[str], columns: list[str], date_columns: tuple[str, ...] = ()) -> DataFrame:
    """PR-04: one row per attribute that says something: ids, field, value, wrongly decoded values repaired; days as ISO text.

    A column the file lacks is skipped; a date that cannot be read is missing.
    """
    there = [c for c in columns if c in wide.columns]
    shaped = [
        (parse_date(F.col(c).cast("string")).cast("string") if c in date_columns else stripped(F.col(c).cast("string"))).alias(c) for c in there
    ]
    said = wide.select(*ids, *shaped).unpivot(ids, there, "field", "value").where("value <> ''")
    return with_repair(said, "value").drop("was_repaired")


def column_preview(long: DataFrame, by: list[str], order: str, value: str, head: int = 5) -> DataFrame:
    """PR-07: per column the number of non-blank cells and its non-blank cells among the first ``head`` rows."""
    said = stripped(F.col(value)) != ""
    sample = F.array_sort(F.collect_list(F.when(said & (F.col(order) < head), F.struct(order, value))))
    return long.groupBy(*by).agg(
        F.count_if(said).alias("n_filled"), F.array_join(F.transform(sample, lambda s: s[value]), "|").alias("sample")
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], value: str, scope: str | None = None) -> DataFrame:
    """PR-09: ``action`` per key: insert, update, keep, or delete (stored rows missing from the incoming scope)."""
    a = stored.select(*key, F.col(value).alias("was"), F.lit(True).alias("old"), *([F.col(scope).alias("old_scope")] if scope else []))
    b = incoming.select(*key, F.col(value).alias("now"), F.lit(True).alias("new"))
    both = a.join(b, key, "full")
    if scope:
        covered = incoming.select(F.col(scope).alias("old_scope")).distinct().withColumn("covered", F.lit(True))
        both = both.join(covered, "old_scope", "left")
    gone = F.col("covered").isNotNull() if scope else F.lit(True)
    return both.select(
        *key,
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), F.when(gone, "delete").otherwise("keep"))
        .when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("update").alias("action"),
        F.coalesce("now", "was").alias(value),
    )


def check_selection(columns: list[str], questions: list[str], metadata: list[str], filled: dict[str, int]) -> None:
    """PR-08: a column selection is refused when a column is missing, chosen twice or blank in all files."""
    missing = [c for c in [*questions, *metadata] if c not in columns]
    if missing:
        raise ValueError(f"columns not in the file: {', '.join(missing)}")
    both = sorted(set(questions) & set(metadata))
    if both:
        raise ValueError(f"columns chosen as question and as attribute: {', '.join(both)}")
    blank = [c for c in questions if not filled.get(c)]
    if blank:
        raise ValueError(f"columns without an answer: {', '.join(blank)}")
    if not questions:
        raise ValueError("no question chosen")
