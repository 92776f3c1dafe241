"""Sinks (SK-01 .. SK-08)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Files
from .readers import CORPUS


def export_frame(corpus: DataFrame) -> DataFrame:
    """SK-01: the fixed columns and types of an export; what the corpus lacks is null."""
    return corpus.select(*[(F.col(f.name) if f.name in corpus.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CORPUS])


def write_export(corpus: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SK-01: replaces the export."""
    writer = export_frame(corpus).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sidecar_frame(attributes: DataFrame) -> DataFrame:
    """SK-02: attributes in order of row and field, blanks left out."""
    return attributes.where(F.trim("value") != "").select("respondent_key", "source_row_index", "field", "value").orderBy("source_row_index", "field", "respondent_key")


def csv_frame(corpus: DataFrame) -> DataFrame:
    """SK-03: lists as JSON, a missing list as an empty cell."""
    return export_frame(corpus).select(
        *[F.coalesce(F.to_json(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in CORPUS]
    )


def write_csv(corpus: DataFrame, path: str) -> None:
    """SK-03: CSV parts with a header and quotes doubled."""
    csv_frame(corpus).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def add_bom(path: str) -> None:
    """SK-03: the byte order mark some spreadsheet programs need, in front of every part."""
    for part in Path(path).glob("part-*.csv"):
        data = part.read_bytes()
        if not data.startswith(b"\xef\xbb\xbf"):
            part.write_bytes(b"\xef\xbb\xbf" + data)


def manifest(corpus: DataFrame) -> DataFrame:
    """SK-04: per question rows, non-answers, repairs and labelled rows."""
    return corpus.groupBy("dataset_id", "question_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce("is_nonanswer", F.lit(False))).alias("n_nonanswers"),
        F.count_if(F.coalesce("was_encoding_repaired", F.lit(False))).alias("n_repaired"), F.count_if(F.col("uncategorized").isNotNull()).alias("n_labelled"),
    )


def unmatched_keys(assignments: DataFrame, corpus: DataFrame) -> DataFrame:
    """SK-04, JN-05: records whose response is not in the corpus."""
    return assignments.select("response_key").distinct().join(corpus.select("response_key"), "response_key", "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))


def append_run(records: DataFrame, path: str, dataset_id: int, question_id: int, run_id: str) -> None:
    """SK-06: a run beside the earlier ones, never over them."""
    stamped = records.withColumns({"dataset_id": F.lit(dataset_id), "question_id": F.lit(question_id), "run_id": F.lit(run_id)})
    stamped.write.mode("append").partitionBy("dataset_id", "question_id", "run_id").parquet(path)


def append_runs(records: DataFrame, path: str, run_id: str) -> None:
    """SK-06 for records of many questions at once: a run beside the earlier ones, in folders by run and question."""
    records.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "question_id").parquet(path)


def answer_artifacts(files: Files, place: str, answer: str, manifest: dict) -> None:
    """SK-07: the text of an answer, and beside it what it was made from (route, counts, quotes, checks), for whoever audits it."""
    files.write_text(answer, f"{place.rstrip('/')}/answer.md")
    files.write_json(manifest, f"{place.rstrip('/')}/manifest.json")


def checkpoint_candidates(candidates: DataFrame, path: str) -> DataFrame:
    """SK-08: an induction's candidates, so that a broken run resumes after its expensive stage."""
    candidates.write.mode("overwrite").parquet(path)
    return candidates.sparkSession.read.parquet(path)
