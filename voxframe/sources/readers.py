"""Scans (SC-01 .. SC-13)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canonical_key, corpus_fingerprint
from ..operators.estimate import newest_runs

SUFFIXES = (".csv", ".xlsx", ".xls")

CORPUS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("dataset_id", "question_id")]
    + [T.StructField(n, T.StringType()) for n in ("question_label", "source_column")]
    + [T.StructField("source_row_index", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("response_key", "respondent_key", "respondent_id", "response_text", "raw_text_original")]
    + [T.StructField(n, T.BooleanType()) for n in ("was_encoding_repaired", "is_nonanswer")]
    + [T.StructField("label_ids", T.ArrayType(T.StringType())), T.StructField("uncategorized", T.BooleanType()), T.StructField("fit", T.LongType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("locations", "time_context")]
    + [T.StructField("actionability", T.StringType()), T.StructField("event_occurred", T.BooleanType()), T.StructField("response_date", T.StringType())]
)


def check_upload(path: str) -> str:
    """SC-03: the suffix of an acceptable, non-empty file."""
    suffix = Path(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"{suffix or 'no suffix'}: expected one of {', '.join(SUFFIXES)}")
    if os.path.exists(path) and os.path.isfile(path) and os.path.getsize(path) == 0:
        raise ValueError(f"{path} is empty")
    return suffix


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SC-01: every cell a string, blank cells blank (not null), line breaks inside quotes kept.

    A file whose cells hold line breaks can only be read by one task; without ``multiline`` a large file is split over many.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"', encoding="UTF-8", nullValue="\x00", emptyValue="")
    names = [c.lstrip("﻿") for c in df.columns]
    return df.toDF(*names).na.fill("")


def read_wide(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SC-01, SC-02: a wide file by its suffix."""
    if check_upload(path) == ".csv":
        return read_csv(spark, path, multiline)
    from .excel import read_excel

    return read_excel(spark, path)


def read_corpus(spark: SparkSession, path: str, question_ids: list[int] | None = None) -> DataFrame:
    """SC-04, SC-05: many questions in one scan; the filter reaches the Parquet reader."""
    df = spark.read.parquet(path)
    if question_ids is not None:
        df = df.where(F.col("question_id").isin(*question_ids))
    if "response_key" not in df.columns:
        df = df.withColumn("response_key", F.concat_ws(":", "dataset_id", "question_id", "source_row_index"))
    return df


def newest_export(paths: list[str]) -> str:
    """SC-07: the most recently written export; ties by name."""
    there = [p for p in paths if os.path.exists(p)]
    if not there:
        raise FileNotFoundError("no export found")
    return max(there, key=lambda p: (os.path.getmtime(p), p))


def dataset_export(root: str, dataset_id: int) -> str:
    """SC-08: the export of one dataset, never that of another."""
    path = Path(root) / str(dataset_id) / "responses.parquet"
    if not path.exists():
        raise FileNotFoundError(f"dataset {dataset_id} has no export at {path}")
    return os.fspath(path)


def latest_run(runs: DataFrame, scope: list[str]) -> DataFrame:
    """SC-09, SC-11: the lexicographically last run of each scope."""
    return newest_runs(runs, scope)


def taxonomy_run(label_runs: DataFrame, taxonomy_runs: DataFrame) -> DataFrame:
    """SC-10: the taxonomy a label run goes with: the same run, else the run its manifest names, else the latest; ``how`` says which."""
    scope = ["dataset_id", "question_id"]
    t = taxonomy_runs.select(*scope, F.col("run_id").alias("t_run"))
    same = label_runs.join(t.withColumnRenamed("t_run", "run_id").withColumn("same", F.col("run_id")), [*scope, "run_id"], "left")
    named = same.join(t.select(*scope, F.col("t_run").alias("manifest_run"), F.col("t_run").alias("named")), [*scope, "manifest_run"], "left")
    last = named.join(t.groupBy(*scope).agg(F.max("t_run").alias("last")), scope, "left")
    how = F.when(F.col("same").isNotNull(), "same run").when(F.col("named").isNotNull(), "manifest").when(F.col("last").isNotNull(), "latest").otherwise("none")
    return last.select(*scope, "run_id", F.coalesce("same", "named", "last").alias("taxonomy_run"), how.alias("how"))


def sub_members(sub_assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """SC-12: response, category and sub-theme of decomposed categories: map exploded, then array."""
    ok = categories.where("outcome = 'ok'").select("label_id")
    per = sub_assignments.select("response_key", F.explode("subs").alias("label_id", "subs")).join(ok, "label_id", "left_semi")
    return per.select("response_key", "label_id", F.explode("subs").alias("sub_id"))


def cached_matches(spark: SparkSession, path: str, corpus: DataFrame, key: str, text: str, version: str, concepts: dict[str, list[str]], build) -> tuple[DataFrame, bool]:
    """SC-13: a stored result is reused only while version, corpus, concepts and the names in it are the ones it was made from; anything else is a miss.

    The place carries the fingerprints of corpus and concepts; a result that holds a name no concept has is made anew.
    """
    print_ = "-".join(str(v) for v in corpus_fingerprint(corpus, key, text).first())
    sweep = canonical_key([[name, sorted(terms)] for name, terms in sorted(concepts.items())])
    place = f"{path.rstrip('/')}/{version}-{sweep}-{print_}"
    try:
        stored = spark.read.parquet(place)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        if stored.where(~F.col("concept").isin(*concepts)).isEmpty():
            return stored, True
    build(corpus).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place), False
