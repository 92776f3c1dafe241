"""The pN_ queries of the training-text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, encoding, history, leakage, neardup, pii, tokenizing, visual
from .common import table

_TEXTS = ("response_key", "response_text", "raw_text_original")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_kinds(table(spark, d, "responses", *_TEXTS))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "responses", *_TEXTS))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    answers = dedup.duplicate_responses(table(spark, d, "responses", "response_key", "question_id", "response_text"))
    return answers.unionByName(dedup.duplicate_rows(table(spark, d, "raw_rows", "dataset_id", "row_index", "cells")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "responses", "response_key", "question_id", "response_text"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(spark, d, "responses", "response_key", "question_id", "response_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, d, "responses", *_TEXTS))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "responses", *_TEXTS), "response_key", _TEXTS[1:]).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.matched_rows(*_history(spark, d))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return history.file_report(*_history(spark, d))


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, d, "raw_rows", "dataset_id", "upload_id", "row_index", "cells"),
        table(spark, d, "row_hashes", "dataset_id", "row_index", "row_hash"),
        table(spark, d, "uploads", "dataset_id", "upload_id", "row_offset"),
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.scan(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))
    return found.select("doc_id", F.array_join("items", ",").alias("item_ids"), "leaked_chars", "clean_text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alike_pairs(table(spark, d, "documents", "doc_id", "text"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alike_classes(table(spark, d, "documents", "doc_id", "text"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual.consistent(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_redacted, p3_found, p4_found, p4_groups, p5_found, p5_restored, p6_found, p6_files,
            p7_ids, p8_found, p8_clean, p9_found, p9_classes, p9_forms,
        )
    }
