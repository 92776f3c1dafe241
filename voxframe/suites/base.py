"""The canonical frames over the test tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import latest

CORPUS_COLUMNS = (
    "dataset_id", "question_id", "question_label", "source_column", "source_row_index", "response_key", "respondent_key", "respondent_id", "response_text", "raw_text_original",
    "was_encoding_repaired", "is_nonanswer", "label_ids", "uncategorized", "fit", "locations", "time_context", "actionability", "event_occurred", "response_date", "upload_id", "loaded_at",
)


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def corpus(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Responses, each key once (its latest delivery), only the columns asked for."""
    wanted = dict.fromkeys(["response_key", *(columns or CORPUS_COLUMNS), "loaded_at"])
    return latest(read(spark, d, "responses", *wanted), ["response_key"], "loaded_at")


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """Respondents' attributes, trimmed, repeated rows once."""
    return read(spark, d, "respondents", "respondent_key", "source_row_index", "field", F.trim("value").alias("value")).where("value <> ''").distinct()


#: The same frames for DuckDB.
C = "c AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY response_key ORDER BY loaded_at DESC) = 1)"
M = "m AS (SELECT DISTINCT dataset_id, question_id, response_key, unnest(label_ids) AS label_id FROM c)"
A = "a AS (SELECT DISTINCT respondent_key, source_row_index, field, trim(value) AS value FROM respondents WHERE trim(value) <> '')"
T = """t AS (SELECT question_id, question_id || '_' || lpad(CAST(n AS VARCHAR), 3, '0') AS label_id, question_id || '_P' || lpad(CAST((n - 1) // 5 AS VARCHAR), 2, '0') AS parent_id
     FROM (SELECT question_id, unnest(range(1, max(CAST(split_part(label_id, '_', 2) AS INT)) + 2)) AS n FROM m GROUP BY question_id))"""
