"""Nulls, empty tables, repeated rows and columns with clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from voxframe.llm import dedup, encoding, history, leakage, neardup, pii, tokenizing, visual

RESPONSES = "response_key string, question_id long, response_text string, raw_text_original string, key string, text string, node long, word string, _raw string, form string"


def responses(spark, texts):
    data = [(f"1:1:{i}", 1, t, t, "k", "clash", 1, "w", "r", "f") for i, t in enumerate(texts)]
    data += [(None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data + data, RESPONSES)


OPERATORS = {
    "p1": pii.found_kinds,
    "p1 redact": lambda df: pii.redact(df.where("response_key IS NOT NULL")),
    "p3": dedup.duplicate_responses,
    "p4": neardup.near_pairs,
    "p4 groups": neardup.near_groups,
    "p5": encoding.garbled_fields,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_responses(spark, awkward, name):
    OPERATORS[name](responses(spark, awkward)).collect()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_responses(spark, name):
    assert OPERATORS[name](responses(spark, []).limit(0)).count() == 0


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, None, None, None, None)], "doc_id long, text string, k string, f string, form string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k l m n", "q"), (2, None, None), (3, "", ""), (None, "x", "")], "item_id long, text string, question_label string")


def test_awkward_documents(spark, awkward, items):
    docs = documents(spark, awkward)
    assert tokenizing.encode(docs).where("size(ids) = 0").count() == 3
    assert visual.consistent(docs).count() == len(awkward) + 1
    assert visual.look_alike_pairs(docs).count() == 0
    assert leakage.leaked_items(docs, items).count() == 0


def test_empty_documents(spark, items):
    docs = documents(spark, []).limit(0)
    for got in (tokenizing.encode(docs), visual.look_alike_pairs(docs), leakage.leaked_items(docs, items), leakage.leaked_items(documents(spark, ["a"]), items.limit(0))):
        assert got.count() == 0


def test_awkward_history(spark):
    raw = spark.createDataFrame([(1, 1, 0, None, "h"), (1, 1, 1, "no json", "h"), (1, 2, 2, "{}", "h"), (None, None, None, None, None), (1, 9, 3, '{"answer_a": null}', "h")], "dataset_id long, upload_id long, row_index long, cells string, row_hash string")
    hashes = spark.createDataFrame([(1, 0, None), (1, 1, "AB"), (1, 2, "ab"), (1, 2, "ab"), (None, None, None)], "dataset_id long, row_index long, row_hash string")
    uploads = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 9, None)], "dataset_id long, upload_id long, row_offset long")
    assert [tuple(r) for r in history.matched_rows(raw, hashes, uploads).collect()] == [(1, 2, "exact")]
    assert history.matched_rows(raw.limit(0), hashes.limit(0), uploads.limit(0)).count() == 0
    assert history.file_report(raw, hashes, uploads).count() == 4


def test_awkward_raw_rows(spark):
    raw = spark.createDataFrame([(1, 0, None), (1, 1, "x y"), (1, 2, "X-Y"), (1, 3, '{"a": "B c", "d": ""}'), (1, 4, '{"d": " ", "a": "b-C"}'), (1, 4, '{"d": " ", "a": "b-C"}'), (None, None, None)], "dataset_id long, row_index long, cells string")
    assert sorted(map(tuple, dedup.duplicate_rows(raw).collect())) == [("raw_rows", "1:1", 2), ("raw_rows", "1:3", 2)]
    assert dedup.duplicate_rows(raw.limit(0)).count() == 0
    assert dedup.duplicate_rows(raw.withColumn("_key", F.lit(1)).withColumn("_form", F.lit("x"))).count() == 2
