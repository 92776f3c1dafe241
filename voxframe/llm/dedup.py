"""P3: duplicates hidden by formatting differences.

Three hash aggregations, each with map-side combining, so a text or row that makes up a third of the table
reaches the shuffle once per map task:

1. deliveries of one key collapse (``distinct`` over key and raw value);
2. byte-identical raw values collapse with their number of copies and their first key;
3. only the distinct survivors are put in canonical form, and those are grouped again on the full
   canonical value, summing the copies.

Defined cases: a null value has no group; a value whose canonical form is empty has none either; a delivery of
a key with another value counts as another version of it; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed


def collapse(df: DataFrame, scope: list[str], key: Column, raw: str, canonical) -> DataFrame:
    """Groups of ``raw`` values with equal ``canonical`` form within ``scope``: first key and copies.

    ``key`` is a struct or scalar whose smallest value names the group; ``canonical`` turns a raw column into
    its canonical column, null where the value takes no part.
    """
    keyed = df.where(F.col(raw).isNotNull()).select(*scope, key.alias("_key"), F.col(raw).alias("_raw")).distinct()
    identical = keyed.groupBy(*scope, "_raw").agg(F.min("_key").alias("_key"), F.count(F.lit(1)).alias("_n"))
    formed = identical.select(*scope, "_key", "_n", canonical(F.col("_raw")).alias("_form"))
    return (
        formed.where(F.col("_form").isNotNull())
        .groupBy(*scope, "_form")
        .agg(F.min("_key").alias("first_key"), F.sum("_n").cast("long").alias("copies"))
    )


def canonical_text(raw: Column) -> Column:
    """Squeezed text; null when nothing is left."""
    return F.nullif(squeezed(raw), F.lit(""))


def canonical_cells(cells: Column) -> Column:
    """Squeezed cells of a JSON object under their names, in the order of names; blank cells do not count.

    A string that is no JSON object is compared as a squeezed text.
    """
    entries = F.map_entries(F.from_json(cells, "map<string,string>"))
    pairs = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), squeezed(e["value"]).alias("cell")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["cell"] != ""))
    return F.coalesce(F.nullif(F.to_json(kept), F.lit("[]")), F.when(entries.isNull(), canonical_text(cells)))


def duplicate_responses(responses: DataFrame) -> DataFrame:
    """Groups of two or more responses to one question with the same squeezed text."""
    return (
        collapse(responses, ["question_id"], F.col("response_key"), "response_text", canonical_text)
        .where("copies >= 2")
        .select(F.lit("responses").alias("record_kind"), "first_key", "copies")
    )


def duplicate_rows(raw_rows: DataFrame) -> DataFrame:
    """Groups of two or more raw rows of one dataset with the same squeezed cell under each name."""
    return (
        collapse(raw_rows, ["dataset_id"], F.col("row_index"), "cells", canonical_cells)
        .where("copies >= 2")
        .select(F.lit("raw_rows").alias("record_kind"), F.concat_ws(":", "dataset_id", "first_key").alias("first_key"), "copies")
    )
