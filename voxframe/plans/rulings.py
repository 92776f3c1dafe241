"""Rulings on whether two categories mean the same (JN-12, AG-35, SE-07, TX-18, TX-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import definition_hash, pair_key
from ..functions.text import json_in_prose

VERDICTS = ("same", "broader", "distinct")
_REPLY = "struct<rulings:array<struct<pair:int,verdict:string,why:string>>>"


def keyed(pairs: DataFrame, definitions: DataFrame, salt: str = "") -> DataFrame:
    """SF-04: pairs with the key of their definitions, so that a ruling lapses when a definition changes."""
    d = definitions.select("label_id", definition_hash(F.col("name"), F.col("description"), F.col("include"), F.col("exclude")).alias("h"))
    side = lambda s: d.select(F.col("label_id").alias(f"label_{s}"), F.col("h").alias(f"h_{s}"))
    tagged = lambda s: F.concat_ws("=", f"label_{s}", f"h_{s}")
    return pairs.join(side("a"), "label_a").join(side("b"), "label_b").withColumn("pair_key", pair_key(tagged("a"), tagged("b"), F.lit(salt)))


def parse(replies: DataFrame, pairs: DataFrame) -> DataFrame:
    """TX-19: the first ruling per pair with a known verdict; a pair nobody ruled on stays absent."""
    each = replies.select("batch", F.posexplode(json_in_prose(F.col("reply"), _REPLY)["rulings"]).alias("at", "r"))
    ok = each.select("batch", "at", F.col("r.pair").alias("number"), F.lower(F.trim("r.verdict")).alias("verdict"), F.substring("r.why", 1, 160).alias("why")).where(F.col("verdict").isin(*VERDICTS))
    first = ok.groupBy("batch", "number").agg(F.min_by(F.struct("verdict", "why"), "at").alias("r"))
    return pairs.join(first, ["batch", "number"]).select("pair_key", "r.verdict", "r.why")


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """SE-07: fresh rulings replace stored ones, an analyst's override survives, and stored ones nobody renewed become history."""
    a = stored.select("pair_key", F.struct("verdict", "override").alias("old"))
    b = fresh.select("pair_key", F.col("verdict").alias("new"))
    return a.join(b, "pair_key", "full").select(
        "pair_key", F.coalesce("new", "old.verdict").alias("verdict"), F.col("old.override").alias("override"), F.coalesce("old.override", "new", "old.verdict").alias("effective"), F.col("new").isNull().alias("is_history")
    )


def report(rulings: DataFrame) -> DataFrame:
    """AG-35."""
    return rulings.groupBy("species").pivot("verdict", list(VERDICTS)).count().na.fill(0)


def stale(rulings: DataFrame, counts: DataFrame, percent: int = 50) -> DataFrame:
    """TX-18: rulings one of whose categories has grown or shrunk by ``percent`` hundredths since."""
    side = lambda s: counts.select(F.col("label_id").alias(f"label_{s}"), F.col("n").alias(f"now_{s}"))
    both = rulings.join(side("a"), "label_a", "left").join(side("b"), "label_b", "left").na.fill(0, ["now_a", "now_b"])
    drift = lambda s: 100 * F.abs(F.col(f"now_{s}") - F.col(f"n_{s}")) >= percent * F.greatest(F.col(f"n_{s}"), F.lit(1))
    return both.where(drift("a") | drift("b"))
