"""The labelling dataflow around a model call (PR-13 .. PR-17, PR-20, WN-02 .. WN-05, ML-01, ML-03, AG-20, JN-15, JN-17, TX-10, TX-21)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_in_prose, truncated, verbatim
from ..session import ship_package
from .ranking import ranked

RECORD = "struct<n:int,number:int,label_ids:array<string>,labels:array<string>,uncategorized:string,fit:int,locations:array<string>,time_context:array<string>,actionability:string,event_occurred:string>"
REPLY = f"struct<results:array<{RECORD}>>"


def representatives(corpus: DataFrame, scope: list[str], text: str, order: str) -> DataFrame:
    """WN-02: the first response of each distinct text, with the number of its copies; map-side combining absorbs copies."""
    return corpus.groupBy(*scope, text).agg(F.min_by("response_key", F.struct(order, "response_key")).alias("representative_key"), F.count(F.lit(1)).alias("copies"))


def fan_out(corpus: DataFrame, labelled: DataFrame, scope: list[str], text: str) -> DataFrame:
    """WN-03: the record of a representative on every response of its text."""
    return corpus.join(labelled, [*scope, text], "left")


def batches(rows: DataFrame, scope: list[str], order: list[str], size: int) -> DataFrame:
    """WN-04: consecutive batches of ``size`` rows per scope, with the 1-based ``position`` of a row in its batch."""
    numbered = ranked(rows, scope, order, "_rank")
    return numbered.withColumns({"batch": F.floor((F.col("_rank") - 1) / size).cast("int"), "position": ((F.col("_rank") - 1) % size + 1).cast("int")}).drop("_rank")


def chunks(rows: DataFrame, scope: list[str], key: str, n: int, seed: int) -> DataFrame:
    """WN-05: a seeded shuffle into ``n`` disjoint chunks whose sizes differ by at most one."""
    placed = ranked(rows.withColumn("_o", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256)), scope, ["_o", key], "_rank", with_size=True).drop("_o")
    # the first ``rest`` chunks have one row more
    small, rest, at = F.floor(F.col("_rank_of") / n), F.col("_rank_of") % n, F.col("_rank") - 1
    late = rest + F.floor((at - rest * (small + 1)) / F.greatest(small, F.lit(1)))
    chunk = F.when(at < rest * (small + 1), F.floor(at / (small + 1))).otherwise(late)
    return placed.withColumn("chunk", (chunk + 1).cast("int")).drop("_rank", "_rank_of")


def suffix_map(labels: DataFrame) -> DataFrame:
    """PR-15: bare number to label id, where it stands for one label only (``002`` and ``2`` are the same number)."""
    return (
        labels.select("question_id", "label_id", F.regexp_extract("label_id", r"_0*(\d+)$", 1).alias("bare")).where("bare <> ''")
        .groupBy("question_id", "bare").agg(F.min("label_id").alias("label_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    )


def parse_labels(batch: DataFrame, replies: DataFrame, labels: DataFrame) -> DataFrame:
    """PR-16: replies to records, one per row of the batch.

    ``batch``: question_id, batch, position, response_key, text; ``replies``: question_id, batch, reply; ``labels``: question_id, label_id.
    Short and long names are accepted, ids are checked against the taxonomy (bare numbers recovered), spans must stand in the text, fit
    must be 1 to 3; a row the reply leaves out is ``not_returned``, never negative.
    """
    each = replies.select("question_id", "batch", F.explode(json_in_prose(F.col("reply"), REPLY)["results"]).alias("r"))
    r = F.col("r")
    truth = lambda c: F.coalesce(F.lower(c).isin("true", "yes", "1"), F.lit(False))
    records = each.select(
        "question_id", "batch", F.coalesce(r["n"], r["number"]).alias("position"), F.coalesce(r["label_ids"], r["labels"], F.array().cast("array<string>")).alias("ids"),
        truth(r["uncategorized"]).alias("uncategorized"), F.when(r["fit"].between(1, 3), r["fit"]).alias("fit"), r["locations"].alias("locations"), r["time_context"].alias("time_context"),
        F.when(r["actionability"].isin("specific", "general"), r["actionability"]).alias("actionability"), truth(r["event_occurred"]).alias("event_occurred"),
    ).dropDuplicates(["question_id", "batch", "position"])
    ids = records.select("question_id", "batch", "position", F.posexplode("ids").alias("at", "id"))
    exact = ids.join(labels.select("question_id", F.col("label_id").alias("id"), F.col("label_id").alias("exact")), ["question_id", "id"], "left")
    bare = suffix_map(labels).withColumnRenamed("label_id", "recovered")
    known = exact.withColumn("bare", F.regexp_extract("id", r"^(?:.*_)?0*(\d+)$", 1)).join(bare, ["question_id", "bare"], "left")
    resolved = F.coalesce("exact", F.when(~F.col("id").contains("_"), F.col("recovered")))
    valid = known.groupBy("question_id", "batch", "position").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(resolved.isNotNull(), F.struct("at", resolved.alias("l"))))), lambda s: s["l"])).alias("label_ids"),
        F.count_if(resolved.isNull()).alias("n_invalid"),
    )
    whole = records.drop("ids").join(valid, ["question_id", "batch", "position"], "left")
    out = batch.join(whole, ["question_id", "batch", "position"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "question_id", "batch", "position", "response_key", F.coalesce("label_ids", none).alias("label_ids"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), "fit", "actionability",
        F.coalesce("event_occurred", F.lit(False)).alias("event_occurred"), F.coalesce("uncategorized", F.lit(False)).alias("uncategorized"),
        verbatim(F.coalesce("locations", none), F.col("text")).alias("locations"), verbatim(F.coalesce("time_context", none), F.col("text")).alias("time_context"), F.col("uncategorized").isNull().alias("not_returned"),
    )


def run_batches(rows: DataFrame, scope: list[str], prompt: Callable[[pd.DataFrame], tuple[str, str]], client: object, retries: int = 1) -> DataFrame:
    """ML-01, ML-03: one model call per batch, on the executors; a failing call is retried, and a batch that keeps failing is disclosed.

    ``client`` has ``complete(system, user) -> str`` and is shipped to the workers.  Rows are grouped by scope and batch, and batches are of
    bounded size.
    """
    ship_package(rows.sparkSession)
    keys = [*scope, "batch"]
    kinds = dict(rows.dtypes)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        system, user = prompt(pdf)
        reply, failure = None, ""
        for _ in range(retries + 1):
            try:
                reply = client.complete(system, user)
                break
            except Exception as e:  # contained: one batch must not fail the run
                failure = f"{type(e).__name__}: {e}"[:160]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "reply": [reply], "batch_failed": [reply is None], "failure": [failure if reply is None else ""]})

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["reply string", "batch_failed boolean", "failure string"])
    return rows.groupBy(*keys).applyInPandas(call, schema)


def overlay(prior: DataFrame, fresh: DataFrame, key: str = "response_key") -> DataFrame:
    """JN-15, SE-06: fresh records replace prior ones of the same key; the rest of both is kept."""
    kept = prior.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def never_labelled(corpus: DataFrame, assignments: DataFrame) -> DataFrame:
    """JN-04, ST-03: responses without a record."""
    return corpus.join(assignments.select("response_key"), "response_key", "left_anti")


def carry_forward(prior: DataFrame, redone: DataFrame, fresh: DataFrame, key: str = "label_id") -> DataFrame:
    """JN-17: what a new run did not redo stays as it was."""
    return prior.join(redone.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def sub_report(sub: DataFrame) -> DataFrame:
    """AG-20: per category the members with and without a sub-theme, and the gap (no sub-theme and hardly a fit)."""
    has = F.size("sub_ids") > 0
    return sub.groupBy("label_id").agg(
        F.count_if(~F.col("not_returned")).alias("coded"), F.count_if(~F.col("not_returned") & ~has).alias("generic"), F.count_if(~has & (F.col("fit") == 1)).alias("gap"), F.count_if(F.col("not_returned")).alias("not_returned")
    )


def member_rows(members: DataFrame, corpus: DataFrame, text: str = "response_text", limit: int = 600) -> DataFrame:
    """TX-21: the texts of a category's members; members without a text are skipped."""
    texts = corpus.where(F.col(text).isNotNull()).select("response_key", truncated(F.col(text), limit).alias("text"))
    return members.join(texts, "response_key")


class EchoClient:
    """A deterministic stand-in for a model: replies are made from the prompt by a function."""

    def __init__(self, reply: Callable[[str, str], str]):
        self.reply = reply

    def complete(self, system: str, user: str) -> str:
        return self.reply(system, user)


def in_order(parts: Iterator[tuple[int, str]]) -> list[str]:
    """Replies in the order of their batches, whatever order they came in."""
    return [r for _, r in sorted(parts)]
