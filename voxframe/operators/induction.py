"""Inducing categories from responses, and labelling what is new (ML-01, ML-03, ML-04, TX-09, TX-10)."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_in_prose, truncated
from ..session import shared_table
from .filters import is_uncovered
from .labeling import fan_out, parse_labels, representatives, run_batches
from .ranking import ranked
from .taxonomy import assemble, extend, merge_by_name

#: Responses a model sees at once, characters it sees of each, evidence a candidate keeps.
CHUNK, SHOWN, EVIDENCE = 120, 500, 10
_CANDIDATES = "struct<candidates:array<struct<name:string,description:string,include:array<string>,exclude:array<string>,evidence:array<int>>>>"


class NothingInduced(RuntimeError):
    """Every chunk failed: there is no taxonomy to build."""


def seeded_chunks(rows: DataFrame, scope: list[str], size: int = CHUNK, seed: int = 7, key: str = "response_key") -> DataFrame:
    """WN-05: a seeded shuffle cut into chunks of at most ``size`` rows whose sizes differ by at most one: ``batch`` and ``position`` from 1."""
    placed = ranked(rows.withColumn("_o", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256)), scope, ["_o", key], "_rank", with_size=True).drop("_o")
    n, at = F.ceil(F.col("_rank_of") / size), F.col("_rank") - 1
    # dealt out in turn, so that every chunk is a draw of its own
    return placed.withColumns({"batch": (at % n).cast("int"), "position": (F.floor(at / n) + 1).cast("int")}).drop("_rank", "_rank_of")


def _lines(pdf: pd.DataFrame) -> str:
    return "\n".join(f"{n}\t{' '.join(str(t).split())}" for n, t in zip(pdf["position"], pdf["text"]))


@dataclass
class Induced:
    """Candidates of all chunks with their evidence, and what became of each chunk."""

    candidates: DataFrame
    report: DataFrame


def map_candidates(rows: DataFrame, scope: list[str], client: object, size: int = CHUNK, seed: int = 7, system: str = "Propose categories.") -> Induced:
    """ML-01: one call per chunk of responses proposes categories; numbers it cites become responses, invented ones are counted and go.

    A chunk that fails is asked once more and then left out, disclosed in ``report``; only if all fail is it an error.  Replies are kept in a shared
    table, so what was paid for is not asked again.  ``rows``: the scope, response_key, text.
    """
    shown = seeded_chunks(rows.where(F.col("text").isNotNull()), scope, size, seed).withColumn("text", truncated(F.col("text"), SHOWN))
    shown = shared_table(shown)
    # a reply that is no JSON object is asked for again, as a failing call is
    replies = shared_table(run_batches(shown, scope, lambda pdf: (system, _lines(pdf)), JsonOnly(client)))
    each = replies.where("NOT batch_failed").select(*scope, "batch", F.posexplode(json_in_prose(F.col("reply"), _CANDIDATES)["candidates"]).alias("at", "c"))
    named = each.where(F.trim("c.name") != "").select(*scope, "batch", "at", F.trim("c.name").alias("name"), F.coalesce("c.description", F.lit("")).alias("description"), F.coalesce("c.include", F.array().cast("array<string>")).alias("include"), "c.evidence")
    cited = named.select(*scope, "batch", "at", F.posexplode(F.array_distinct("evidence")).alias("i", "position"))
    there = cited.join(shown.select(*scope, "batch", "position", "response_key"), [*scope, "batch", "position"], "left")
    known = F.array_sort(F.collect_list(F.when(F.col("response_key").isNotNull(), F.struct("i", "response_key"))))
    evidence = there.groupBy(*scope, "batch", "at").agg(F.slice(F.transform(known, lambda s: s["response_key"]), 1, EVIDENCE).alias("evidence"), F.count_if(F.col("response_key").isNull()).alias("n_invalid"))
    found = named.drop("evidence").join(evidence, [*scope, "batch", "at"], "left").withColumn("n_invalid", F.coalesce("n_invalid", F.lit(0)))
    found = shared_table(found.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))))
    per = found.groupBy(*scope, "batch").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("n_invalid").alias("n_invalid"))
    sizes = shown.groupBy(*scope, "batch").agg(F.count(F.lit(1)).alias("n_responses"), F.count_if(F.col("text").endswith("…")).alias("n_truncated"))
    report = sizes.join(replies.select(*scope, "batch", "batch_failed", "failure"), [*scope, "batch"], "left").join(per, [*scope, "batch"], "left").na.fill(0, ["n_candidates", "n_invalid"])
    report = shared_table(report)
    state = report.agg(F.count(F.lit(1)).alias("n"), F.count_if("batch_failed").alias("failed"), F.first("failure", ignorenulls=True).alias("failure")).first()
    if state.n and state.n == state.failed:
        raise NothingInduced(f"all {state.n} chunks failed, the first with: {state.failure}")
    return Induced(found, report)


class JsonOnly:
    """A client whose replies hold a JSON object, or raise."""

    def __init__(self, inner: object):
        self.inner = inner

    def complete(self, system: str, user: str) -> str:
        reply = self.inner.complete(system, user)
        json.loads(reply[reply.find("{") : reply.rfind("}") + 1] or "null")
        if "{" not in reply:
            raise ValueError("no JSON object in the reply")
        return reply


def induce(rows: DataFrame, client: object, scope: str = "question_id", size: int = CHUNK, seed: int = 7) -> tuple[DataFrame, Induced]:
    """Candidates merged by name into a first taxonomy per question: support is the number of chunks that propose a label (AG-33, AG-34, TX-06)."""
    induced = map_candidates(rows, [scope], client, size, seed)
    ordered = induced.candidates.withColumn("position", F.struct("batch", "at"))
    merged = merge_by_name(ordered, [scope]).withColumnRenamed("n_chunks", "chunk_support")
    chunks = induced.report.groupBy(scope).agg(F.count(F.lit(1)).alias("chunks"))
    return assemble(merged.withColumnRenamed(scope, "question_id").join(chunks.withColumnRenamed(scope, "question_id"), "question_id"), F.col("chunks")), induced


def label_run(rows: DataFrame, labels: DataFrame, client: object, scope: str = "question_id", size: int = 60, system: str = "label") -> DataFrame:
    """ML-03, ML-04: every distinct text of ``rows`` (scope, response_key, text) is labelled once, in batches, and its record goes to all its responses.

    A batch that fails is asked again by itself after the others are done (one serial sweep); what fails then is flagged ``batch_failed``.  A
    row the reply leaves out is ``not_returned``.  ``labels``: the scope as question_id, label_id.
    """
    rows = rows.where(F.col("text").isNotNull())
    reps = shared_table(representatives(rows, [scope], "text", "response_key"))
    numbered = ranked(reps, [scope], ["representative_key"], "_rank")
    batch = numbered.select(F.col(scope).alias("question_id"), F.floor((F.col("_rank") - 1) / size).cast("int").alias("batch"), ((F.col("_rank") - 1) % size + 1).cast("int").alias("position"), F.col("representative_key").alias("response_key"), "text")
    batch = shared_table(batch)
    ask = lambda part, tries: shared_table(run_batches(part, ["question_id"], lambda pdf: (system, _lines(pdf)), JsonOnly(client), retries=tries))
    first = ask(batch, 1)
    failed = first.where("batch_failed").select("question_id", "batch")
    # the sweep runs in one task on purpose: a service that was overrun gets one call at a time
    again = ask(batch.join(failed, ["question_id", "batch"], "left_semi").coalesce(1), 0)
    replies = first.where("NOT batch_failed").unionByName(again)
    records = parse_labels(batch, replies.where("NOT batch_failed").select("question_id", "batch", "reply"), labels)
    lost = again.where("batch_failed").select("question_id", "batch", F.lit(True).alias("batch_failed"))
    records = records.join(lost, ["question_id", "batch"], "left").withColumn("batch_failed", F.coalesce("batch_failed", F.lit(False)))
    # a response can stand for its text in several scopes
    records = records.drop("batch", "position").withColumnsRenamed({"question_id": scope, "response_key": "representative_key"})
    done = reps.select(scope, "text", "representative_key").join(records, [scope, "representative_key"])
    return fan_out(rows.select(scope, "response_key", "text"), done.drop("representative_key"), [scope], "text").drop("text")


@dataclass
class Incremental:
    taxonomy: DataFrame
    records: DataFrame
    n_new: int
    n_pool: int
    outcome: str


def run_incremental(rows: DataFrame, taxonomy: DataFrame, prior: DataFrame, client: object, propose: object | None = None, least_pool: int = 20, size: int = 60) -> Incremental:
    """TX-10: label what has no record, gather what no category covers, propose categories for that, label it again, lay all of it over the prior records.

    Prior records are never touched.  A pool below ``least_pool``, a failing proposal and one without a new name leave the pool uncategorised, and ``outcome`` says so.
    ``rows``: question_id, response_key, text; ``taxonomy``: question_id, label_id, parent_id, name; ``prior``: question_id, response_key, label_ids,
    uncategorized, fit.
    """
    columns = ["question_id", "response_key", "label_ids", "uncategorized", "fit"]
    fresh = shared_table(rows.join(prior.select("response_key"), "response_key", "left_anti"))
    n_new = fresh.count()
    if not n_new:
        raise ValueError("every response has a record already")
    first = shared_table(label_run(fresh, taxonomy.select("question_id", "label_id"), client, size=size))
    open_ = is_uncovered(F.col("uncategorized"), F.col("fit")) & ~F.col("not_returned") & ~F.col("batch_failed")
    pool = shared_table(fresh.join(first.where(open_).select("response_key"), "response_key", "left_semi"))
    n_pool = pool.count()
    labelled = first.select(*columns, F.lit("labelled").alias("how"))
    whole = lambda part, tax, outcome: Incremental(tax, prior.select(*columns, F.lit("kept").alias("how")).unionByName(part), n_new, n_pool, outcome)
    if n_pool < least_pool:
        return whole(labelled, taxonomy, f"skipped: a pool of {n_pool} is below {least_pool}")
    try:
        induced = map_candidates(pool, ["question_id"], propose or client)
    except NothingInduced as e:
        return whole(labelled, taxonomy, f"failed: {e}")
    proposed = merge_by_name(induced.candidates.withColumn("position", F.struct("batch", "at")), ["question_id"])
    new = shared_table(extend(taxonomy, proposed.select("question_id", "name", "position")))
    if new.isEmpty():
        return whole(labelled, taxonomy, "no new category: the pool stays uncategorised")
    wider = taxonomy.select("question_id", "label_id", "parent_id", "name").unionByName(new.select("question_id", "label_id", F.lit(None).cast("string").alias("parent_id"), "name"))
    again = label_run(pool, wider.select("question_id", "label_id"), client, size=size).select(*columns, F.lit("relabelled").alias("how"))
    again = shared_table(again)
    kept = labelled.join(again.select("response_key"), "response_key", "left_anti").select(labelled.columns)
    return whole(kept.unionByName(again), wider, "extended")


def sub_label(members: DataFrame, sub_labels: DataFrame, client: object, size: int = 60) -> DataFrame:
    """ML-04: the members of each category (label_id, response_key, text) labelled with its sub-themes (label_id, sub_id)."""
    known = sub_labels.select(F.col("label_id").alias("question_id"), F.col("sub_id").alias("label_id"))
    got = label_run(members.withColumnRenamed("label_id", "category"), known, client, scope="category", size=size)
    return got.withColumnRenamed("label_ids", "sub_ids").withColumnRenamed("category", "label_id")

