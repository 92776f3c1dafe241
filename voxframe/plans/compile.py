"""A route compiled into lazy plans, one DataFrame per block of the evidence (section "ask" of the reference's life cycle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, tallies
from ..operators.corpus import members as memberships
from ..operators.sampling import budgets, composite_sample, length_tercile, signal_tags
from .route import Route


def evidence(route: Route, corpus: DataFrame, taxonomy: DataFrame | None = None, concepts: dict[str, list[str]] | None = None, per_label: int = 10, total: int = 120, seed: int = 7) -> dict[str, DataFrame]:
    """The blocks an answer needs: nothing runs before a block is read.

    ``denominators`` is one aggregate over one scan whatever the number of filters; counts cover all responses, quotes are samples.
    """
    out: dict[str, DataFrame] = {"denominators": filters.denominators(corpus, route.filters)}
    chosen = filters.select(corpus, route.filters)
    if route.route == "aggregate_direct":
        if route.target == "event":
            out["event"] = tallies.event_tally(chosen)
        elif route.target == "time":
            out["time"] = tallies.time_tally(chosen)
        else:
            out["locations"] = tallies.top_spans(tallies.span_counts(chosen), floor=1, cap=50)
        return out
    mine = memberships(chosen).where(F.col("label_id").isin(*route.labels))
    out["unique"] = mine.agg(F.count_distinct("response_key").alias("n_unique"))
    counts = mine.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    out["selection"] = counts
    if route.groups:
        spark = corpus.sparkSession
        named = spark.createDataFrame([(n, i) for n, ids in route.groups for i in ids], "group_name string, label_id string")
        out["groups"] = tallies.unique_responses(mine, named)
    if concepts and route.concepts:
        hits = tallies.concept_matches(corpus, {c: concepts[c] for c in route.concepts})
        out["concepts"] = hits.groupBy("concept", "question_id").agg(F.count(F.lit(1)).alias("n"))
    out["coverage"] = tallies.coverage(mine, corpus, list(route.labels))
    out["uncovered"] = tallies.uncovered_categories(memberships(chosen), list(route.labels))
    rows = chosen.join(mine.select("response_key", "label_id"), "response_key").where("response_text IS NOT NULL")
    tagged = length_tercile(rows, ["label_id"], "response_text").withColumn("tags", signal_tags(rows))
    plan = budgets(counts, per_label, total)
    out["budgets"] = plan
    out["quotes"] = composite_sample(tagged, per_label, seed)
    return out
