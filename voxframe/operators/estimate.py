"""Measured rates, percentiles, prices and plans (AG-26 .. AG-29, AG-32, AG-36, AG-38, AG-39, SF-11 .. SF-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def newest_runs(runs: DataFrame, scope: list[str], run: str = "run_id") -> DataFrame:
    """SC-09, SC-11, WN-14: the run with the greatest id of each scope."""
    cols = [c for c in runs.columns if c not in scope]
    return runs.groupBy(*scope).agg(F.max_by(F.struct(*cols), run).alias("_r")).select(*scope, "_r.*")


def pooled_rates(runs: DataFrame, amount: str, base: str, by: list[str], least: int = 200) -> DataFrame:
    """AG-26: ratio of sums over the newest qualifying runs, given as its two integers; never a mean of ratios."""
    return runs.where(F.col(base) >= least).groupBy(*by).agg(F.sum(amount).cast("long").alias("amount"), F.sum(base).cast("long").alias("base"), F.count(F.lit(1)).alias("n_runs"))


def spread(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AG-27: linearly interpolated 10th, 50th and 90th percentile."""
    return values.groupBy(*by).agg(*[F.percentile(value, q).alias(name) for name, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


def interpolated(sizes: DataFrame, wanted: DataFrame, size: str, value: str) -> DataFrame:
    """AG-28: the median value per size, interpolated over log10 of the size, flat beyond the ends.

    ``sizes`` are the distinct corpus sizes of past runs, ``wanted`` may be of any length: wanted sizes are placed among the measured ones by
    one sort of the distinct values, not by a join on ranges.
    """
    medians = sizes.groupBy(F.col(size).cast("double").alias("at")).agg(F.percentile(value, 0.5).alias("v"))
    both = medians.unionByName(wanted.select(F.col(size).cast("double").alias("at")).distinct(), allowMissingColumns=True)
    points = both.groupBy("at").agg(F.max("v").alias("v"), F.count_if(F.col("v").isNull()).alias("asked"))
    order = Window.orderBy("at")  # distinct sizes only
    known = F.when(F.col("v").isNotNull(), F.struct(F.col("at").alias("s"), "v"))
    lo = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = points.select("at", "asked", lo.alias("lo"), hi.alias("hi"))
    x = (F.log10("at") - F.log10("lo.s")) / (F.log10("hi.s") - F.log10("lo.s"))
    inside = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo.s") < F.col("hi.s"))
    estimate = F.when(inside, F.col("lo.v") + x * (F.col("hi.v") - F.col("lo.v"))).otherwise(F.coalesce("lo.v", "hi.v"))
    kind = dict(wanted.dtypes)[size]
    return placed.where("asked > 0").select(F.col("at").cast(kind).alias("at"), estimate.alias("estimate"))


def divided(n: Column, by: int) -> tuple[Column, Column, Column]:
    """SF-12: calls of ``by`` items each, how many of them are full, and what the last one holds beyond them."""
    return F.ceil(n / by), F.floor(n / by), n % by


def counted_tokens(prompts: DataFrame, count: object, sample: int = 8, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """SF-13: input tokens of a stage's prompts (position, text): ``tokens, basis, n_counted``.

    ``count`` is a function that counts the tokens of one text (a public tokenizer, say), or null.  With as many prompts as ``sample`` allows all are counted
    (``exact``); with more, prompts spread evenly over the stage are, and the others follow their pooled tokens a character (``sampled``).  Without
    a function it is a quarter of the characters (``heuristic``).
    """
    totals = prompts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n, chars = totals.n, totals.chars or 0
    spark = prompts.sparkSession
    schema = "tokens long, basis string, n_counted long"
    if not n:
        return spark.createDataFrame([(0, "exact", 0)], schema)
    if count is None:
        return spark.createDataFrame([(round(chars / chars_per_token), "heuristic", 0)], schema)
    from .sampling import spread_indices

    chosen = prompts.where(F.col("position").isin(spread_indices(sample, n))).select("text").collect()  # at most ``sample`` prompts
    counted, shown = sum(count(r.text) for r in chosen), sum(len(r.text) for r in chosen)
    rest = round((chars - shown) * counted / shown) if shown else 0
    return spark.createDataFrame([(counted + rest, "exact" if len(chosen) == n else "sampled", len(chosen))], schema)


def induction_plan(counts: DataFrame, chunk: int = 120, themes_batch: int = 120, chars: str = "chars", prompt_chars: int = 3000, per_million: int = 3) -> DataFrame:
    """AG-39: calls of an induction per question: one a chunk, a vocabulary, assignments in batches of the expected candidates, merges; tokens and micro-dollars.

    ``counts``: question_id, n responses, chars.  About twenty candidates a chunk are expected, as many as ``induction_quality`` calls healthy.
    """
    chunks = F.ceil(F.col("n") / chunk)
    out = counts.withColumn("map_calls", chunks).withColumn("candidates", chunks * 20).withColumn("assign_calls", F.ceil(F.col("candidates") / themes_batch))
    out = out.withColumn("calls", F.col("map_calls") + F.col("assign_calls") + 2).withColumn("tokens_in", F.ceil((F.col(chars) + F.col("calls") * prompt_chars) / CHARS_PER_TOKEN))
    return out.withColumn("micro_usd", F.col("tokens_in") * per_million).withColumn("basis", F.lit("heuristic"))


def heuristic_tokens(text: Column) -> Column:
    """SF-13: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def price(tokens: Column, per_million: Column) -> Column:
    """SF-14: null where the price is unknown, never zero."""
    return tokens / 1_000_000 * per_million


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """AG-29: calls and tokens per model, micro-dollars where the model has a price, and whether it lacks one."""
    total = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return total.join(prices, "model", "left").select(
        "model", "calls", "tokens_in", "tokens_out", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")).alias("micro_usd"), F.col("price_in").isNull().alias("is_unpriced")
    )


def label_plan(texts: DataFrame, scope: list[str], text: str, batch: int, prompt_chars: int) -> DataFrame:
    """AG-39: calls and input tokens of a labelling run: each distinct text once, ``batch`` texts and one prompt a call."""
    distinct = texts.groupBy(*scope, text).agg(F.count(F.lit(1)).alias("_n"))
    sums = distinct.groupBy(*scope).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.length(text)).alias("chars"))
    calls = F.ceil(F.col("n_unique") / batch)
    return sums.withColumn("calls", calls).withColumn("tokens_in", F.ceil((F.col("chars") + F.col("calls") * prompt_chars) / CHARS_PER_TOKEN))


def sub_theme_plan(counts: DataFrame, least: int, chunk: int, batch: int) -> DataFrame:
    """AG-36: per eligible category: chunks to induce from, batches to label, one review."""
    return counts.where(F.col("n") >= least).select(
        "label_id", "n", F.ceil(F.col("n") / chunk).alias("induce_calls"), F.ceil(F.col("n") / batch).alias("label_calls"), F.lit(1).alias("review_calls")
    )


def total_estimate(items: DataFrame, low: int = 80, high: int = 130) -> DataFrame:
    """AG-32: the sum of the items with its band in hundredths, in integers; an unpriced item makes the total unknown."""
    return items.agg(F.sum("micro_usd").alias("known"), F.count_if(F.col("micro_usd").isNull()).alias("n_unpriced"), F.count(F.lit(1)).alias("n_items")).select(
        "n_items", "n_unpriced", F.when(F.col("n_unpriced") == 0, F.col("known")).alias("total"), F.floor(F.col("known") * low / 100).alias("low"), F.ceil(F.col("known") * high / 100).alias("high")
    )


def induction_quality(report: DataFrame) -> DataFrame:
    """AG-38: bands of a healthy induction: 8-35 candidates a chunk, merging by 1.2-3.5, at most 40 % singletons, 3-9 parents."""
    return report.select(
        "question_id", F.col("candidates").between(8 * F.col("chunks"), 35 * F.col("chunks")).alias("candidates_ok"),
        (10 * F.col("candidates")).between(12 * F.col("labels"), 35 * F.col("labels")).alias("compression_ok"), (100 * F.col("singletons") <= 40 * F.col("labels")).alias("singletons_ok"), F.col("parents").between(3, 9).alias("parents_ok"),
    )


def rounded_share(part: Column, whole: Column, digits: int = 0) -> Column:
    """SF-11: a percentage rounded half to even, null for an empty whole."""
    return F.bround(F.when(whole > 0, 100 * part / whole), digits)
