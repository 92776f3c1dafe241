"""Quote budgets and samples (WN-06 .. WN-17)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256)


def owner_label(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """WN-06: the first selected label (by position) a response has."""
    return members.join(candidates, "label_id").groupBy("response_key").agg(F.min_by("label_id", "position").alias("label_id"))


def primary_sub_theme(sub_members: DataFrame) -> DataFrame:
    """WN-17: the largest sub-theme of a response; ties by id."""
    sizes = sub_members.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"))
    return sub_members.join(sizes, "sub_id").groupBy("response_key").agg(F.min_by("sub_id", F.struct(-F.col("n"), F.col("sub_id"))).alias("sub_id"))


def budgets(counts: DataFrame, per_label: int, total: int, per_sub: int = 3, extra: int = 4, cap: int = 40) -> DataFrame:
    """WN-08: quotes per label: the per-label budget, or an equal share of the total, at least one, never more than members.

    With more labels than the total allows, the largest get one each.  Where ``counts`` has ``n_subs``, a label with sub-themes asks for ``per_sub`` quotes
    each and ``extra`` more, up to ``cap``; if all wishes exceed the total they shrink alike.
    """
    everything = Window.partitionBy()  # as many rows as the selection has labels
    rank = F.row_number().over(everything.orderBy(F.desc("n"), "label_id"))
    share = F.greatest(F.lit(1), F.least(F.lit(per_label), F.floor(F.lit(total) / F.count(F.lit(1)).over(everything))))
    ranked = counts.withColumn("rank", rank)
    if "n_subs" not in counts.columns:
        return ranked.withColumn("budget", F.when(F.col("rank") <= total, F.least(share, F.col("n"))).otherwise(0).cast("int"))
    wish = F.when(F.col("n_subs") > 0, F.greatest(share, F.least(per_sub * F.col("n_subs") + extra, F.lit(cap)))).otherwise(share)
    wished = ranked.withColumn("_wish", wish).withColumn("_all", F.sum("_wish").over(everything))
    scaled = F.when(F.col("_all") > total, F.greatest(F.lit(1), F.floor(F.col("_wish") * total / F.col("_all")))).otherwise(F.col("_wish"))
    return wished.withColumn("budget", F.when(F.col("rank") <= total, F.least(scaled, F.col("n"))).otherwise(0).cast("int")).drop("_wish", "_all")


def length_tercile(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """WN-11: short, mid or long within the group: up to the length a third of the way, up to that two thirds of the way, beyond.

    Equal lengths share a band.  The two lengths come from prefix sums over one count per length, so no group is sorted row by row.
    """
    counts = rows.groupBy(*by, F.length(text).alias("_len")).agg(F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy(*by)
    upto = F.sum("_k").over(group.orderBy("_len"))
    lengths = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_k").over(group))
    edge = lambda k: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * k / 3), F.col("_len")))
    edges = lengths.groupBy(*by).agg(edge(1).alias("_lo"), edge(2).alias("_hi"))
    size = F.length(text)
    band = F.when(size <= F.col("_lo"), "short").when(size > F.col("_hi"), "long").otherwise("mid")
    return rows.join(edges, by).withColumn("band", band).drop("_lo", "_hi")


def signal_tags(rows: DataFrame) -> Column:
    """WN-11: what a response carries: other labels, places, sub-themes (where ``rows`` has ``sub_ids``), actionability, event, length band."""
    prefix = lambda p, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p), x))
    return F.array_compact(
        F.concat(
            prefix("co:", F.array_remove(F.col("label_ids"), F.col("label_id"))), prefix("at:", F.col("locations")), *([prefix("sub:", F.col("sub_ids"))] if "sub_ids" in rows.columns else []),
            F.array(F.concat(F.lit("act:"), F.col("actionability")), F.when(F.col("event_occurred"), F.lit("evt")), F.concat(F.lit("len:"), F.col("band"))),
        )
    )


def composite_sample(rows: DataFrame, budget: int, seed: int, key: str = "response_key", by: str = "label_id", tags: str = "tags") -> DataFrame:
    """WN-09: half the budget covers as many distinct tags as it can, greedily, the other half is a seeded uniform draw.

    Responses with the same tags are interchangeable for the cover: once one is chosen the others gain nothing.  So Spark keeps the
    smallest key of each distinct tag set, and the ``2 * budget`` first keys of the seeded order, which always suffice for the draw;
    the pandas step sees only these and decides as it would over the whole category.
    """
    order = seeded_order(F.col(key), seed)
    base = rows.select(by, key, F.sort_array(F.array_distinct(tags)).alias(tags), order.alias("_o"))
    per_set = base.groupBy(by, tags).agg(F.min(F.struct(key, "_o")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    drawn = base.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_o", key))).where(F.col("_r") <= 2 * budget)
    pool = per_set.select(by, f"_m.{key}", tags, "_m._o").unionByName(drawn.select(by, key, tags, "_o")).dropDuplicates([by, key])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {k: set(t) for k, t in sorted(zip(pdf[key], pdf[tags]))}
        chosen: list[tuple[str, str]] = []
        if len(left) <= budget:
            chosen = [(k, "all") for k in left]
        else:
            open_tags = set().union(*left.values())
            while open_tags and len(chosen) < budget // 2:
                best = max(left, key=lambda k: len(left[k] & open_tags))  # the first of the sorted keys wins a tie
                if not left[best] & open_tags:
                    break
                open_tags -= left.pop(best)
                chosen.append((best, "cover"))
            rest = pdf[pdf[key].isin(left)].sort_values("_o")[key].tolist()
            chosen += [(k, "draw") for k in rest[: budget - len(chosen)]]
        return pd.DataFrame({by: pdf[by].iloc[0], key: [k for k, _ in chosen], "reason": [r for _, r in chosen]})

    kinds = dict(rows.dtypes)
    return pool.groupBy(by).applyInPandas(pick, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, reason string")


def stratified_sample(rows: DataFrame, budget: int, per_stratum: int, seed: int, key: str = "response_key", by: str = "label_id", stratum: str = "sub_id") -> DataFrame:
    """WN-10: the same number from each sub-theme, a response counting for its first one in order of size, then a seeded fill."""
    sizes = rows.groupBy(by, stratum).agg(F.count(F.lit(1)).alias("_n"))
    own = rows.join(sizes, [by, stratum]).groupBy(by, key).agg(F.min(F.struct(-F.col("_n"), F.col(stratum))).alias("_s"))
    o = seeded_order(F.col(key), seed)
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_s").orderBy(o)))
    first = ranked.withColumn("_first", (F.col("_r") <= per_stratum).cast("int"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_first"), "_s", o))
    return first.withColumn("_p", place).where(F.col("_p") <= budget).select(by, key, F.col(f"_s.{stratum}").alias(stratum), F.when(F.col("_first") == 1, "stratum").otherwise("fill").alias("reason"))


def spread_indices(count: int, n: int) -> list[int]:
    """WN-16: up to ``count`` indices spread evenly over ``n``."""
    k = min(count, n)
    return sorted({i * n // k for i in range(k)}) if k > 0 else []


def spread_positions(n: Column, count: int) -> Column:
    """WN-16 in a row: the same indices as an array."""
    k = F.least(F.lit(count).cast("long"), n.cast("long"))
    return F.when(k > 0, F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.floor(i * n / k)))).otherwise(F.array().cast("array<bigint>"))


def round_robin(members: DataFrame, cap: int = 6, by: str = "label_id", pool: str = "pool", key: str = "response_key") -> DataFrame:
    """WN-13: ``cap`` examples per label, one from each pool in turn; within a pool in order of the key.

    A pool gives ``cap`` at most: Spark keeps that many of each before the rows are shuffled (a limit pushed below the window).
    """
    within = Window.partitionBy(by, pool).orderBy(key)
    each = members.select(by, pool, key).distinct().withColumn("pos", F.row_number().over(within)).where(F.col("pos") <= cap)
    picked = each.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("pos", pool))).where(F.col("r") <= cap)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda s: s[key])
    return picked.groupBy(by).agg(ordered.alias("examples"))


def first_place(places: DataFrame, by: list[str], key: str = "response_key", place: str = "place") -> DataFrame:
    """WN-07 where every place has room: each response once, under the place of its scope that most responses name; ties by name."""
    sizes = places.groupBy(*by, place).agg(F.count_distinct(key).alias("_n"))
    return places.join(sizes, [*by, place]).groupBy(*by, key).agg(F.min_by(place, F.struct(-F.col("_n"), F.col(place))).alias(place))


def quote_once(picks: list[tuple[str, list[str]]], per_place: int) -> dict[str, list[str]]:
    """WN-07 (driver side, sampled quotes): a response is quoted once, under the place with most responses that still has room."""
    used: set[str] = set()
    out: dict[str, list[str]] = {}
    for place, keys in picks:
        out[place] = [k for k in keys if k not in used][:per_place]
        used.update(out[place])
    return out


def sampling_note(shown: int, total: int, detail: dict[str, int] | None = None) -> str:
    """WN-12: what a sample shows, in words; empty when everything is shown."""
    if shown >= total:
        return ""
    note = f"showing {shown} of {total}"
    if detail:
        note += f" ({detail['coverage_picks']} chosen to cover {detail['tags_covered']} of {detail['tags_total']} signals, {detail['random_picks']} at random)"
    return note
