"""Evidence filters with disclosed denominators (EV-01 .. EV-11).

Every filter is a flag worked out once per response, and every denominator a conditional count over those flags, so a chain of
filters with all its denominators is a single aggregate over a single scan.  Missing data (not coded, no value) is counted on its own
and never as a negative.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a time span that say day or night; "every day" says how often, not when.
NIGHT = r"(?iu)night|evening|dark|midnight|overnight|dusk"
DAY = r"(?iu)(?<!every )(?<!every)\bday(?:time|light)?\b|morning|afternoon|\bnoon|daylight"


@dataclass(frozen=True)
class Filters:
    """What an analyst asked for; an empty part does not filter."""

    labels: tuple[str, ...] = ()
    questions: tuple[int, ...] = ()
    places: tuple[str, ...] = ()
    implicit_questions: tuple[int, ...] = ()
    actionability: str = ""
    event: bool = False
    time: str = ""
    demographics: dict[str, tuple[str, ...]] = field(default_factory=dict)


def is_night(spans: Column) -> Column:
    return F.coalesce(F.array_join(spans, " | ").rlike(NIGHT), F.lit(False))


def is_day(spans: Column) -> Column:
    return F.coalesce(F.array_join(spans, " | ").rlike(DAY), F.lit(False))


def is_uncovered(uncategorized: Column, fit: Column) -> Column:
    """EV-10: without a category, or in one that hardly fits."""
    return F.coalesce(uncategorized, F.lit(False)) | F.coalesce(fit == 1, F.lit(False))


def in_scope(f: Filters) -> Column:
    """EV-01, EV-09: has a selected label, in a selected question; a union, so a response with two of them is one."""
    out = F.lit(True)
    if f.labels:
        out = F.coalesce(F.arrays_overlap("label_ids", F.array(*map(F.lit, f.labels))), F.lit(False))
    if f.questions:
        out = out & F.col("question_id").isin(*f.questions)
    return out


def steps(f: Filters) -> list[tuple[str, Column, Column]]:
    """The filters in their fixed order: name, has data, matches."""
    out: list[tuple[str, Column, Column]] = []
    if f.places:
        named = F.arrays_overlap(F.transform("locations", F.lower), F.array(*[F.lit(p.lower()) for p in f.places]))
        if f.implicit_questions:
            named = F.coalesce(named, F.lit(False)) | F.col("question_id").isin(*f.implicit_questions)
        out.append(("location", F.col("uncategorized").isNotNull(), F.coalesce(named, F.lit(False))))
    if f.actionability:
        out.append(("actionability", F.col("actionability").isNotNull(), F.coalesce(F.col("actionability") == f.actionability, F.lit(False))))
    if f.event:
        out.append(("event", F.col("uncategorized").isNotNull(), F.coalesce("event_occurred", F.lit(False))))
    if f.time:
        test = is_night if f.time == "night" else is_day
        out.append(("time", F.coalesce(F.size("time_context") > 0, F.lit(False)), test(F.col("time_context"))))
    if f.demographics:
        has = [F.col("attributes")[k].isNotNull() for k in f.demographics]
        fits = [F.coalesce(F.arrays_overlap(F.col("attributes")[k], F.array(*map(F.lit, v))), F.lit(False)) for k, v in f.demographics.items()]
        every = lambda cs: F.coalesce(_all(cs), F.lit(False))
        out.append(("demographic", every(has), every(fits)))
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def denominators(corpus: DataFrame, f: Filters) -> DataFrame:
    """One row: for every filter in order ``<name>_in_scope``, ``_coded`` and ``_matching`` on what the earlier ones left, and ``n``."""
    alive = in_scope(f)
    counts = []
    for name, has, fits in steps(f):
        counts += [
            F.count_if(alive).alias(f"{name}_in_scope"), F.count_if(alive & has).alias(f"{name}_coded"), F.count_if(alive & has & fits).alias(f"{name}_matching")
        ]
        alive = alive & has & fits
    return corpus.agg(*counts, F.count_if(alive).alias("n"))


def select(corpus: DataFrame, f: Filters) -> DataFrame:
    """The responses that pass the scope and every filter."""
    out = corpus.where(in_scope(f))
    for _, has, fits in steps(f):
        out = out.where(has & fits)
    return out


def with_attributes(corpus: DataFrame, attributes: DataFrame) -> DataFrame:
    """EV-06, JN-03: the respondent's values per field as a map of arrays; respondents without any have null."""
    fields = attributes.groupBy("respondent_key", "field").agg(F.sort_array(F.collect_set("value")).alias("values"))
    maps = fields.groupBy("respondent_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("attributes"))
    return corpus.join(maps, "respondent_key", "left")


def eligible(counts: DataFrame, least: int = 150) -> DataFrame:
    """EV-11: categories large enough for sub-themes, largest first."""
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "label_id")


def check_demographics(known: DataFrame, asked: dict[str, list[str]]) -> dict[str, tuple[str, ...]]:
    """EV-08: unknown fields and values raise, blanks go; ``known`` (field, value) may be of any size, only asked values are fetched."""
    clean = {k: tuple(v for v in vs if v and v.strip()) for k, vs in asked.items()}
    clean = {k: v for k, v in clean.items() if v}
    if not clean:
        return {}
    found = {(r[0], r[1]) for r in known.where(F.col("field").isin(*clean) & F.col("value").isin(*{v for vs in clean.values() for v in vs})).select("field", "value").distinct().collect()}
    unknown = [f"{k}={v}" for k, vs in clean.items() for v in vs if (k, v) not in found]
    if unknown:
        raise ValueError(f"unknown attribute values: {', '.join(unknown)}")
    return clean
