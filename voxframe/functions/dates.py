"""Dates of answers: parsing, calendar buckets, named periods (DT-01 .. DT-06)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNLABELED = "(unlabeled)"
GRANULARITIES = ("quarter", "month", "year")


def parse_date(c: Column) -> Column:
    """DT-01: a day in one of five notations, a time part dropped; null for anything else.

    Two-digit years follow the usual pivot: 69-99 are 1969-1999, 00-68 are 2000-2068.
    """
    v = F.split(F.trim(c), "[ T]")[0]

    def read(shape: str, fmt: str) -> Column:
        return F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(fmt)).cast("date"))

    short = read(r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(
        read(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        read(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        short,
        read(r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        read(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    )


def bucket_label(day: Column, granularity: str) -> Column:
    """DT-02: quarter, month or year of a day; the labels sort in time order."""
    if granularity == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit(" Q"), F.quarter(day).cast("string"))
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    if granularity == "year":
        return F.year(day).cast("string")
    raise ValueError(f"granularity {granularity!r} is none of {', '.join(GRANULARITIES)}")


@dataclass(frozen=True)
class Period:
    label: str
    start: dt.date
    end: dt.date


def periods(config: list[dict[str, str]]) -> list[Period]:
    """DT-05: named periods, checked: labelled, in order, each ending after it starts, none overlapping."""
    made: list[Period] = []
    for raw in config:
        label = str(raw.get("label", "")).strip()
        if not label or label == UNLABELED:
            raise ValueError(f"a period needs a label other than {UNLABELED}")
        try:
            one = Period(label, dt.date.fromisoformat(str(raw.get("start"))), dt.date.fromisoformat(str(raw.get("end"))))
        except ValueError as e:
            raise ValueError(f"period {label!r}: dates must be YYYY-MM-DD") from e
        if one.end < one.start:
            raise ValueError(f"period {label!r} ends before it starts")
        if made and one.start <= made[-1].end:
            raise ValueError(f"periods {made[-1].label!r} and {label!r} overlap or are out of order")
        made.append(one)
    if not made:
        raise ValueError("no periods given")
    return made


def period_label(day: Column, named: list[Period]) -> Column:
    """DT-03: the period a day lies in, ``(unlabeled)`` for none; null stays null."""
    label = F.lit(UNLABELED)
    for p in reversed(named):
        label = F.when(day.between(F.lit(p.start), F.lit(p.end)), p.label).otherwise(label)
    return F.when(day.isNotNull(), label)


def period_order(label: Column, named: list[Period]) -> Column:
    """DT-04: position of a period's label, unlabelled last."""
    at = F.lit(len(named))
    for i, p in enumerate(named):
        at = F.when(label == p.label, i).otherwise(at)
    return at


def check_window(start: str | None, end: str | None) -> None:
    """DT-06: a fielding window is two ISO days in order, or open."""
    days = [dt.date.fromisoformat(d) if d else None for d in (start, end)]
    if days[0] and days[1] and days[1] < days[0]:
        raise ValueError("the fielding window ends before it starts")
