"""Counts: categories, parents, groups, places, times, events, facets, periods (AG-01 .. AG-25, AG-33, AG-37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import concept_pattern, normalized_span
from .filters import is_day, is_night


def category_counts(members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """AG-01: members per category of the taxonomy, zero where there are none."""
    n = members.groupBy("label_id").agg(F.count_distinct("response_key").alias("n"))
    return taxonomy.join(n, "label_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def unknown_labels(members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """JN-16: labels that responses carry and no taxonomy has."""
    return members.join(taxonomy, "label_id", "left_anti").groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


def unique_responses(members: DataFrame, groups: DataFrame) -> DataFrame:
    """AG-03, AG-04: responses per named group of labels, each once however many of the group's labels it has."""
    return members.join(groups, "label_id").groupBy("group_name").agg(F.count_distinct("response_key").alias("n_unique"), F.count(F.lit(1)).alias("n_memberships"))


def parent_counts(members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """AG-05: responses per parent: the union of its children, not their sum."""
    labels = taxonomy.select("label_id", "parent_id")
    return members.join(labels, "label_id").groupBy("question_id", "parent_id").agg(F.count_distinct("response_key").alias("n"), F.count_distinct("label_id").alias("n_labels"))


def span_counts(corpus: DataFrame, spans: str = "locations") -> DataFrame:
    """AG-16: normalised spans, each once per response."""
    each = corpus.select("question_id", "response_key", F.explode(F.array_distinct(F.transform(spans, normalized_span))).alias("span")).where("span <> ''")
    return each.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("n_questions"))


def top_spans(counts: DataFrame, floor: int = 2, cap: int = 300) -> DataFrame:
    """AG-17: the ``cap`` most frequent spans of at least ``floor`` responses; ties in order of the span."""
    return counts.where(F.col("n") >= floor).orderBy(F.desc("n"), "span").limit(cap)


def span_report(counts: DataFrame, floor: int = 2, cap: int = 300) -> DataFrame:
    """AG-17: how many spans are shown, dropped below the floor, and beyond the cap."""
    return counts.agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("n") < floor).alias("n_below")).select(
        "n_spans", "n_below", F.greatest(F.col("n_spans") - F.col("n_below") - F.lit(cap), F.lit(0)).alias("n_over_cap")
    )


def _may_hold(low: Column, terms: list[str]) -> Column:
    """Whether a lower-cased text holds the longest word of any term: a byte search that spares most pattern calls.

    A term whose longest word is not plain ASCII has no such test.
    """
    words = {max(t.lower().split(), key=len) for t in terms if t.strip()}
    if not words or not all(w.isascii() for w in words):
        return F.lit(True)
    out = None
    for w in sorted(words):
        one = F.contains(low, F.lit(w))
        out = one if out is None else out | one
    return out


def concept_matches(corpus: DataFrame, concepts: dict[str, list[str]], text: str = "response_text") -> DataFrame:
    """JN-13: one row per response and concept found in it, in one scan: a constant pattern per concept, no join.

    The pattern decides; it is only tried where a byte search finds a word of the concept.  The three letters that match an ASCII letter
    without lower-casing to it are folded first, so the search never misses.
    """
    low = F.lower(F.translate(F.col(text), "İſ\u212a", "isk"))
    ready = corpus.withColumn("_low", low)
    tests = [F.when(_may_hold(F.col("_low"), terms) & F.col(text).rlike(concept_pattern(terms)), F.lit(name)) for name, terms in concepts.items()]
    return ready.withColumn("concept", F.explode(F.array_compact(F.array(*tests)))).drop("_low")


def place_counts(matches: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG-06: per place the responses of the scope, and how many name any place."""
    inside = matches.join(scope.select("response_key"), "response_key", "left_semi")
    return inside.groupBy("concept").agg(F.count_distinct("response_key").alias("n")), inside.agg(F.count_distinct("response_key").alias("naming_any"))


def time_tally(corpus: DataFrame) -> DataFrame:
    """AG-11: mentioned, day, night, both, day_or_night; day + night - both = day_or_night."""
    spans = F.col("time_context")
    day, night = is_day(spans), is_night(spans)
    return corpus.agg(
        F.count_if(F.size(spans) > 0).alias("mentioned"), F.count_if(day).alias("day"), F.count_if(night).alias("night"),
        F.count_if(day & night).alias("both"), F.count_if(day | night).alias("day_or_night"),
    )


def event_tally(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG-12: in scope, coded, and reporting an event."""
    counts = (
        F.count(F.lit(1)).alias("in_scope"), F.count_if(F.col("uncategorized").isNotNull()).alias("coded"), F.count_if(F.coalesce("event_occurred", F.lit(False))).alias("reported"),
    )
    return corpus.groupBy(*by).agg(*counts) if by else corpus.agg(*counts)


def attribute_counts(attributes: DataFrame) -> DataFrame:
    """AG-14: respondents (not responses) per value."""
    return attributes.groupBy("field", "value").agg(F.count_distinct("respondent_key").alias("n"))


def cardinality(attributes: DataFrame, high: int = 100, dates: tuple[str, ...] = ()) -> DataFrame:
    """AG-25: exact number of values per field, and whether it is too many to choose from; a field of ``dates`` counts days, not their notations."""
    value = F.when(F.col("field").isin(*dates), parse_date(F.col("value")).cast("string")).otherwise(F.col("value")) if dates else F.col("value")
    return attributes.groupBy("field").agg(F.count_distinct(value).alias("n_distinct")).withColumn("is_high", F.col("n_distinct") > high)


def facets(attributes: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """AG-13: respondents per field and value, each field counted under the *other* fields' selections.

    One pass: every respondent gets a bit per selected field it satisfies, and a value of field f counts those who satisfy all others.
    """
    bits = {f: 1 << i for i, f in enumerate(sorted(selected))}
    everything = (1 << len(bits)) - 1
    hit = F.lit(0)
    for f, values in selected.items():
        hit = F.when((F.col("field") == f) & F.col("value").isin(*values), bits[f]).otherwise(hit)
    own = F.lit(0)
    for f, b in bits.items():
        own = F.when(F.col("field") == f, b).otherwise(own)
    mask = attributes.groupBy("respondent_key").agg(F.bit_or(hit).alias("mask"))
    rows = attributes.select("respondent_key", "field", "value").distinct().join(mask, "respondent_key")
    return rows.where((F.col("mask").bitwiseOR(own)) == everything).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_total(attributes: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """AG-13: respondents that satisfy every field's selection."""
    fits = [F.count_if((F.col("field") == f) & F.col("value").isin(*v)) > 0 for f, v in selected.items()]
    out = fits[0]
    for c in fits[1:]:
        out = out & c
    return attributes.groupBy("respondent_key").agg(out.alias("ok")).agg(F.count_if(F.col("ok")).alias("n_matching"))


def period_counts(attributes: DataFrame, label: Column) -> DataFrame:
    """AG-15: respondents per period: days collapse to labels, and a respondent with two days of one period counts once."""
    return attributes.withColumn("period", label).groupBy("field", "period").agg(F.count_distinct("respondent_key").alias("n"))


def run_report(corpus: DataFrame) -> DataFrame:
    """AG-19: a label run in one row; the mean of labels is given as its two integers."""
    n_labels = F.coalesce(F.size("label_ids"), F.lit(0))
    done = F.col("uncategorized").isNotNull()
    return corpus.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(done).alias("labelled"), F.count_if(F.coalesce("uncategorized", F.lit(False))).alias("uncategorized"),
        F.sum(F.when(done & (n_labels > 0), n_labels)).alias("sum_labels"), F.count_if(done & (n_labels > 0)).alias("with_labels"),
        F.count_if(done & (n_labels == 0)).alias("zero_labels"), F.count_if(F.coalesce("event_occurred", F.lit(False))).alias("events"),
    )


def histogram(corpus: DataFrame, column: str) -> DataFrame:
    """AG-19: rows per value, missing data under its own name."""
    return corpus.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def coverage(members: DataFrame, corpus: DataFrame, selected: list[str], small: int = 100) -> DataFrame:
    """AG-09: responses the selection covers out of all coded ones, as integers, and whether the base is small."""
    hit = F.coalesce(F.arrays_overlap("label_ids", F.array(*map(F.lit, selected))), F.lit(False))
    return corpus.agg(F.count_if(hit).alias("covered"), F.count_if(F.col("uncategorized").isNotNull()).alias("scope_total")).withColumn(
        "is_small", F.col("scope_total") < small
    )


def uncovered_categories(members: DataFrame, selected: list[str], top: int = 5) -> DataFrame:
    """AG-09: the largest categories outside the selection."""
    rest = members.where(~F.col("label_id").isin(*selected)).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    return rest.orderBy(F.desc("n"), "label_id").limit(top)


def sub_theme_counts(members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """AG-07: per category its members (coded), those without any sub-theme (generic), and how many sub-themes are used.

    ``members``: response_key, label_id; ``sub_members``: response_key, label_id, sub_id.
    """
    subs = sub_members.groupBy("label_id", "response_key").agg(F.collect_set("sub_id").alias("subs"))  # the sub-themes of one response
    both = members.select("label_id", "response_key").distinct().join(subs, ["label_id", "response_key"], "left")
    coded = both.groupBy("label_id").agg(F.count(F.lit(1)).alias("coded"), F.count_if(F.col("subs").isNull()).alias("generic"))
    used = sub_members.groupBy("label_id").agg(F.count_distinct("sub_id").alias("n_subs"))
    return coded.join(used, "label_id", "left").na.fill(0, ["n_subs"])


def sub_theme_sizes(sub_members: DataFrame) -> DataFrame:
    """AG-07: responses per sub-theme, largest first within its category."""
    return sub_members.groupBy("label_id", "sub_id").agg(F.count_distinct("response_key").alias("n"))


def sources(quotes: DataFrame, names: DataFrame, by_place: bool) -> DataFrame:
    """TX-17: quotes per group: the place for an answer by place (``no place named`` without one), else the category's name, or its id where it has none.

    ``quotes``: response_key, label_id, location; ``names``: label_id, name.
    """
    named = quotes.join(names.select("label_id", "name"), "label_id", "left")
    group = F.coalesce("location", F.lit("no place named")) if by_place else F.coalesce("name", "label_id")
    return named.groupBy(group.alias("group_name")).agg(F.count(F.lit(1)).alias("n"))


def deletion_preview(files: DataFrame) -> DataFrame:
    """AG-30: what deleting a dataset takes with it, per root: files, bytes, runs and recorded spend (unknown where no run recorded any).

    ``files``: root, path, size, run_id (null outside runs), micro_usd (null where nothing was recorded).
    """
    return files.groupBy("root").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.count_distinct("run_id").alias("n_runs"), F.sum("micro_usd").alias("micro_usd")
    )


def dataset_summary(members: DataFrame, taxonomy: DataFrame, concepts: DataFrame, places: DataFrame) -> DataFrame:
    """AG-37: per question its categories, those in use, the largest, and how many responses its concepts and places reach.

    ``concepts`` and ``places``: question_id, response_key, concept.
    """
    n = category_counts(members, taxonomy).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if(F.col("n") > 0).alias("n_used"), F.max(F.nullif("n", F.lit(0))).alias("largest")
    )
    reach = lambda hits, name: hits.groupBy("question_id").agg(F.count_distinct("concept").alias(f"n_{name}"), F.count_distinct("response_key").alias(f"{name}_responses"))
    out = n.join(reach(concepts, "concepts"), "question_id", "left").join(reach(places, "places"), "question_id", "left")
    return out.na.fill(0, ["n_concepts", "concepts_responses", "n_places", "places_responses"])


def proper_nouns(texts: DataFrame, text: str, stopwords: list[str], least: int = 3, top: int = 80) -> DataFrame:
    """AG-18: capitalised words and short acronyms that do not begin a sentence, most frequent first; ties in order of the term."""
    sentences = F.split(F.regexp_replace(text, r"([.!?/;])\s+", "$1\u0001"), "\u0001")
    # the first word of a sentence tells nothing
    later = F.transform(sentences, lambda s: F.slice(F.regexp_extract_all(s, F.lit(r"(?<![\w])([A-Za-z][A-Za-z'&.-]*)(?![\w])")), 2, 1 << 30))
    word = F.col("term")
    low, is_upper = F.lower(word), word == F.upper(word)
    name = word.rlike("^[A-Z]") & ~is_upper & (F.length(word) > 1)
    acronym = is_upper & F.length(word).between(2, 6)
    each = texts.select(F.explode(F.flatten(later)).alias("term")).where(~low.isin(*stopwords) & (name | acronym))
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), "term").limit(top)


def terms(texts: DataFrame, text: str, stopwords: list[str], least: int = 4, top: int = 120, top_pairs: int = 80) -> DataFrame:
    """AG-18: most frequent words and neighbouring word pairs; ties in order of the term (``proper_nouns`` gives the names)."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z][a-z'-]{2,})")), lambda w: ~w.isin(*stopwords))
    split = texts.select(words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.col("w")[i + 1]))
    both = split.select(F.lit("word").alias("kind"), F.explode("w").alias("term")).unionByName(split.select(F.lit("pair").alias("kind"), F.explode(pairs).alias("term")))
    counted = both.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # partial top-k per kind: the window sees counted terms only, never texts
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == "pair", top_pairs).otherwise(top))
