"""Queries on counts and filters: AG, EV, DT, SE families."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import bucket_label, parse_date, period_label, periods
from ..operators import corpus as corpora
from ..operators import estimate, filters, matching, tallies
from ..registry import query
from .base import A, C, M, T, attributes, corpus, read

SCOPE = ("1_001", "4_001", "4_002", "9_001")
GROUPS = {"first": ("1_001", "4_001"), "second": ("4_001", "4_002", "9_001")}
PERIODS = [{"label": "Early 2021", "start": "2021-01-01", "end": "2021-06-30"}, {"label": "2022", "start": "2022-01-01", "end": "2022-12-31"}, {"label": "2024 on", "start": "2024-01-01", "end": "2026-12-31"}]
CONCEPTS = {"lights": ["streetlight", "light"], "buses": ["bus", "evening bus"], "bikes": ["bike lane", "bike"], "bins": ["bin", "recycling"], "homes": ["rent", "home"], "parks": ["park", "shade tree", "old tree"]}
SELECTED = {"Age band": ["18-24", "25-34"], "Tenure": ["Rent", "Own"]}
NAMES = {"night": r"night|evening|dark|midnight|overnight|dusk", "day": r"\bday(time|light)?\b|morning|afternoon|\bnoon|daylight"}

_TUPLE = "(" + ", ".join(f"'{s}'" for s in SCOPE) + ")"
_LIST = "[" + ", ".join(f"'{s}'" for s in SCOPE) + "]"
_SPANS = "array_to_string(time_context, ' | ')"
_NIGHT = f"coalesce(regexp_matches({_SPANS}, '(?i){NAMES['night']}'), false)"
_DAY = f"coalesce(regexp_matches(regexp_replace({_SPANS}, '(?i)every ?day', '', 'g'), '(?i){NAMES['day']}'), false)"


@query(f"WITH {C} SELECT question_id, CAST(count(*) AS BIGINT) AS in_scope, CAST(count(*) FILTER (uncategorized IS NOT NULL) AS BIGINT) AS coded, CAST(count(*) FILTER (event_occurred) AS BIGINT) AS reported FROM c GROUP BY 1")
def ag12_event_tally_by_question(spark: SparkSession, d: str) -> DataFrame:
    return tallies.event_tally(corpus(spark, d, "question_id", "uncategorized", "event_occurred"), ["question_id"])


@query(f"WITH {C}, {M}, {T} SELECT t.question_id, t.label_id, CAST(count(DISTINCT m.response_key) AS BIGINT) AS n FROM t LEFT JOIN m USING (label_id) GROUP BY ALL")
def ag01_category_counts(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "dataset_id", "question_id", "label_ids")
    return tallies.category_counts(corpora.members(c), corpora.taxonomy(c)).select("question_id", "label_id", "n")


@query(f"WITH {C} SELECT question_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (uncategorized IS NOT NULL) AS BIGINT) AS coded, CAST(count(*) FILTER (uncategorized) AS BIGINT) AS uncategorized FROM c GROUP BY 1")
def ag37_summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "question_id", "uncategorized").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("uncategorized").isNotNull()).alias("coded"), F.count_if(F.coalesce("uncategorized", F.lit(False))).alias("uncategorized")
    )


@query(f"WITH {C}, {M} SELECT label_id, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def ag02_members_by_label(spark: SparkSession, d: str) -> DataFrame:
    return corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids")).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C}, {M} SELECT CAST(count(DISTINCT response_key) AS BIGINT) AS n_unique, CAST(count(*) AS BIGINT) AS n_memberships FROM m WHERE label_id IN {_TUPLE}")
def ag03_unique_responses(spark: SparkSession, d: str) -> DataFrame:
    m = corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids")).where(F.col("label_id").isin(*SCOPE))
    return m.agg(F.count_distinct("response_key").alias("n_unique"), F.count(F.lit(1)).alias("n_memberships"))


@query(
    f"WITH {C}, {M}, g(group_name, label_id) AS (VALUES "
    + ", ".join(f"('{g}', '{i}')" for g, ids in GROUPS.items() for i in ids)
    + ") SELECT group_name, CAST(count(DISTINCT response_key) AS BIGINT) AS n_unique, CAST(count(*) AS BIGINT) AS n_memberships FROM m JOIN g USING (label_id) GROUP BY 1"
)
def ag04_group_unique(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(g, i) for g, ids in GROUPS.items() for i in ids], "group_name string, label_id string")
    return tallies.unique_responses(corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids")), groups)


@query(f"WITH {C}, {M}, {T} SELECT t.question_id, t.parent_id, CAST(count(DISTINCT response_key) AS BIGINT) AS n, CAST(count(DISTINCT label_id) AS BIGINT) AS n_labels FROM m JOIN t USING (label_id) GROUP BY ALL")
def ag05_parent_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "dataset_id", "question_id", "label_ids")
    return tallies.parent_counts(corpora.members(c), corpora.taxonomy(c).drop("question_id"))


@query(
    f"WITH {C}, {M}, s AS (SELECT DISTINCT response_key FROM m WHERE label_id IN {_TUPLE}), p AS (SELECT DISTINCT response_key, lower(trim(unnest(locations))) AS place FROM c) "
    "SELECT place, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(DISTINCT response_key) FROM p SEMI JOIN s USING (response_key)) AS BIGINT) AS naming_any FROM p SEMI JOIN s USING (response_key) GROUP BY 1"
)
def ag06_place_counts(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "dataset_id", "question_id", "label_ids", "locations")
    scope = corpora.members(c).where(F.col("label_id").isin(*SCOPE)).select("response_key").distinct()
    places = c.select("response_key", F.explode(F.array_distinct(F.transform("locations", lambda x: F.lower(F.trim(x))))).alias("concept"))
    counts, naming = tallies.place_counts(places, scope)
    return counts.withColumnRenamed("concept", "place").crossJoin(F.broadcast(naming))


def _concept_sql(name: str) -> str:
    terms = sorted(CONCEPTS[name], key=lambda t: (-len(t), t))
    return "(?i)\\b(?:" + "|".join(f"{re.escape(t)}(?:e?s)?".replace(r"\ ", r"\s+") for t in terms) + ")\\b"


_CONCEPT_SQL = {n: _concept_sql(n) for n in CONCEPTS}
_HITS = " UNION ALL ".join(f"SELECT question_id, '{n}' AS concept FROM c WHERE regexp_matches(response_text, '{_concept_sql(n)}')" for n in CONCEPTS)


@query(f"WITH {C}, h AS ({_HITS}) SELECT concept, question_id, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY ALL")
def ag08_lexicon_counts(spark: SparkSession, d: str) -> DataFrame:
    return tallies.concept_matches(corpus(spark, d, "question_id", "response_text"), CONCEPTS).groupBy("concept", "question_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C}, h AS ({_HITS}) SELECT concept, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 1")
def jn13_concept_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One scan, a constant pattern per concept; the driver-free form of the regex join."""
    return tallies.concept_matches(corpus(spark, d, "question_id", "response_text"), CONCEPTS).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C} SELECT CAST(count(*) FILTER (list_has_any(label_ids, {_LIST})) AS BIGINT) AS covered, CAST(count(*) FILTER (uncategorized IS NOT NULL) AS BIGINT) AS scope_total, count(*) FILTER (uncategorized IS NOT NULL) < 100 AS is_small FROM c")
def ag09_scope_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "label_ids", "uncategorized")
    return tallies.coverage(c, c, list(SCOPE))


@query(f"WITH {C}, {M} SELECT label_id, CAST(count(*) AS BIGINT) AS n FROM m WHERE label_id NOT IN {_TUPLE} GROUP BY 1 ORDER BY n DESC, label_id LIMIT 5")
def ag09_uncovered_top5(spark: SparkSession, d: str) -> DataFrame:
    return tallies.uncovered_categories(corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids")), list(SCOPE))


_NORM = r"regexp_replace(regexp_replace(lower(trim(x)), '\s+', ' ', 'g'), '^[.,;:!?\"''()\[\]]+|[.,;:!?\"''()\[\]]+$', '', 'g')"
_SPAN = f"trim(CASE WHEN starts_with({_NORM}, 'the ') AND length({_NORM}) > 6 THEN substr({_NORM}, 5) WHEN starts_with({_NORM}, 'a ') AND length({_NORM}) > 4 THEN substr({_NORM}, 3) WHEN starts_with({_NORM}, 'an ') AND length({_NORM}) > 5 THEN substr({_NORM}, 4) ELSE {_NORM} END)"
_SPAN_COUNTS = f"x AS (SELECT response_key, question_id, unnest(locations) AS x FROM c), s AS (SELECT DISTINCT response_key, question_id, {_SPAN} AS span FROM x), k AS (SELECT span, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT question_id) AS BIGINT) AS n_questions FROM s WHERE span <> '' GROUP BY 1)"


@query(f"WITH {C}, {_SPAN_COUNTS} SELECT span, n, n_questions FROM k ORDER BY n DESC, span LIMIT 50")
def ag10_location_tally(spark: SparkSession, d: str) -> DataFrame:
    return tallies.top_spans(tallies.span_counts(corpus(spark, d, "question_id", "locations")), floor=1, cap=50)


@query(f"WITH {C}, {_SPAN_COUNTS} SELECT span, n, n_questions FROM k")
def ag16_span_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tallies.span_counts(corpus(spark, d, "question_id", "locations"))


@query(f"WITH {C}, {_SPAN_COUNTS} SELECT CAST(count(*) AS BIGINT) AS n_spans, CAST(count(*) FILTER (n < 2) AS BIGINT) AS n_below, CAST(greatest(count(*) - count(*) FILTER (n < 2) - 20, 0) AS BIGINT) AS n_over_cap FROM k")
def ag17_span_report(spark: SparkSession, d: str) -> DataFrame:
    return tallies.span_report(tallies.span_counts(corpus(spark, d, "question_id", "locations")), cap=20)


@query(
    f"WITH {C}, f AS (SELECT len(time_context) > 0 AS m, {_DAY} AS a, {_NIGHT} AS b FROM c) "
    "SELECT CAST(count(*) FILTER (m) AS BIGINT) AS mentioned, CAST(count(*) FILTER (a) AS BIGINT) AS day, CAST(count(*) FILTER (b) AS BIGINT) AS night, CAST(count(*) FILTER (a AND b) AS BIGINT) AS both, CAST(count(*) FILTER (a OR b) AS BIGINT) AS day_or_night FROM f"
)
def ag11_time_tally(spark: SparkSession, d: str) -> DataFrame:
    return tallies.time_tally(corpus(spark, d, "time_context"))


def _selected_sql(field: str) -> str:
    return f"respondent_key IN (SELECT respondent_key FROM a WHERE field = '{field}' AND value IN ({', '.join(repr(v) for v in SELECTED[field])}))"


@query(
    f"WITH {A} SELECT field, value, CAST(count(DISTINCT respondent_key) AS BIGINT) AS n FROM a WHERE "
    + " AND ".join(f"(field = '{f}' OR {_selected_sql(f)})" for f in SELECTED)
    + " GROUP BY ALL"
)
def ag13_facets(spark: SparkSession, d: str) -> DataFrame:
    return tallies.facets(attributes(spark, d), SELECTED)


@query(f"WITH {A} SELECT CAST(count(DISTINCT respondent_key) AS BIGINT) AS n_matching FROM a WHERE " + " AND ".join(_selected_sql(f) for f in SELECTED))
def ag13_facet_total(spark: SparkSession, d: str) -> DataFrame:
    return tallies.facet_total(attributes(spark, d), SELECTED)


@query(f"WITH {A} SELECT field, value, CAST(count(DISTINCT respondent_key) AS BIGINT) AS n FROM a GROUP BY ALL")
def ag14_attribute_counts(spark: SparkSession, d: str) -> DataFrame:
    return tallies.attribute_counts(attributes(spark, d))


_PARSED = "coalesce(try_strptime(split_part(v, ' ', 1), '%Y-%m-%d'), try_strptime(split_part(v, ' ', 1), '%m/%d/%Y'))"


def _by_period(label: str) -> str:
    return f"WITH {A}, p AS (SELECT field, respondent_key, {_PARSED.replace('v,', 'value,')} AS day FROM a WHERE field = 'Survey date') SELECT field, {label} AS period, CAST(count(DISTINCT respondent_key) AS BIGINT) AS n FROM p WHERE day IS NOT NULL GROUP BY ALL"


def _survey_days(spark: SparkSession, d: str) -> DataFrame:
    return attributes(spark, d).where("field = 'Survey date'").withColumn("day", parse_date(F.col("value"))).where("day IS NOT NULL")


@query(_by_period("year(day) || ' Q' || quarter(day)"))
def ag15_quarters(spark: SparkSession, d: str) -> DataFrame:
    return tallies.period_counts(_survey_days(spark, d), bucket_label(F.col("day"), "quarter"))


@query(_by_period("strftime(day, '%Y-%m')"))
def dt02_months(spark: SparkSession, d: str) -> DataFrame:
    return tallies.period_counts(_survey_days(spark, d), bucket_label(F.col("day"), "month"))


@query(_by_period("CAST(year(day) AS VARCHAR)"))
def dt02_years(spark: SparkSession, d: str) -> DataFrame:
    return tallies.period_counts(_survey_days(spark, d), bucket_label(F.col("day"), "year"))


@query(_by_period("CASE " + " ".join(f"WHEN CAST(day AS DATE) BETWEEN DATE '{p['start']}' AND DATE '{p['end']}' THEN '{p['label']}'" for p in PERIODS) + " ELSE '(unlabeled)' END"))
def dt03_named_periods(spark: SparkSession, d: str) -> DataFrame:
    return tallies.period_counts(_survey_days(spark, d), period_label(F.col("day"), periods(PERIODS)))


@query(f"WITH {A} SELECT value, strftime({_PARSED.replace('v,', 'value,')}, '%Y-%m-%d') AS iso, CAST(count(*) AS BIGINT) AS n FROM a WHERE field = 'Survey date' GROUP BY ALL")
def dt01_parse_dates(spark: SparkSession, d: str) -> DataFrame:
    return attributes(spark, d).where("field = 'Survey date'").groupBy("value", parse_date(F.col("value")).cast("string").alias("iso")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || ' Q' || quarter(o_orderdate) AS period, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1")
def dt02_order_quarters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders", "o_orderdate", "o_custkey").groupBy(bucket_label(F.col("o_orderdate"), "quarter").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


_STOP = ["the", "and", "for", "that", "with", "has", "are", "you", "und", "die", "der", "que", "les", "des"]
_WORDS = "list_filter(regexp_extract_all(lower(response_text), '([a-z][a-z''-]{2,})', 1), lambda w: w NOT IN (" + ", ".join(f"'{s}'" for s in _STOP) + "))"


@query(
    f"WITH {C}, w AS (SELECT {_WORDS} AS w FROM c), b AS (SELECT 'word' AS kind, unnest(w) AS term FROM w UNION ALL SELECT 'pair', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w), "
    "n AS (SELECT kind, term, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL HAVING count(*) >= 4) SELECT kind, term, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS INT) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) <= CASE WHEN kind = 'pair' THEN 80 ELSE 120 END"
)
def ag18_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs over the responses of all datasets."""
    return tallies.terms(corpus(spark, d, "response_text"), "response_text", _STOP)


@query(
    f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (uncategorized IS NOT NULL) AS BIGINT) AS labelled, CAST(count(*) FILTER (uncategorized) AS BIGINT) AS uncategorized, CAST(sum(len(label_ids)) FILTER (uncategorized IS NOT NULL AND len(label_ids) > 0) AS BIGINT) AS sum_labels, "
    "CAST(count(*) FILTER (uncategorized IS NOT NULL AND len(label_ids) > 0) AS BIGINT) AS with_labels, CAST(count(*) FILTER (uncategorized IS NOT NULL AND coalesce(len(label_ids), 0) = 0) AS BIGINT) AS zero_labels, CAST(count(*) FILTER (event_occurred) AS BIGINT) AS events FROM c"
)
def ag19_run_report(spark: SparkSession, d: str) -> DataFrame:
    return tallies.run_report(corpus(spark, d, "uncategorized", "label_ids", "event_occurred"))


@query(f"WITH {C} SELECT coalesce(CAST(fit AS VARCHAR), '(missing)') AS value, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1")
def ag19_fit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tallies.histogram(corpus(spark, d, "fit"), "fit")


@query(f"WITH {C} SELECT coalesce(actionability, '(missing)') AS value, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1")
def ag19_actionability_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tallies.histogram(corpus(spark, d, "actionability"), "actionability")


@query(f"WITH {C} SELECT question_id, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1")
def ag24_question_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "question_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(floor(quantile_cont(value, 0.1) * 1000 + 0.5) AS BIGINT) AS p10, CAST(floor(quantile_cont(value, 0.5) * 1000 + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(value, 0.9) * 1000 + 0.5) AS BIGINT) AS p90 FROM events GROUP BY 1")
def ag27_percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = estimate.spread(read(spark, d, "events", "event_type", "value"), "value", ["event_type"])
    return s.select("event_type", *[F.floor(F.col(c) * 1000 + 0.5).alias(c) for c in ("p10", "p50", "p90")])


@query(
    "WITH r AS (SELECT dataset_id, max_by(row_count, row_offset) AS base, max_by(coalesce(new_row_count, 0), row_offset) AS amount FROM uploads GROUP BY 1) "
    "SELECT CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(base) AS BIGINT) AS base, CAST(count(*) AS BIGINT) AS n_runs, base >= 300 AS is_large FROM r WHERE base >= 200 GROUP BY is_large"
)
def ag26_pooled_rates(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "uploads", "dataset_id", "row_offset", F.col("row_count").alias("base"), F.coalesce("new_row_count", F.lit(0)).alias("amount"))
    newest = estimate.newest_runs(runs, ["dataset_id"], "row_offset").withColumn("is_large", F.col("base") >= 300)
    return estimate.pooled_rates(newest, "amount", "base", ["is_large"])


@query("WITH p(model, price_in, price_out) AS (VALUES ('click', 2, 8), ('view', 1, 4)), t AS (SELECT event_type AS model, count(*) AS calls, sum(user_id) AS i, sum(event_id) AS o FROM events GROUP BY 1) SELECT model, CAST(calls AS BIGINT) AS calls, CAST(i AS BIGINT) AS tokens_in, CAST(o AS BIGINT) AS tokens_out, CAST(i * price_in + o * price_out AS BIGINT) AS micro_usd, price_in IS NULL AS is_unpriced FROM t LEFT JOIN p USING (model)")
def ag29_usage(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 2, 8), ("view", 1, 4)], "model string, price_in long, price_out long")
    calls = read(spark, d, "events", F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"))
    return estimate.usage(calls, prices)


@query("SELECT dataset_id, upload_id, CAST(row_number() OVER w AS INT) AS position, CASE WHEN row_number() OVER w = 1 THEN 'created' ELSE 'appended' END AS kind FROM uploads WINDOW w AS (PARTITION BY dataset_id ORDER BY row_offset, upload_id)")
def ag31_upload_history(spark: SparkSession, d: str) -> DataFrame:
    return matching.history(read(spark, d, "uploads", "dataset_id", "upload_id", "row_offset")).drop("row_offset")


@query("SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(count(*) FILTER (new_row_count IS NULL) AS BIGINT) AS n_unpriced, CASE WHEN count(*) FILTER (new_row_count IS NULL) = 0 THEN CAST(sum(new_row_count) AS BIGINT) END AS total, CAST(floor(sum(new_row_count) * 80 / 100) AS BIGINT) AS low, CAST(ceil(sum(new_row_count) * 130 / 100) AS BIGINT) AS high FROM uploads")
def ag32_estimate_total(spark: SparkSession, d: str) -> DataFrame:
    return estimate.total_estimate(read(spark, d, "uploads", F.col("new_row_count").alias("micro_usd")))


@query(f"WITH {C}, {M}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1) SELECT label_id, CAST(n AS BIGINT) AS n, CAST(ceil(n / 20) AS BIGINT) AS induce_calls, CAST(ceil(n / 60) AS BIGINT) AS label_calls, 1 AS review_calls FROM n WHERE n >= 40")
def ag36_sub_theme_plan(spark: SparkSession, d: str) -> DataFrame:
    return estimate.sub_theme_plan(ag02_members_by_label(spark, d), 40, 20, 60)


@query(
    f"WITH {C}, u AS (SELECT question_id, response_text, count(*) AS k FROM c WHERE response_text IS NOT NULL GROUP BY ALL), s AS (SELECT question_id, CAST(sum(k) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_unique, CAST(sum(length(response_text)) AS BIGINT) AS chars, CAST(ceil(count(*) / 60) AS BIGINT) AS calls FROM u GROUP BY 1) "
    "SELECT *, CAST(ceil((chars + calls * 2000) / 4) AS BIGINT) AS tokens_in FROM s"
)
def ag39_label_plan(spark: SparkSession, d: str) -> DataFrame:
    return estimate.label_plan(corpus(spark, d, "question_id", "response_text").where("response_text IS NOT NULL"), ["question_id"], "response_text", 60, 2000)


# ---- filters -------------------------------------------------------------------------------------------------------------------

FILTERS = filters.Filters(labels=SCOPE, actionability="specific", time="night", demographics={"Age band": ("18-24", "25-34", "35-54"), "Tenure": ("Rent", "Own")})


@query(f"WITH {C}, {M} SELECT DISTINCT response_key FROM m WHERE label_id IN {_TUPLE}")
def ev01_scope(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "label_ids").where(filters.in_scope(filters.Filters(labels=SCOPE))).select("response_key")


@query(f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS location_in_scope, CAST(count(*) FILTER (uncategorized IS NOT NULL) AS BIGINT) AS location_coded, CAST(count(*) FILTER (uncategorized IS NOT NULL AND (coalesce(list_has_any(list_transform(locations, lambda x: lower(x)), ['ulstead park', 'corodale']), false) OR question_id = 4)) AS BIGINT) AS location_matching, CAST(count(*) FILTER (uncategorized IS NOT NULL AND (coalesce(list_has_any(list_transform(locations, lambda x: lower(x)), ['ulstead park', 'corodale']), false) OR question_id = 4)) AS BIGINT) AS n FROM c")
def ev02_location_filter(spark: SparkSession, d: str) -> DataFrame:
    f = filters.Filters(places=("Ulstead Park", "Corodale"), implicit_questions=(4,))
    return filters.denominators(corpus(spark, d, "question_id", "uncategorized", "locations"), f)


@query(f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS actionability_in_scope, CAST(count(actionability) AS BIGINT) AS actionability_coded, CAST(count(*) FILTER (actionability = 'specific') AS BIGINT) AS actionability_matching, CAST(count(*) FILTER (actionability = 'specific') AS BIGINT) AS n FROM c")
def ev03_actionability(spark: SparkSession, d: str) -> DataFrame:
    return filters.denominators(corpus(spark, d, "actionability"), filters.Filters(actionability="specific"))


@query(f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS event_in_scope, CAST(count(uncategorized) AS BIGINT) AS event_coded, CAST(count(*) FILTER (event_occurred AND uncategorized IS NOT NULL) AS BIGINT) AS event_matching, CAST(count(*) FILTER (event_occurred AND uncategorized IS NOT NULL) AS BIGINT) AS n FROM c")
def ev04_event(spark: SparkSession, d: str) -> DataFrame:
    return filters.denominators(corpus(spark, d, "uncategorized", "event_occurred"), filters.Filters(event=True))


@query(f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS time_in_scope, CAST(count(*) FILTER (len(time_context) > 0) AS BIGINT) AS time_coded, CAST(count(*) FILTER ({_DAY}) AS BIGINT) AS time_matching, CAST(count(*) FILTER ({_DAY}) AS BIGINT) AS n FROM c")
def ev05_time(spark: SparkSession, d: str) -> DataFrame:
    return filters.denominators(corpus(spark, d, "time_context"), filters.Filters(time="day"))


_DEMO_HAS = "respondent_key IN (SELECT respondent_key FROM a WHERE field = 'Age band') AND respondent_key IN (SELECT respondent_key FROM a WHERE field = 'Tenure')"
_DEMO_FITS = "respondent_key IN (SELECT respondent_key FROM a WHERE field = 'Age band' AND value IN ('18-24', '25-34', '35-54')) AND respondent_key IN (SELECT respondent_key FROM a WHERE field = 'Tenure' AND value IN ('Rent', 'Own'))"


@query(f"WITH {C}, {A} SELECT CAST(count(*) AS BIGINT) AS demographic_in_scope, CAST(count(*) FILTER ({_DEMO_HAS}) AS BIGINT) AS demographic_coded, CAST(count(*) FILTER ({_DEMO_FITS}) AS BIGINT) AS demographic_matching, CAST(count(*) FILTER ({_DEMO_FITS}) AS BIGINT) AS n FROM c")
def ev06_demographic(spark: SparkSession, d: str) -> DataFrame:
    c = filters.with_attributes(corpus(spark, d, "respondent_key"), attributes(spark, d))
    return filters.denominators(c, filters.Filters(demographics=FILTERS.demographics))


@query(
    f"WITH {C}, {A}, f AS (SELECT list_has_any(label_ids, {_LIST}) AS s, actionability, len(time_context) > 0 AS tm, {_NIGHT} AS ng, {_DEMO_HAS} AS dh, {_DEMO_FITS} AS df FROM c) SELECT "
    "CAST(count(*) FILTER (s) AS BIGINT) AS actionability_in_scope, CAST(count(*) FILTER (s AND actionability IS NOT NULL) AS BIGINT) AS actionability_coded, CAST(count(*) FILTER (s AND actionability = 'specific') AS BIGINT) AS actionability_matching, "
    "CAST(count(*) FILTER (s AND actionability = 'specific') AS BIGINT) AS time_in_scope, CAST(count(*) FILTER (s AND actionability = 'specific' AND tm) AS BIGINT) AS time_coded, CAST(count(*) FILTER (s AND actionability = 'specific' AND tm AND ng) AS BIGINT) AS time_matching, "
    "CAST(count(*) FILTER (s AND actionability = 'specific' AND tm AND ng) AS BIGINT) AS demographic_in_scope, CAST(count(*) FILTER (s AND actionability = 'specific' AND tm AND ng AND dh) AS BIGINT) AS demographic_coded, CAST(count(*) FILTER (s AND actionability = 'specific' AND tm AND ng AND df) AS BIGINT) AS demographic_matching, "
    "CAST(count(*) FILTER (s AND actionability = 'specific' AND tm AND ng AND df) AS BIGINT) AS n FROM f"
)
def ev_chain_denominators(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "respondent_key", "label_ids", "actionability", "time_context", "uncategorized", "locations", "event_occurred", "question_id")
    return filters.denominators(filters.with_attributes(c, attributes(spark, d)), FILTERS)


@query(f"WITH {C} SELECT response_key, {_DAY} AS is_day, {_NIGHT} AS is_night FROM c WHERE len(time_context) > 0")
def ev07_time_classifier(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "time_context").where(F.size("time_context") > 0)
    return c.select("response_key", filters.is_day(F.col("time_context")).alias("is_day"), filters.is_night(F.col("time_context")).alias("is_night"))


@query(f"WITH {C} SELECT response_key FROM c WHERE question_id IN (4, 9) AND list_has_any(label_ids, {_LIST})")
def ev09_question_scope(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "question_id", "label_ids").where(filters.in_scope(filters.Filters(labels=SCOPE, questions=(4, 9)))).select("response_key")


@query(f"WITH {C} SELECT question_id, CAST(count(*) FILTER (coalesce(uncategorized, false) OR coalesce(fit = 1, false)) AS BIGINT) AS n_uncovered FROM c GROUP BY 1")
def ev10_uncovered(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "question_id", "uncategorized", "fit").groupBy("question_id").agg(F.count_if(filters.is_uncovered(F.col("uncategorized"), F.col("fit"))).alias("n_uncovered"))


@query(f"WITH {C}, {M} SELECT label_id, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1 HAVING count(*) >= 40")
def ev11_eligible(spark: SparkSession, d: str) -> DataFrame:
    return filters.eligible(ag02_members_by_label(spark, d), 40)


# ---- sets ----------------------------------------------------------------------------------------------------------------------


def _keys(spark: SparkSession, d: str, label: str) -> DataFrame:
    return corpus(spark, d, "label_ids").where(F.array_contains("label_ids", label)).select("response_key")


_K = "a1 AS (SELECT response_key FROM c WHERE list_contains(label_ids, '4_001')), b1 AS (SELECT response_key FROM c WHERE list_contains(label_ids, '4_002'))"


@query(f"WITH {C}, {_K} SELECT response_key FROM a1 UNION SELECT response_key FROM b1")
def se01_union(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, "4_001").union(_keys(spark, d, "4_002")).distinct()


@query(f"WITH {C}, {_K} SELECT response_key FROM a1 INTERSECT SELECT response_key FROM b1")
def se02_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, "4_001").join(_keys(spark, d, "4_002"), "response_key", "left_semi")


@query(f"WITH {C}, {_K} SELECT response_key FROM a1 EXCEPT SELECT response_key FROM b1")
def se03_difference(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, "4_001").join(_keys(spark, d, "4_002"), "response_key", "left_anti")


@query("WITH f AS (SELECT lower(row_hash) AS h, count(*) AS n FROM row_hashes WHERE is_duplicate IS NULL GROUP BY 1), s AS (SELECT lower(row_hash) AS h, count(*) AS n FROM row_hashes WHERE is_duplicate IS NOT NULL GROUP BY 1) SELECT CAST(coalesce(sum(least(f.n, s.n)), 0) AS BIGINT) AS n_common FROM f JOIN s USING (h)")
def se04_multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "row_hashes", F.lower("row_hash").alias("h"), "is_duplicate")
    side = lambda cond, n: matching.multiset(h.where(cond), ["h"]).withColumnRenamed("n", n)
    return side("is_duplicate IS NULL", "a").join(side("is_duplicate IS NOT NULL", "b"), "h").agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("n_common"))


@query(f"WITH {C}, {M}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1), s AS (SELECT label_id FROM n QUALIFY row_number() OVER (ORDER BY n DESC, label_id) > 8) SELECT CAST(count(DISTINCT response_key) AS BIGINT) AS everything_else FROM m SEMI JOIN s USING (label_id)")
def se05_everything_else(spark: SparkSession, d: str) -> DataFrame:
    """The union of all categories but the eight largest: the top eight are a bounded list, everything else an anti join."""
    m = corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids"))
    top = m.groupBy("label_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label_id").limit(8)
    return m.join(top.select("label_id"), "label_id", "left_anti").agg(F.count_distinct("response_key").alias("everything_else"))


@query(f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS in_scope, CAST(count(*) FILTER (uncategorized IS NOT NULL) AS BIGINT) AS coded, CAST(count(*) FILTER (event_occurred) AS BIGINT) AS reported FROM c")
def ag12_event_tally(spark: SparkSession, d: str) -> DataFrame:
    return tallies.event_tally(corpus(spark, d, "uncategorized", "event_occurred"))


@query(
    f"WITH {C}, {M}, h AS (SELECT response_key, label_id, label_id || 's' || lpad(CAST(source_row_index % 3 AS VARCHAR), 2, '0') AS sub_id, c.source_row_index % 4 = 0 AS is_generic FROM m JOIN c USING (response_key)) "
    "SELECT label_id, CAST(count(*) AS BIGINT) AS coded, CAST(count(*) FILTER (is_generic) AS BIGINT) AS generic, CAST(count(DISTINCT sub_id) FILTER (NOT is_generic) AS BIGINT) AS n_subs FROM h GROUP BY 1"
)
def ag07_sub_theme_counts(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "dataset_id", "question_id", "source_row_index", "label_ids")
    m = corpora.members(c)
    sub = F.concat("label_id", F.lit("s"), F.lpad((F.col("source_row_index") % 3).cast("string"), 2, "0"))
    subs = m.join(c.where("source_row_index % 4 <> 0").select("response_key", "source_row_index"), "response_key").select("response_key", "label_id", sub.alias("sub_id"))
    return tallies.sub_theme_counts(m, subs)


@query(
    "WITH z AS (SELECT p_size AS s, median(p_retailprice) AS v FROM part GROUP BY 1), w AS (SELECT DISTINCT p_size * 3 AS w FROM part), "
    "b AS (SELECT w, max(z.s) FILTER (z.s <= w) AS lo, min(z.s) FILTER (z.s >= w) AS hi FROM w, z GROUP BY 1) "
    "SELECT w AS wanted, CAST(floor(CASE WHEN lo < hi THEN a.v + (log10(w) - log10(lo)) / (log10(hi) - log10(lo)) * (e.v - a.v) ELSE coalesce(a.v, e.v) END + 0.5) AS BIGINT) AS estimate FROM b LEFT JOIN z a ON a.s = lo LEFT JOIN z e ON e.s = hi"
)
def ag28_interpolated_cost(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part", "p_size", "p_retailprice")
    got = estimate.interpolated(part, part.select((F.col("p_size") * 3).alias("p_size")).distinct(), "p_size", "p_retailprice")
    return got.select(F.col("at").alias("wanted"), F.floor(F.col("estimate") + 0.5).alias("estimate"))


@query(
    f"WITH {C}, {M}, {T}, e AS (SELECT question_id, label_id, source_row_index // 40 AS chunk FROM (SELECT question_id, source_row_index, unnest(label_ids) AS label_id FROM c)), l AS (SELECT question_id, label_id, count(DISTINCT chunk) AS k, count(*) AS n FROM e GROUP BY ALL), "
    "r AS (SELECT question_id, sum(n) AS candidates, count(*) AS labels, count(*) FILTER (k = 1) AS singletons FROM l GROUP BY 1), h AS (SELECT question_id, count(DISTINCT source_row_index // 40) AS chunks FROM c WHERE len(label_ids) > 0 GROUP BY 1), p AS (SELECT question_id, count(DISTINCT parent_id) AS parents FROM t GROUP BY 1) "
    "SELECT question_id, candidates BETWEEN 8 * chunks AND 35 * chunks AS candidates_ok, 10 * candidates BETWEEN 12 * labels AND 35 * labels AS compression_ok, 100 * singletons <= 40 * labels AS singletons_ok, parents BETWEEN 3 AND 9 AS parents_ok FROM r JOIN h USING (question_id) JOIN p USING (question_id)"
)
def ag38_induction_quality(spark: SparkSession, d: str) -> DataFrame:
    """All four bands from what a run leaves: candidates, chunks, support and parents."""
    c = corpus(spark, d, "dataset_id", "question_id", "source_row_index", "label_ids")
    each = c.select("question_id", F.floor(F.col("source_row_index") / 40).alias("chunk"), F.explode("label_ids").alias("label_id"))
    per = each.groupBy("question_id", "label_id").agg(F.count_distinct("chunk").alias("k"), F.count(F.lit(1)).alias("n"))
    report = per.groupBy("question_id").agg(F.sum("n").alias("candidates"), F.count(F.lit(1)).alias("labels"), F.count_if(F.col("k") == 1).alias("singletons"))
    chunks = each.groupBy("question_id").agg(F.count_distinct("chunk").alias("chunks"))
    parents = corpora.taxonomy(c).groupBy("question_id").agg(F.count_distinct("parent_id").alias("parents"))
    return estimate.induction_quality(report.join(chunks, "question_id").join(parents, "question_id"))


@query(f"WITH {A}, v AS (SELECT field, CASE WHEN field = 'Survey date' THEN strftime({_PARSED.replace('v,', 'value,')}, '%Y-%m-%d') ELSE value END AS value FROM a) SELECT field, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct, count(DISTINCT value) > 100 AS is_high FROM v GROUP BY 1")
def ag25_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Days count once whatever their notation."""
    return tallies.cardinality(attributes(spark, d), dates=("Survey date",))


@query("WITH f AS (SELECT dataset_id AS root, upload_id, row_count AS size, CASE WHEN new_row_count IS NOT NULL THEN stored_filename END AS run_id, new_row_count AS micro_usd FROM uploads) SELECT root, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, CAST(count(DISTINCT run_id) AS BIGINT) AS n_runs, CAST(sum(micro_usd) AS BIGINT) AS micro_usd FROM f GROUP BY 1")
def ag30_deletion_preview(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "uploads", "dataset_id", "stored_filename", "row_count", "new_row_count")
    return tallies.deletion_preview(u.select(F.col("dataset_id").alias("root"), F.col("stored_filename").alias("path"), F.col("row_count").alias("size"), F.when(F.col("new_row_count").isNotNull(), F.col("stored_filename")).alias("run_id"), F.col("new_row_count").alias("micro_usd")))


@query(f"WITH {C}, s AS (SELECT question_id, count(*) AS n, sum(length(response_text)) AS chars FROM c WHERE response_text IS NOT NULL GROUP BY 1), p AS (SELECT *, CAST(ceil(n / 120) AS BIGINT) AS map_calls FROM s), q AS (SELECT *, map_calls + CAST(ceil(map_calls * 20 / 120) AS BIGINT) + 2 AS calls FROM p) SELECT question_id, map_calls, calls, CAST(ceil((chars + calls * 3000) / 4) AS BIGINT) AS tokens_in, CAST(ceil((chars + calls * 3000) / 4) * 3 AS BIGINT) AS micro_usd, 'heuristic' AS basis FROM q")
def ag39_induction_plan(spark: SparkSession, d: str) -> DataFrame:
    s = corpus(spark, d, "question_id", "response_text").where("response_text IS NOT NULL").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("response_text")).alias("chars"))
    return estimate.induction_plan(s).select("question_id", "map_calls", "calls", "tokens_in", "micro_usd", "basis")
