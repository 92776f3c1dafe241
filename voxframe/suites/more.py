"""Queries that round off the inventory: scalar functions, examples, sub-theme records, streams as batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import corpus as corpora
from ..operators import estimate, labeling, matching, sampling, tallies, taxonomy
from ..plans import verify
from ..registry import query
from ..session import shared_table, ship_package
from .base import A, C, M, T, attributes, corpus, read
from .counts import _CONCEPT_SQL, _PARSED, _SPAN, _STOP, CONCEPTS, PERIODS

_HIT_ROWS = " UNION ALL ".join(f"SELECT question_id, response_key, '{n}' AS concept FROM c WHERE regexp_matches(response_text, '{s}')" for n, s in _CONCEPT_SQL.items())


@query(f"WITH {C}, x AS (SELECT DISTINCT unnest(locations) AS x FROM c) SELECT x AS span, {_SPAN} AS norm FROM x")
def pr10_normalized_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = corpus(spark, d, "locations").select(F.explode("locations").alias("span")).distinct()
    return spans.select("span", text.normalized_span(F.col("span")).alias("norm"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^\pL\pM\pN_])(?:bike\s+lane(?:e?s)?|library(?:e?s)?|bus(?:e?s)?)(?:$|[^\pL\pM\pN_])') AS hit FROM documents WHERE text IS NOT NULL")
def sf06_concept_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Every text; a letter beyond ASCII is part of a word in both engines."""
    docs = read(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.col("text").rlike(text.concept_pattern(["bus", "bike lane", "library"])).alias("hit"))


@query(r"WITH q AS (SELECT DISTINCT question_id, question_label FROM responses WHERE question_label IS NOT NULL) SELECT question_id, question_label, regexp_matches(question_label, '(?i)\bbus(?:e?s)?\b') AS buses, regexp_matches(question_label, '(?i)\bstreet(?:e?s)?\b') AS streets FROM q")
def sf07_query_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts a question itself names."""
    q = read(spark, d, "responses", "question_id", "question_label").where("question_label IS NOT NULL").distinct()
    return q.select("question_id", "question_label", *[F.col("question_label").rlike(text.concept_pattern([t])).alias(n) for n, t in (("buses", "bus"), ("streets", "street"))])


@query(f"WITH {C}, s AS (SELECT question_id, count(*) FILTER (event_occurred) AS part, count(uncategorized) AS whole FROM c GROUP BY 1) SELECT question_id, CAST(part AS BIGINT) AS part, CAST(whole AS BIGINT) AS whole, CASE WHEN whole > 0 THEN CAST(CASE WHEN (200 * part) % (2 * whole) = whole AND ((100 * part) // whole) % 2 = 0 THEN (100 * part) // whole ELSE (200 * part + whole) // (2 * whole) END AS BIGINT) END AS percent FROM s")
def sf11_percentages(spark: SparkSession, d: str) -> DataFrame:
    """Half to even, with the integers beside."""
    s = corpus(spark, d, "question_id", "uncategorized", "event_occurred").groupBy("question_id").agg(F.count_if(F.coalesce("event_occurred", F.lit(False))).alias("part"), F.count("uncategorized").alias("whole"))
    return s.withColumn("percent", estimate.rounded_share(F.col("part"), F.col("whole")).cast("long"))


@query("WITH p(event_type, rate) AS (VALUES ('click', 2), ('view', 4)) SELECT event_type, CAST(sum(event_id) AS BIGINT) AS tokens, CAST(sum(event_id) * max(rate) AS BIGINT) AS micro_usd FROM events LEFT JOIN p USING (event_type) GROUP BY 1")
def sf14_prices(spark: SparkSession, d: str) -> DataFrame:
    """What has no price costs an unknown amount, not nothing."""
    t = read(spark, d, "events", "event_type", "event_id").groupBy("event_type").agg(F.sum("event_id").alias("tokens"))
    rates = spark.createDataFrame([("click", 2_000_000), ("view", 4_000_000)], "event_type string, rate long")
    return t.join(rates, "event_type", "left").select("event_type", "tokens", F.round(estimate.price(F.col("tokens"), F.col("rate"))).cast("long").alias("micro_usd"))


@query(f"WITH {A}, p AS (SELECT CASE " + " ".join(f"WHEN CAST(day AS DATE) BETWEEN DATE '{p['start']}' AND DATE '{p['end']}' THEN {i}" for i, p in enumerate(PERIODS)) + f" ELSE {len(PERIODS)} END AS position, respondent_key FROM (SELECT respondent_key, {_PARSED.replace('v,', 'value,')} AS day FROM a WHERE field = 'Survey date') WHERE day IS NOT NULL) SELECT position, CAST(count(DISTINCT respondent_key) AS BIGINT) AS n FROM p GROUP BY 1")
def dt04_period_order(spark: SparkSession, d: str) -> DataFrame:
    named = dates.periods(PERIODS)
    days = attributes(spark, d).where("field = 'Survey date'").withColumn("day", dates.parse_date(F.col("value"))).where("day IS NOT NULL")
    at = dates.period_order(dates.period_label(F.col("day"), named), named)
    return days.groupBy(at.alias("position")).agg(F.count_distinct("respondent_key").alias("n"))


@query("SELECT dataset_id, max_by(upload_id, row_offset) AS upload_id FROM uploads GROUP BY 1")
def wn14_newest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return estimate.newest_runs(read(spark, d, "uploads", "dataset_id", "upload_id", "row_offset"), ["dataset_id"], "row_offset").drop("row_offset")


@query(f"WITH {C} SELECT question_id, CAST(count(*) AS BIGINT) AS n, CAST(count(uncategorized) AS BIGINT) AS labelled FROM c GROUP BY 1")
def sc11_latest_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Two runs per response, the later one counts."""
    c = corpus(spark, d, "question_id", "uncategorized")
    runs = c.withColumn("run_id", F.lit("r2")).unionByName(c.withColumns({"run_id": F.lit("r1"), "uncategorized": F.lit(True)}))
    return estimate.newest_runs(runs, ["response_key"]).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count("uncategorized").alias("labelled"))


@query("WITH e AS (SELECT event_id // 40 AS batch, CAST(row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) AS INT) AS position, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT CAST(batch AS BIGINT) AS batch, position, CASE WHEN position % 5 <> 0 AND k % 2 = 1 THEN '7_001s01' ELSE '' END AS sub_ids, position % 5 = 0 AS not_returned FROM e")
def pr20_sub_records(spark: SparkSession, d: str) -> DataFrame:
    """Sub-theme replies over every event, in batches of forty ids in a row: a row the reply leaves out is not returned, never generic."""
    e = read(spark, d, "events", "event_id", "props").select("event_id", F.expr("event_id div 40").alias("batch"), F.from_json("props", "k int")["k"].alias("k"))
    b = e.withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("event_id")))
    b = b.select(F.lit(7).cast("long").alias("question_id"), "batch", "position", F.col("event_id").cast("string").alias("response_key"), F.lit("").alias("text"), "k")
    record = F.struct(F.col("position").alias("number"), F.array(F.when(F.col("k") % 2 == 1, "7_001s01").otherwise("7_001s77")).alias("labels"), F.lit(9).alias("fit"))
    replies = b.groupBy("question_id", "batch").agg(F.to_json(F.struct(F.collect_list(F.when(F.col("position") % 5 != 0, record)).alias("results"))).alias("reply"))
    known = spark.createDataFrame([(7, "7_001s01"), (7, "7_001s02")], "question_id long, label_id string")
    return labeling.parse_labels(b.drop("k"), replies, known).select("batch", "position", F.array_join("label_ids", ",").alias("sub_ids"), "not_returned")


@query("WITH h AS (SELECT DISTINCT dataset_id, upload_id, row_index, lower(row_hash) AS h FROM row_hashes), o AS (SELECT h.*, u.row_offset FROM h JOIN uploads u USING (dataset_id, upload_id)), f AS (SELECT *, min(row_offset) OVER (PARTITION BY dataset_id) AS first FROM o), s AS (SELECT dataset_id, h, count(*) AS n FROM f WHERE row_offset = first GROUP BY ALL), k AS (SELECT f.*, row_number() OVER (PARTITION BY dataset_id, h ORDER BY row_index) AS k FROM f WHERE row_offset > first) SELECT k.dataset_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (k <= coalesce(s.n, 0)) AS BIGINT) AS n_held FROM k LEFT JOIN s ON s.dataset_id = k.dataset_id AND s.h = k.h GROUP BY 1")
def st01_append_waves(spark: SparkSession, d: str) -> DataFrame:
    """All later files of a dataset as one wave against its first file, as multisets."""
    h = read(spark, d, "row_hashes", "dataset_id", "upload_id", "row_index", F.lower("row_hash").alias("row_hash")).distinct()
    at = h.join(read(spark, d, "uploads", "dataset_id", "upload_id", "row_offset"), ["dataset_id", "upload_id"])
    first = at.groupBy("dataset_id").agg(F.min("row_offset").alias("first"))
    placed = at.join(first, "dataset_id")
    wave = placed.where("row_offset > first").select("dataset_id", "row_index", "row_hash")
    flagged = matching.flag_duplicates(wave, placed.where("row_offset = first"), ["dataset_id"])
    return flagged.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_duplicate").alias("n_held"))


@query("SELECT CAST(year(ts) AS VARCHAR) || ' Q' || quarter(ts) AS period, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def st04_event_periods(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events", "ts", "event_type").groupBy(dates.bucket_label(F.col("ts"), "quarter").alias("period"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT region, CAST(count(*) AS BIGINT) AS n_customers, CAST(sum(n_orders) AS BIGINT) AS n_orders FROM (SELECT r_name AS region, c_custkey, count(o_orderkey) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
def jn01_star_join(spark: SparkSession, d: str) -> DataFrame:
    """The shape of a left join over dimension tables: orders are counted per customer before they are joined."""
    nations = read(spark, d, "nation", "n_nationkey", "n_regionkey").join(read(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read(spark, d, "customer", "c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n_customers"), F.sum(F.coalesce("k", F.lit(0))).alias("n_orders"))


@query()
def jn13_sweep_106(spark: SparkSession, d: str) -> DataFrame:
    """The published sweep's shape: 106 place concepts over the corpus, in one scan.

    The concepts are the 106 most frequent spans, a bounded list.
    """
    c = shared_table(corpus(spark, d, "question_id", "response_text", "locations"))  # deliveries are reduced once for both passes
    spans = [r[0] for r in tallies.top_spans(tallies.span_counts(c), floor=1, cap=106).collect()]
    return tallies.concept_matches(c, {s: [s] for s in spans}).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_size, CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) / 7) AS BIGINT) AS calls, CAST(count(*) // 7 AS BIGINT) AS whole, CAST(count(*) % 7 AS BIGINT) AS rest FROM part GROUP BY 1")
def sf12_integer_division(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "part", "p_size").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    calls, whole, rest = estimate.divided(F.col("n"), 7)
    return n.select("p_size", "n", calls.alias("calls"), whole.alias("whole"), rest.alias("rest"))


@query(f"WITH {C}, {M}, i AS (SELECT question_id, CASE WHEN CAST(split_part(label_id, '_', 2) AS INT) % 3 = 0 THEN question_id || '_i' || split_part(label_id, '_', 2) ELSE label_id END AS label_id FROM m) SELECT question_id, CAST(max(coalesce(TRY_CAST(nullif(regexp_extract(label_id, '^\\d+_i(\\d+)$', 1), '') AS INT), 0)) AS INT) AS last FROM i GROUP BY 1")
def sf15_last_sequence(spark: SparkSession, d: str) -> DataFrame:
    m = corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids"))
    number = F.split("label_id", "_")[1]
    ids = m.select("question_id", F.when(number.cast("int") % 3 == 0, F.concat(F.col("question_id").cast("string"), F.lit("_i"), number)).otherwise(F.col("label_id")).alias("label_id"))
    return taxonomy.last_sequence(ids)


@query(f"WITH {C}, n AS (SELECT question_id, count(*) AS a, count(uncategorized) AS b, count(*) FILTER (event_occurred) AS e FROM c GROUP BY 1), v AS (SELECT question_id, unnest([a, b, e]) AS v FROM n) SELECT DISTINCT question_id, CAST(v AS BIGINT) AS number FROM v UNION SELECT x.question_id, CAST(x.v - y.v AS BIGINT) FROM v x JOIN v y ON x.question_id = y.question_id AND x.v > y.v")
def sf18_legitimate_numbers(spark: SparkSession, d: str) -> DataFrame:
    """All counts of a question and their differences."""
    n = corpus(spark, d, "question_id", "uncategorized", "event_occurred").groupBy("question_id").agg(F.count(F.lit(1)).alias("a"), F.count("uncategorized").alias("b"), F.count_if(F.coalesce("event_occurred", F.lit(False))).alias("e"))
    return verify.legitimate_numbers(n, ["question_id"], ["a", "b", "e"])


@query(f"WITH {C}, {M}, x AS (SELECT label_id, response_key, CAST(split_part(response_key, ':', 3) AS INT) % 3 AS pool FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY label_id, pool ORDER BY response_key) AS pos FROM x), o AS (SELECT label_id, response_key, row_number() OVER (PARTITION BY label_id ORDER BY pos, pool) AS r FROM r) SELECT label_id, string_agg(response_key, ',' ORDER BY r) AS examples FROM o WHERE r <= 6 GROUP BY 1")
def wn13_round_robin_examples(spark: SparkSession, d: str) -> DataFrame:
    """Six examples per label, one from each pool in turn."""
    m = corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids")).withColumn("pool", F.split("response_key", ":")[2].cast("int") % 3)
    return sampling.round_robin(m, 6).withColumn("examples", F.array_join("examples", ","))


_WINDOWS = "SELECT dataset_id, survey_start_date AS s, CASE WHEN dataset_id % 3 = 0 THEN CAST(CAST(survey_start_date AS DATE) - 1 AS VARCHAR) ELSE survey_end_date END AS e FROM datasets"


@query(f"SELECT dataset_id, s IS NULL OR e IS NULL OR e >= s AS is_valid FROM ({_WINDOWS})")
def dt06_fielding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows as the table has them, every third one reversed; the check itself decides."""

    def valid(pdf: pd.DataFrame) -> pd.Series:
        def one(s: str | None, e: str | None) -> bool:
            try:
                dates.check_window(s, e)
            except ValueError:
                return False
            return True

        return pd.Series([one(s, e) for s, e in zip(pdf["s"], pdf["e"])])

    ship_package(spark)
    rows = read(spark, d, "datasets", "dataset_id", "survey_start_date", "survey_end_date")
    end = F.when(F.col("dataset_id") % 3 == 0, F.date_sub(F.col("survey_start_date").cast("date"), 1).cast("string")).otherwise(F.col("survey_end_date"))
    each = rows.select("dataset_id", F.col("survey_start_date").alias("s"), end.alias("e"))
    return each.mapInPandas(lambda parts: (p[["dataset_id"]].assign(is_valid=valid(p.astype(object).where(p.notna(), None))) for p in parts), "dataset_id long, is_valid boolean")


@query(
    f"WITH {C}, {M}, {T}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1), s AS (SELECT t.question_id, CAST(count(*) AS BIGINT) AS n_labels, CAST(count(n.n) AS BIGINT) AS n_used, CAST(max(n.n) AS BIGINT) AS largest FROM t LEFT JOIN n USING (label_id) GROUP BY 1), "
    f"h AS ({_HIT_ROWS}), k AS (SELECT question_id, count(DISTINCT concept) AS nc, count(DISTINCT response_key) AS nr FROM h GROUP BY 1), p AS (SELECT question_id, response_key, lower(trim(unnest(locations))) AS place FROM c), q AS (SELECT question_id, count(DISTINCT place) AS nc, count(DISTINCT response_key) AS nr FROM p GROUP BY 1) "
    "SELECT s.*, CAST(coalesce(k.nc, 0) AS BIGINT) AS n_concepts, CAST(coalesce(k.nr, 0) AS BIGINT) AS concepts_responses, CAST(coalesce(q.nc, 0) AS BIGINT) AS n_places, CAST(coalesce(q.nr, 0) AS BIGINT) AS places_responses FROM s LEFT JOIN k USING (question_id) LEFT JOIN q USING (question_id)"
)
def ag37_dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """One grouped plan for all questions, with what their concepts and places reach."""
    c = corpus(spark, d, "dataset_id", "question_id", "label_ids", "locations", "response_text")
    hits = tallies.concept_matches(c, CONCEPTS).select("question_id", "response_key", "concept")
    places = c.select("question_id", "response_key", F.explode(F.transform("locations", lambda x: F.lower(F.trim(x)))).alias("concept"))
    return tallies.dataset_summary(corpora.members(c), corpora.taxonomy(c), hits, places)


@query()
def tx13_fused_plan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every question's categories as the lines of a plan; no SQL, as complete linkage is greedy (tested against a literal loop)."""
    from .models import _named_taxonomy

    lines = _named_taxonomy(spark, d).where("name IS NOT NULL").select(F.col("question_id").alias("plan_id"), F.col("label_id").alias("position"), "label_id", "name")
    return taxonomy.fused_lines(lines)


@query()
def ag18_proper_nouns(spark: SparkSession, d: str) -> DataFrame:
    """Names and acronyms over all responses; no SQL, as DuckDB has no look-behind (tested against plain Python)."""
    return tallies.proper_nouns(corpus(spark, d, "response_text"), "response_text", _STOP)
