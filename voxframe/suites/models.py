"""Queries on taxonomies, labelling, samples and plans: TX, ML, WN, JN-10 .. 18, AG-20 .. 35, SE-06 .. 07 families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PLAN_STOPWORDS, QUESTION_STOPWORDS, REVIEW_STOPWORDS
from ..operators import corpus as corpora
from ..operators import filters, induction, labeling, review, sampling, tallies, taxonomy
from ..plans import compile as compiler
from ..plans import route as routes
from ..plans import rulings
from ..registry import query
from ..session import shared_table
from .base import C, M, T, attributes, corpus, read
from .counts import _TUPLE, CONCEPTS, SCOPE


def _members(spark: SparkSession, d: str) -> DataFrame:
    return corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids"))


def _named_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Labels named after parts, so that names repeat as they do in practice."""
    t = corpora.taxonomy(corpus(spark, d, "dataset_id", "question_id", "label_ids")).withColumn("k", F.split("label_id", "_")[1].cast("long") * 3 % 97 + 1)
    parts = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return t.join(parts, "k", "left").drop("k")


_NT = f"{C}, {M}, {T}, nt AS (SELECT t.*, p.p_name AS name, p.p_type AS description FROM t LEFT JOIN part p ON p.p_partkey = CAST(split_part(label_id, '_', 2) AS BIGINT) * 3 % 97 + 1)"


def _tokens_sql(column: str, stop: tuple[str, ...]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({column}), '([a-z]+)', 1), lambda w: w NOT IN ({words})), lambda w: CASE WHEN w LIKE '%s' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END))"


_OVER = f"{C}, {M}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 4), o AS (SELECT a.label_id AS label_a, b.label_id AS label_b, count(*) AS shared FROM m a JOIN m b ON a.response_key = b.response_key AND a.label_id < b.label_id GROUP BY ALL)"


@query(f"WITH {_OVER} SELECT label_a, label_b, CAST(shared AS BIGINT) AS shared, CAST(x.n AS BIGINT) AS n_a, CAST(y.n AS BIGINT) AS n_b FROM o JOIN n x ON x.label_id = label_a JOIN n y ON y.label_id = label_b")
def jn10_label_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.label_overlaps(_members(spark, d))


@query(f"WITH {_OVER} SELECT label_a, label_b, CAST(shared AS BIGINT) AS shared, CAST(x.n AS BIGINT) AS n_a, CAST(y.n AS BIGINT) AS n_b FROM o JOIN n x ON x.label_id = label_a JOIN n y ON y.label_id = label_b WHERE 100 * shared >= 40 * least(x.n, y.n)")
def sf09_strong_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.strongly_overlapping(taxonomy.label_overlaps(_members(spark, d)))


def _pairs_sql(stop: tuple[str, ...], scope: str, percent: int) -> str:
    return (
        f"WITH {_NT}, k AS (SELECT question_id, label_id, {_tokens_sql('name', stop)} AS t FROM nt WHERE name IS NOT NULL) SELECT {scope}a.label_id AS label_a, b.label_id AS label_b, CAST(len(list_intersect(a.t, b.t)) AS INT) AS n_shared, CAST(len(list_distinct(list_concat(a.t, b.t))) AS INT) AS n_union "
        f"FROM k a JOIN k b ON a.label_id < b.label_id {'AND a.question_id = b.question_id' if scope else ''} WHERE len(list_intersect(a.t, b.t)) > 0 AND 100 * len(list_intersect(a.t, b.t)) >= {percent} * len(list_distinct(list_concat(a.t, b.t)))"
    )


@query(
    f"WITH {_NT}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1), z AS (SELECT nt.*, n.n, count(*) OVER (PARTITION BY question_id, trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'))) AS sn FROM nt LEFT JOIN n USING (label_id)), p AS (SELECT question_id, CAST(count(*) AS BIGINT) AS n_labels, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS zero_count, CAST(count(*) FILTER (parent_id IS NULL) AS BIGINT) AS orphans, CAST(count(*) FILTER (sn > 1) AS BIGINT) AS duplicate_names FROM z GROUP BY 1), "
    "q AS (SELECT question_id, CAST(count(*) FILTER (coalesce(uncategorized, false) OR coalesce(fit = 1, false)) AS BIGINT) AS pool, CAST(count(uncategorized) AS BIGINT) AS coded FROM c GROUP BY 1) SELECT * FROM p LEFT JOIN q USING (question_id)"
)
def ag21_review_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.diagnostics(_named_taxonomy(spark, d), _members(spark, d), corpus(spark, d, "question_id", "uncategorized", "fit"))


@query(f"WITH {C}, {M}, {T} SELECT m.label_id, CAST(count(*) AS BIGINT) AS n FROM m ANTI JOIN (SELECT label_id FROM t WHERE CAST(split_part(label_id, '_', 2) AS INT) % 4 <> 0) t ON t.label_id = m.label_id GROUP BY 1")
def jn16_unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.tallies import unknown_labels

    c = corpus(spark, d, "dataset_id", "question_id", "label_ids")
    return unknown_labels(corpora.members(c), corpora.taxonomy(c).where(F.split("label_id", "_")[1].cast("int") % 4 != 0))


@query(f"WITH {C}, {M}, x AS (SELECT label_id, CAST(split_part(response_key, ':', 3) AS INT) // 50 AS chunk FROM m) SELECT label_id, CAST(count(DISTINCT chunk) AS BIGINT) AS chunk_support, CAST(count(*) AS BIGINT) AS n_members FROM x GROUP BY 1")
def ag33_chunk_support(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.chunk_support(_members(spark, d).withColumn("chunk", F.floor(F.split("response_key", ":")[2].cast("int") / 50)))


@query("WITH p AS (SELECT p_partkey AS position, p_name AS name, p_type AS description, p_brand AS include, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) AS norm FROM part), i AS (SELECT norm, include, min(position) AS pos FROM p GROUP BY ALL) SELECT norm, arg_min(name, position) AS name, arg_max(description, length(description) * 1000000 - position) AS description, CAST(count(*) AS BIGINT) AS n_merged, (SELECT string_agg(include, ',' ORDER BY pos) FROM i WHERE i.norm = p.norm) AS include FROM p GROUP BY norm")
def ag34_merge_by_name(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", F.col("p_partkey").alias("position"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("include"))
    return taxonomy.merge_by_name(p).withColumn("include", F.array_join("include", ",")).drop("position")


@query()
def tx01_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For every question and every chunk of fifty of its responses: each label's numbers are those of its chunk."""
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("source_row_index", "response_key")) - 1
    placed = corpus(spark, d, "question_id", "source_row_index").withColumn("at", order).withColumn("chunk", F.floor(F.col("at") / 50))
    number = lambda n: F.struct("question_id", "chunk", n.alias("n"))
    cited = _members(spark, d).select("response_key", "label_id").join(placed.select("response_key", "question_id", "chunk"), "response_key")
    cited = cited.withColumn("number", number(F.split("response_key", ":")[2].cast("int") % 60))
    cited = cited.groupBy(F.struct("label_id", "chunk").alias("label_id")).agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    chunks = placed.select(number((F.col("at") % 50).cast("int")).alias("position"), "response_key")
    found = taxonomy.resolve_evidence(cited, chunks)
    return found.select("label_id.label_id", "label_id.chunk", F.array_join("evidence", ",").alias("evidence"), "n_invalid")


@query("WITH a AS (SELECT p_name AS label_id, p_type AS theme, p_partkey AS position FROM part), f AS (SELECT label_id, arg_min(theme, position) AS theme FROM a GROUP BY 1), k AS (SELECT DISTINCT p_type AS theme FROM part WHERE p_size > 48) SELECT label_id, CASE WHEN k.theme IS NULL THEN '(unsorted)' ELSE f.theme END AS theme FROM f LEFT JOIN k ON k.theme = f.theme")
def tx03_theme_assignment(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", "p_name", "p_type", "p_partkey", "p_size")
    answers = p.select(F.col("p_name").alias("label_id"), F.col("p_type").alias("theme"), F.col("p_partkey").alias("position"))
    return taxonomy.first_answers(answers, p.where("p_size > 48").select(F.col("p_type").alias("name")).distinct())


_MAP = {"4_001": "4_002", "4_003": "4_002", "9_001": "9_002", "1_001": None}


@query(f"WITH {C}, x AS (SELECT response_key, unnest(label_ids) AS l, generate_subscripts(label_ids, 1) AS i FROM c), y AS (SELECT response_key, CASE WHEN l IN ('4_001', '4_003') THEN '4_002' WHEN l = '9_001' THEN '9_002' ELSE l END AS l, i FROM x WHERE l <> '1_001'), z AS (SELECT response_key, l, min(i) AS i FROM y GROUP BY ALL) SELECT response_key, string_agg(l, ',' ORDER BY i) AS label_ids FROM z GROUP BY 1")
def sf16_remap_labels(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "label_ids").where("label_ids IS NOT NULL")
    return c.select("response_key", F.array_join(taxonomy.remap(F.col("label_ids"), _MAP), ",").alias("label_ids")).where("label_ids <> ''")


@query(f"WITH {_NT}, p AS (SELECT question_id, p_name AS name, p_partkey AS position FROM part, (SELECT DISTINCT question_id FROM t)), x AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')) AS norm FROM p), o AS (SELECT DISTINCT question_id, norm FROM x ANTI JOIN (SELECT question_id AS q, trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')) AS nn FROM nt) e ON e.q = x.question_id AND e.nn = x.norm) SELECT question_id, CAST(count(*) AS BIGINT) AS n_new, CAST(count(*) AS BIGINT) AS n_ids FROM o GROUP BY 1")
def tx09_extend_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Every part proposed for every question."""
    t = shared_table(_named_taxonomy(spark, d))
    proposed = read(spark, d, "part", F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    return taxonomy.extend(t, proposed).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_new"), F.count_distinct("label_id").alias("n_ids"))


@query(f"WITH {_NT} SELECT label_id, CASE WHEN contains(lower(name), 'ring') THEN 0 WHEN contains(lower(description), 'ring') THEN 1 ELSE 2 END AS rank FROM nt WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring') OR contains(lower(parent_id), 'ring')")
def tx15_category_search(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.search(_named_taxonomy(spark, d), "ring").select("label_id", "rank")


_ASKED = "Which small rings and large bolts do residents mention?"


@query(
    f"WITH {_NT}, q AS (SELECT list_filter({_tokens_sql("'" + _ASKED + "'", PLAN_STOPWORDS)}, lambda w: w NOT IN ({', '.join(repr(w) for w in QUESTION_STOPWORDS)})) AS asked), h AS (SELECT label_id, list_intersect(asked, {_tokens_sql("concat_ws(' ', name, description)", PLAN_STOPWORDS)}) AS hits FROM nt, q WHERE name IS NOT NULL AND label_id NOT IN {_TUPLE}) "
    "SELECT label_id, CAST(len(hits) AS INT) AS score FROM h WHERE len(hits) >= 2 OR len(list_filter(hits, lambda x: length(x) >= 5)) > 0 ORDER BY score DESC, label_id LIMIT 12"
)
def sf10_candidate_misses(spark: SparkSession, d: str) -> DataFrame:
    """The twelve categories a question seems to ask for that nobody selected."""
    return taxonomy.candidate_misses(_named_taxonomy(spark, d).where("name IS NOT NULL"), _ASKED, list(SCOPE))


@query(f"WITH {C}, {M} SELECT label_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(response_text)) AS BIGINT) AS chars FROM m JOIN (SELECT response_key, CASE WHEN length(response_text) > 600 THEN rtrim(substr(response_text, 1, 600), ' ') || '…' ELSE response_text END AS response_text FROM c WHERE response_text IS NOT NULL) USING (response_key) GROUP BY 1")
def tx21_member_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were cut short included."""
    rows = labeling.member_rows(_members(spark, d), corpus(spark, d, "response_text"))
    return rows.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- labelling -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {C} SELECT question_id, response_text, arg_min(response_key, source_row_index) AS representative_key, CAST(count(*) AS BIGINT) AS copies FROM c WHERE response_text IS NOT NULL GROUP BY ALL")
def wn02_representatives(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "question_id", "source_row_index", "response_text").where("response_text IS NOT NULL")
    return labeling.representatives(c, ["question_id"], "response_text", "source_row_index")


@query(f"WITH {C}, r AS (SELECT question_id, response_text, arg_min(response_key, source_row_index) AS representative_key FROM c WHERE response_text IS NOT NULL GROUP BY ALL) SELECT response_key, representative_key FROM c JOIN r USING (question_id, response_text)")
def wn03_fan_out(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "question_id", "source_row_index", "response_text").where("response_text IS NOT NULL")
    reps = labeling.representatives(c, ["question_id"], "response_text", "source_row_index").drop("copies")
    return labeling.fan_out(c, reps, ["question_id"], "response_text").select("response_key", "representative_key")


@query(f"WITH {C} SELECT response_key, CAST((row_number() OVER (PARTITION BY question_id ORDER BY source_row_index, response_key) - 1) // 60 AS INT) AS batch FROM c")
def wn04_batches(spark: SparkSession, d: str) -> DataFrame:
    return labeling.batches(corpus(spark, d, "question_id", "source_row_index"), ["question_id"], ["source_row_index", "response_key"], 60).select("response_key", "batch")


@query(f"WITH {C} SELECT response_key, CAST(ntile(5) OVER (PARTITION BY question_id ORDER BY sha256('7:' || response_key), response_key) AS INT) AS chunk FROM c")
def wn05_chunks(spark: SparkSession, d: str) -> DataFrame:
    return labeling.chunks(corpus(spark, d, "question_id"), ["question_id"], "response_key", 5, 7).select("response_key", "chunk")


def _reply(system: str, user: str) -> str:
    """A deterministic stand-in: every third row is left out, ids come as bare numbers, places as the first capitalised word."""
    import json
    import re

    rows = []
    for line in user.splitlines():
        n, _, answer = line.partition("\t")
        if int(n) % 3 != 2:
            word = re.search(r"[A-Z][a-z]+", answer)
            rows.append({"n": int(n), "label_ids": [str(int(n) % 2 + 1), "no_such"], "fit": int(n) % 5, "locations": [word.group() if word else "Nowhere", "Nowhere"], "event_occurred": "yes" if "stolen" in answer else "no", "actionability": "specific"})
    return "Here you are:\n```json\n" + json.dumps({"results": rows}) + "\n```"


@query()
def ml03_label_run(spark: SparkSession, d: str) -> DataFrame:
    """Representatives, batches, one call per batch with the stand-in client, checked replies, fanned out to all responses."""
    c = corpus(spark, d, "question_id", "label_ids", "response_text").where("response_text IS NOT NULL")
    rows = c.select("question_id", "response_key", F.col("response_text").alias("text"))
    out = induction.label_run(rows, corpora.taxonomy(c.withColumn("dataset_id", F.lit(0))), labeling.EchoClient(_reply))
    return out.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("not_returned")).alias("not_returned"), F.sum(F.size("label_ids")).alias("n_labels"), F.sum("n_invalid").alias("n_invalid"), F.count_if(F.size("locations") > 0).alias("with_places")
    )


@query("WITH e AS (SELECT event_id // 50 AS batch, CAST(row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS INT) AS position, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT CAST(batch AS BIGINT) AS batch, position, position % 4 = 0 AS not_returned, CASE WHEN position % 4 <> 0 AND k BETWEEN 1 AND 3 THEN k END AS fit, CASE WHEN position % 4 <> 0 AND k % 2 = 1 THEN '7_001' ELSE '' END AS label_ids FROM e")
def pr16_parse_records(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of event properties, over every event, in batches of fifty ids in a row, so that no batch grows with the table."""
    e = read(spark, d, "events", "event_id", "props").select("event_id", F.expr("event_id div 50").alias("batch"), F.from_json("props", "k int")["k"].alias("k"))
    b = e.withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("event_id")))
    b = b.select(F.lit(7).cast("long").alias("question_id"), "batch", "position", F.col("event_id").cast("string").alias("response_key"), F.lit("").alias("text"), "k")
    record = F.struct(F.col("position").alias("n"), F.array(F.when(F.col("k") % 2 == 1, "7_001").otherwise("7_999")).alias("label_ids"), F.col("k").alias("fit"))
    replies = b.groupBy("question_id", "batch").agg(F.to_json(F.struct(F.collect_list(F.when(F.col("position") % 4 != 0, record)).alias("results"))).alias("reply"))
    labels = spark.createDataFrame([(7, "7_001")], "question_id long, label_id string")
    return labeling.parse_labels(b.drop("k"), replies, labels).select("batch", "position", "not_returned", "fit", F.array_join("label_ids", ",").alias("label_ids"))


@query(f"WITH {C}, {M}, s AS (SELECT m.label_id, c.fit, c.source_row_index % 3 = 0 AS no_sub, c.source_row_index % 11 = 0 AS nr FROM m JOIN c USING (response_key)) SELECT label_id, CAST(count(*) FILTER (NOT nr) AS BIGINT) AS coded, CAST(count(*) FILTER (NOT nr AND no_sub) AS BIGINT) AS generic, CAST(count(*) FILTER (no_sub AND fit = 1) AS BIGINT) AS gap, CAST(count(*) FILTER (nr) AS BIGINT) AS not_returned FROM s GROUP BY 1")
def ag20_sub_label_report(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "fit", "source_row_index").select("response_key", "fit", "source_row_index")
    sub = _members(spark, d).join(c, "response_key").withColumn("sub_ids", F.when(F.col("source_row_index") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))))
    return labeling.sub_report(sub.withColumn("not_returned", F.col("source_row_index") % 11 == 0))


@query(f"WITH {C}, p AS (SELECT response_key, 'old' AS v FROM c WHERE source_row_index % 3 <> 0), f AS (SELECT response_key, 'new' AS v FROM c WHERE source_row_index % 5 = 0) SELECT coalesce(f.response_key, p.response_key) AS response_key, coalesce(f.v, p.v) AS v FROM p FULL JOIN f USING (response_key)")
def jn15_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "source_row_index")
    return labeling.overlay(c.where("source_row_index % 3 <> 0").select("response_key", F.lit("old").alias("v")), c.where("source_row_index % 5 = 0").select("response_key", F.lit("new").alias("v")))


@query(f"WITH {C}, {M}, p AS (SELECT DISTINCT label_id, 'prior' AS run FROM m), r AS (SELECT label_id FROM p WHERE label_id LIKE '4_%') SELECT label_id, run FROM p ANTI JOIN r USING (label_id) UNION ALL SELECT label_id, 'fresh' FROM r")
def jn17_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    prior = _members(spark, d).select("label_id").distinct().withColumn("run", F.lit("prior"))
    redone = prior.where(F.col("label_id").like("4_%")).select("label_id")
    return labeling.carry_forward(prior, redone, redone.withColumn("run", F.lit("fresh")))


@query(f"WITH {C} SELECT response_key, CASE WHEN dataset_id < 1000 THEN actionability END AS actionability FROM c")
def se06_append(spark: SparkSession, d: str) -> DataFrame:
    """Every dataset: the early ones are the prior run, all others are appended."""
    early = F.coalesce(F.col("dataset_id") < 1000, F.lit(False))
    c = corpus(spark, d, "dataset_id", "actionability")
    return c.where(early).select("response_key", "actionability").unionByName(c.where(~early).select("response_key"), allowMissingColumns=True)


# ---- samples and orders --------------------------------------------------------------------------------------------------------

_CAND = ", ".join(f"('{s}', {i})" for i, s in enumerate(SCOPE))


@query(f"WITH {C}, {M}, k(label_id, position) AS (VALUES {_CAND}) SELECT response_key, arg_min(label_id, position) AS label_id FROM m JOIN k USING (label_id) GROUP BY 1")
def wn06_owner_label(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.createDataFrame(list(zip(SCOPE, range(len(SCOPE)))), "label_id string, position int")
    return sampling.owner_label(_members(spark, d), chosen)


@query(f"WITH {C}, {M}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label_id) AS r, count(*) OVER () AS k FROM n) SELECT label_id, CAST(n AS BIGINT) AS n, CAST(r AS INT) AS rank, CASE WHEN r <= 120 THEN CAST(least(greatest(1, least(10, 120 // k)), n) AS INT) ELSE 0 END AS budget FROM r")
def wn08_quote_budgets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.budgets(_members(spark, d).groupBy("label_id").agg(F.count(F.lit(1)).alias("n")), 10, 120)


@query(f"WITH {C}, x AS (SELECT response_key, question_id, length(response_text) AS l, row_number() OVER (PARTITION BY question_id ORDER BY length(response_text), response_key) - 1 AS pos, count(*) OVER (PARTITION BY question_id) AS n FROM c WHERE response_text IS NOT NULL), e AS (SELECT question_id, max(l) FILTER (pos = n // 3) AS lo, max(l) FILTER (pos = (n * 2) // 3) AS hi FROM x GROUP BY 1) SELECT response_key, CASE WHEN l <= lo THEN 'short' WHEN l > hi THEN 'long' ELSE 'mid' END AS band FROM x JOIN e USING (question_id)")
def wn11_length_terciles(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "question_id", "response_text").where("response_text IS NOT NULL")
    return sampling.length_tercile(c, ["question_id"], "response_text").select("response_key", "band")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "question_id", "response_text", "label_ids", "locations", "actionability", "event_occurred").where("response_text IS NOT NULL")
    rows = c.select("*", F.explode(F.array_distinct("label_ids")).alias("label_id"))
    banded = sampling.length_tercile(rows, ["label_id"], "response_text")
    return banded.withColumn("tags", sampling.signal_tags(banded))


@query()
def wn09_composite_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.composite_sample(_tagged(spark, d), 10, 7)


@query(
    f"WITH {C}, {M}, s AS (SELECT a.label_id, a.response_key, b.label_id AS sub_id FROM m a JOIN m b ON a.response_key = b.response_key AND a.label_id <> b.label_id), n AS (SELECT label_id, sub_id, count(*) AS n FROM s GROUP BY ALL), "
    "o AS (SELECT s.label_id, response_key, s.sub_id, n, sha256('7:' || response_key) AS o FROM s JOIN n ON n.label_id = s.label_id AND n.sub_id = s.sub_id QUALIFY row_number() OVER (PARTITION BY s.label_id, response_key ORDER BY n DESC, s.sub_id) = 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY label_id, sub_id ORDER BY o) <= 2 AS first FROM o), p AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY first DESC, n DESC, sub_id, o) AS p FROM r) SELECT label_id, response_key, sub_id, CASE WHEN first THEN 'stratum' ELSE 'fill' END AS reason FROM p WHERE p <= 10"
)
def wn10_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Strata are the labels a response has beside the one sampled for."""
    m = _members(spark, d).select("response_key", "label_id")
    rows = m.join(m.withColumnRenamed("label_id", "sub_id"), "response_key").where("label_id <> sub_id")
    return sampling.stratified_sample(rows, 10, 2, 7)


@query(f"WITH {C}, s AS (SELECT DISTINCT response_key, unnest(label_ids) AS sub_id FROM c), n AS (SELECT sub_id, count(*) AS n FROM s GROUP BY 1) SELECT response_key, sub_id FROM s JOIN n USING (sub_id) QUALIFY row_number() OVER (PARTITION BY response_key ORDER BY n DESC, sub_id) = 1")
def wn17_primary_sub_theme(spark: SparkSession, d: str) -> DataFrame:
    return sampling.primary_sub_theme(_members(spark, d).select("response_key", F.col("label_id").alias("sub_id")))


# ---- plans ---------------------------------------------------------------------------------------------------------------------

ROUTE = {
    "route": "comparative", "answerable": True, "actionability_filter": "specific", "time_filter": "night", "concepts": ["buses", "no such concept"],
    "candidates": [{"label_id": s, "relevance": "high"} for s in SCOPE] + [{"label_id": "4_999"}, {"label_id": SCOPE[0]}],
    "groups": [{"name": "a", "label_ids": ["1_001", "4_001"]}, {"name": "b", "label_ids": ["4_002", "9_001", "4_999"]}],
}


def _evidence(spark: SparkSession, d: str, document: dict) -> dict[str, DataFrame]:
    r = routes.parse(document, set(SCOPE), set(CONCEPTS), available={"actionability", "event", "time"})
    return compiler.evidence(r, corpus(spark, d), concepts=CONCEPTS)


_CHOSEN = "ch AS (SELECT * FROM c WHERE list_has_any(label_ids, ['1_001', '4_001', '4_002', '9_001']) AND actionability = 'specific' AND len(time_context) > 0 AND regexp_matches(array_to_string(time_context, ' | '), '(?i)night|evening|dark|midnight|overnight|dusk')), cm AS (SELECT DISTINCT response_key, label_id FROM (SELECT response_key, unnest(label_ids) AS label_id FROM ch) WHERE label_id IN ('1_001', '4_001', '4_002', '9_001'))"


@query(f"WITH {C}, {_CHOSEN}, g(group_name, label_id) AS (VALUES ('a', '1_001'), ('a', '4_001'), ('b', '4_002'), ('b', '9_001')) SELECT group_name, CAST(count(DISTINCT response_key) AS BIGINT) AS n_unique, CAST(count(*) AS BIGINT) AS n_memberships FROM cm JOIN g USING (label_id) GROUP BY 1")
def route_groups(spark: SparkSession, d: str) -> DataFrame:
    """A comparative route compiled: unique responses per group under two filters."""
    return _evidence(spark, d, ROUTE)["groups"]


@query(f"WITH {C}, {_CHOSEN} SELECT label_id, CAST(count(*) AS BIGINT) AS n FROM cm GROUP BY 1")
def route_selection(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, ROUTE)["selection"]


@query()
def route_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, ROUTE)["quotes"]


def _rulings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", F.col("p_partkey").cast("string").alias("pair_key"), F.element_at(F.array(*map(F.lit, rulings.VERDICTS)), (F.col("p_size") % 3 + 1).cast("int")).alias("verdict"), F.when(F.col("p_partkey") % 10 == 0, "same").alias("override"), F.col("p_brand").alias("species"), (F.col("p_partkey") % 3).alias("g"))


_RUL = "r AS (SELECT CAST(p_partkey AS VARCHAR) AS pair_key, ['same', 'broader', 'distinct'][p_size % 3 + 1] AS verdict, CASE WHEN p_partkey % 10 = 0 THEN 'same' END AS override, p_brand AS species, p_partkey % 3 AS g FROM part)"


@query(f"WITH {_RUL} SELECT species, CAST(count(*) FILTER (verdict = 'same') AS BIGINT) AS same, CAST(count(*) FILTER (verdict = 'broader') AS BIGINT) AS broader, CAST(count(*) FILTER (verdict = 'distinct') AS BIGINT) AS \"distinct\" FROM r GROUP BY 1")
def ag35_rulings_report(spark: SparkSession, d: str) -> DataFrame:
    return rulings.report(_rulings(spark, d))


@query(f"WITH {_RUL}, o AS (SELECT * FROM r WHERE g <> 0), f AS (SELECT pair_key, 'distinct' AS verdict FROM r WHERE g <> 1) SELECT coalesce(o.pair_key, f.pair_key) AS pair_key, coalesce(f.verdict, o.verdict) AS verdict, o.override, coalesce(o.override, f.verdict, o.verdict) AS effective, f.pair_key IS NULL AS is_history FROM o FULL JOIN f ON o.pair_key = f.pair_key")
def se07_merge_rulings(spark: SparkSession, d: str) -> DataFrame:
    r = _rulings(spark, d)
    return rulings.merge(r.where("g <> 0"), r.where("g <> 1").select("pair_key", F.lit("distinct").alias("verdict")))


@query("WITH p AS (SELECT a.p_partkey AS x, b.p_partkey AS y, a.p_size AS na, b.p_size AS nb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT CAST(x AS VARCHAR) AS label_a, CAST(y AS VARCHAR) AS label_b FROM p WHERE 100 * abs((na * 7 % 50) - na) >= 50 * greatest(na, 1) OR 100 * abs((nb * 7 % 50) - nb) >= 50 * greatest(nb, 1)")
def tx18_stale_rulings(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))
    pairs = p.select("k", F.col("n").alias("n_a")).join(p.select((F.col("k") - 1).alias("k"), F.col("n").alias("n_b")), "k")
    made = pairs.select(F.col("k").cast("string").alias("label_a"), (F.col("k") + 1).cast("string").alias("label_b"), "n_a", "n_b")
    now = p.select(F.col("k").cast("string").alias("label_id"), (F.col("n") * 7 % 50).alias("n"))
    return rulings.stale(made, now).select("label_a", "label_b")


@query("WITH e AS (SELECT event_id, user_id % 20 AS batch, event_type FROM events), n AS (SELECT batch, event_type, min(event_id) AS first FROM e GROUP BY ALL), p(number, pair_key) AS (VALUES (1, 'k1'), (2, 'k2'), (3, 'k3')), r AS (SELECT batch, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 END AS number, CASE WHEN event_type = 'click' THEN 'same' ELSE 'distinct' END AS verdict FROM n WHERE event_type IN ('click', 'view')) SELECT p.pair_key || ':' || batch AS pair_key, verdict FROM r JOIN p USING (number)")
def tx19_parse_rulings(spark: SparkSession, d: str) -> DataFrame:
    """Replies with an unknown verdict for the third pair, which stays unruled."""
    b = read(spark, d, "events", (F.col("user_id") % 20).alias("batch"), "event_type").distinct()
    item = F.when(F.col("event_type") == "click", F.struct(F.lit(1).alias("pair"), F.lit("SAME ").alias("verdict"), F.lit("w").alias("why"))).when(F.col("event_type") == "view", F.struct(F.lit(2).alias("pair"), F.lit("distinct").alias("verdict"), F.lit("w").alias("why"))).otherwise(F.struct(F.lit(3).alias("pair"), F.lit("maybe").alias("verdict"), F.lit("w").alias("why")))
    replies = b.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(item).alias("rulings"))).alias("reply"))
    pairs = b.select("batch", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("number")).distinct()
    return rulings.parse(replies, pairs.withColumn("pair_key", F.concat(F.lit("k"), "number", F.lit(":"), "batch"))).select("pair_key", "verdict")


# ---- reviews, pairs, incremental runs --------------------------------------------------------------------------------------------

def _edits(q: int, z: int) -> list[dict]:
    """Every operation, over two questions; one merge is of a label merged already."""
    return [
        {"op": "merge", "from": f"{q}_001", "into": f"{q}_003"}, {"op": "merge", "from": f"{q}_001", "into": f"{q}_002"}, {"op": "merge", "from": f"{z}_001", "into": f"{z}_002"}, {"op": "delete", "label_id": f"{z}_003"},
        {"op": "add_parent", "parent_id": "R1", "name": "Reviewed"}, {"op": "reparent", "label_id": f"{q}_003", "parent_id": "R1"}, {"op": "rename", "label_id": f"{q}_003", "name": "Renamed"},
        {"op": "rename", "parent_id": "R1", "name": "Checked"}, {"op": "add_label", "label_id": f"{q}_900", "parent_id": "R1", "name": "Added"}, {"op": "reparent", "label_id": f"{q}_004", "parent_id": None},
    ]


_ENDS = "e AS (SELECT CAST(min(question_id) AS VARCHAR) AS q, CAST(max(question_id) AS VARCHAR) AS z FROM (SELECT question_id FROM t GROUP BY 1 HAVING count(*) >= 4))"


def _review(spark: SparkSession, d: str) -> review.Review:
    """The first and the last question of four labels or more, reviewed."""
    t = _named_taxonomy(spark, d)
    ends = t.groupBy("question_id").count().where("count >= 4").agg(F.min("question_id"), F.max("question_id")).first()
    parents = t.select("parent_id", F.concat(F.lit("Parent "), "parent_id").alias("name")).distinct()
    return review.Review.of(t.withColumn("name", F.coalesce("name", F.lit("unnamed"))), parents).apply(_edits(*ends))


@query(f"WITH {C}, {M}, {T}, {_ENDS}, y AS (SELECT response_key, CASE WHEN label_id IN (q || '_001', q || '_003') THEN q || '_002' WHEN label_id = z || '_001' THEN z || '_002' ELSE label_id END AS l FROM m, e WHERE label_id <> z || '_003') SELECT l AS label_id, CAST(count(DISTINCT response_key) AS BIGINT) AS n FROM y GROUP BY 1")
def tx07_apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """Merges, one of them of a merged label, and a deletion; counts come from the united members."""
    c = _review(spark, d).assignments(corpus(spark, d, "label_ids", "uncategorized"))
    return c.select("response_key", F.explode("label_ids").alias("label_id")).groupBy("label_id").agg(F.count_distinct("response_key").alias("n"))


@query(
    f"WITH {_NT}, {_ENDS} SELECT label_id, CASE WHEN label_id = q || '_002' THEN 'R1' WHEN label_id = q || '_004' THEN NULL ELSE parent_id END AS parent_id, CASE WHEN label_id = q || '_002' THEN 'Renamed' ELSE coalesce(name, 'unnamed') END AS name, "
    "CASE WHEN label_id = q || '_002' THEN 'Checked' WHEN label_id = q || '_004' THEN NULL ELSE 'Parent ' || parent_id END AS parent_name FROM nt, e WHERE label_id NOT IN (q || '_001', q || '_003', z || '_001', z || '_003') UNION ALL SELECT q || '_900', 'R1', 'Added', 'Checked' FROM e"
)
def tx07_edited_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Renames, new parents, reparenting and new labels; an edit of a merged label means the one it went to."""
    return _review(spark, d).taxonomy(spark).drop("description")


@query("WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), m AS (SELECT event_id, 'a_hot' AS l FROM e WHERE k < 50 UNION ALL SELECT event_id, 'b_warm' FROM e WHERE k < 60 UNION ALL SELECT event_id, 'c_all' FROM e WHERE k < 95 UNION ALL SELECT event_id, 'd_odd' FROM e WHERE k % 10 = 1 UNION ALL SELECT event_id, 'e_far' FROM e WHERE k >= 97) SELECT 'merge' AS op, l AS label_id, 'c_all' AS \"into\" FROM (VALUES ('a_hot'), ('b_warm')) v(l) UNION ALL SELECT 'merge', 'g_twin', 'e_far' UNION ALL SELECT 'delete', 'f_none', NULL")
def tx08_suggested_merges(spark: SparkSession, d: str) -> DataFrame:
    """Categories made of event properties: two inside a third of their parent, one of another parent inside it too, one without members, one of a used name."""
    k = F.col("k")
    e = read(spark, d, "events", F.col("event_id").cast("string").alias("response_key"), F.from_json("props", "k int")["k"].alias("k"))
    made = (("a_hot", k < 50), ("b_warm", k < 60), ("c_all", k < 95), ("d_odd", k % 10 == 1), ("e_far", k >= 97))
    ids = F.array_compact(F.array(*[F.when(c, n) for n, c in made]))
    members = e.select("response_key", F.explode(ids).alias("label_id"))
    t = [(1, "a_hot", "p", "hot"), (1, "b_warm", "p", "warm"), (1, "c_all", "p", "all"), (1, "d_odd", "q", "odd"), (1, "e_far", "p", "far"), (1, "f_none", "p", "none"), (1, "g_twin", "q", "Far!")]
    return review.suggested_edits(spark.createDataFrame(t, "question_id long, label_id string, parent_id string, name string"), members)


_PLACE = "SELECT response_key, label_id, place FROM (SELECT response_key, unnest(label_ids) AS label_id, CASE WHEN len(locations) > 0 THEN locations[1] END AS place FROM c)"


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "label_ids", "locations").select("response_key", F.explode("label_ids").alias("label_id"), F.get("locations", F.lit(0)).alias("location"))


@query(f"WITH {C}, q AS ({_PLACE}) SELECT coalesce(place, 'no place named') AS group_name, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1")
def tx17_sources_by_place(spark: SparkSession, d: str) -> DataFrame:
    return tallies.sources(_quotes(spark, d), _named_taxonomy(spark, d), by_place=True)


@query(f"WITH {_NT}, q AS ({_PLACE}) SELECT coalesce(name, q.label_id) AS group_name, CAST(count(*) AS BIGINT) AS n FROM q LEFT JOIN nt USING (label_id) GROUP BY 1")
def tx17_sources_by_category(spark: SparkSession, d: str) -> DataFrame:
    return tallies.sources(_quotes(spark, d), _named_taxonomy(spark, d), by_place=False)


@query(f"WITH {_NT}, h(heading) AS (VALUES ('Large brushed rings'), ('Small bolts'), ('Nothing of the sort')), k AS (SELECT question_id, label_id, {_tokens_sql('name', PLAN_STOPWORDS)} AS t FROM nt WHERE name IS NOT NULL), g AS (SELECT heading, {_tokens_sql('heading', PLAN_STOPWORDS)} AS g FROM h), s AS (SELECT question_id, heading, label_id, len(list_intersect(t, g)) AS i, len(list_distinct(list_concat(t, g))) AS u FROM g, k WHERE len(list_intersect(t, g)) > 0) SELECT question_id, heading, label_id FROM s WHERE 100 * i > 34 * u QUALIFY row_number() OVER (PARTITION BY question_id, heading ORDER BY i / u DESC, label_id) = 1")
def tx16_heading_match(spark: SparkSession, d: str) -> DataFrame:
    """Each of a few headings with the category of most similar name of every question, similarity above 0.34."""
    heads = spark.createDataFrame([("Large brushed rings",), ("Small bolts",), ("Nothing of the sort",)], "heading string")
    return taxonomy.headings(heads, _named_taxonomy(spark, d).where("name IS NOT NULL"))


_COUNTED = f"{_NT}, n AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1), o AS (SELECT nt.question_id, nt.label_id, nt.name, coalesce(n.n, 0) AS n, len(coalesce(nt.name, '')) % 5 AS score FROM nt LEFT JOIN n USING (label_id) WHERE nt.name IS NOT NULL)"


def _counted(spark: SparkSession, d: str) -> DataFrame:
    n = _members(spark, d).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    return _named_taxonomy(spark, d).where("name IS NOT NULL").join(n, "label_id", "left").na.fill(0, ["n"]).withColumn("score", F.length("name") % 5)


@query(f"WITH {_COUNTED} SELECT question_id, label_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n DESC, lower(name), label_id) AS INT) AS by_name, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n DESC, label_id) AS INT) AS by_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, label_id) AS INT) AS by_score FROM o")
def wn15_orderings(spark: SparkSession, d: str) -> DataFrame:
    """All three orders."""
    out = _counted(spark, d)
    for how in taxonomy.ORDERS:
        out = taxonomy.ordering(out, how, ["question_id"]).withColumnRenamed("rank", f"by_{how}")
    return out.select("question_id", "label_id", *[f"by_{how}" for how in taxonomy.ORDERS])


@query("SELECT n, string_agg(DISTINCT CAST(i * n // least(7, n) AS VARCHAR), ',' ORDER BY CAST(i * n // least(7, n) AS VARCHAR)) AS picks FROM (SELECT DISTINCT p_size AS n FROM part), range(0, 7) t(i) WHERE i < least(7, n) GROUP BY 1")
def wn16_spread_indices(spark: SparkSession, d: str) -> DataFrame:
    sizes = read(spark, d, "part", F.col("p_size").alias("n")).distinct()
    return sizes.select("n", F.array_join(F.array_sort(F.transform(sampling.spread_positions(F.col("n"), 7), lambda x: x.cast("string"))), ",").alias("picks"))


@query("WITH a AS (SELECT DISTINCT respondent_key, field, trim(value) AS value FROM respondents) SELECT field, value, CAST(count(DISTINCT respondent_key) AS BIGINT) AS n FROM a WHERE (field = 'Age band' AND value IN ('18-24', '25-34')) OR (field = 'Tenure' AND value = 'Rent') GROUP BY ALL")
def ev08_checked_demographics(spark: SparkSession, d: str) -> DataFrame:
    """A filter as it was asked for, with blanks; an unknown value would raise."""
    a = attributes(spark, d)
    clean = filters.check_demographics(a, {"Age band": ["18-24", "", "25-34"], "Tenure": ["Rent", " "], "District": []})
    asked = spark.createDataFrame([(f, v) for f, vs in clean.items() for v in vs], "field string, value string")
    return tallies.attribute_counts(a.join(asked, ["field", "value"], "left_semi"))


_PROPOSED = "p AS (SELECT question_id, label_id FROM t WHERE CAST(split_part(label_id, '_', 2) AS INT) % 3 <> 0), s AS (SELECT question_id, label_id FROM t WHERE CAST(split_part(label_id, '_', 2) AS INT) % 4 <> 0)"


@query(f"WITH {C}, {M}, {T}, {_PROPOSED} SELECT question_id, label_id, 'deselected' AS change FROM p ANTI JOIN s USING (question_id, label_id) UNION ALL SELECT question_id, label_id, 'added' FROM s ANTI JOIN p USING (question_id, label_id)")
def jn18_selection_changes(spark: SparkSession, d: str) -> DataFrame:
    t = corpora.taxonomy(corpus(spark, d, "dataset_id", "question_id", "label_ids"))
    number = F.split("label_id", "_")[1].cast("int")
    return routes.changed_labels(t.where(number % 3 != 0), t.where(number % 4 != 0), ["question_id"])


@query(
    f"WITH {_OVER}, {T}, nt AS (SELECT t.*, p.p_name AS name FROM t LEFT JOIN part p ON p.p_partkey = CAST(split_part(label_id, '_', 2) AS BIGINT) * 3 % 97 + 1), k AS (SELECT question_id, label_id, {_tokens_sql('name', REVIEW_STOPWORDS)} AS t FROM nt WHERE name IS NOT NULL), g AS (SELECT label_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 5), "
    "y AS (SELECT a.question_id, a.label_id AS label_a, b.label_id AS label_b, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(list_concat(a.t, b.t))) AS u FROM k a JOIN k b ON a.question_id = b.question_id AND a.label_id < b.label_id), z AS (SELECT * FROM y WHERE i > 0 AND 100 * i >= 40 * u), "
    "w AS (SELECT o.label_a, o.label_b, o.shared, least(ga.n, gb.n) AS s, ka.question_id FROM o JOIN g ga ON ga.label_id = label_a JOIN g gb ON gb.label_id = label_b JOIN k ka ON ka.label_id = label_a JOIN k kb ON kb.label_id = label_b AND kb.question_id = ka.question_id WHERE 100 * o.shared >= 40 * least(ga.n, gb.n)), "
    "f AS (SELECT coalesce(z.question_id, w.question_id) AS question_id, coalesce(z.label_a, w.label_a) AS label_a, coalesce(z.label_b, w.label_b) AS label_b, coalesce(i, 0) AS i, coalesce(u, 0) AS u, coalesce(shared, 0) AS shared, coalesce(s, 0) AS s FROM z FULL JOIN w ON z.label_a = w.label_a AND z.label_b = w.label_b) "
    "SELECT question_id, label_a, label_b, CAST(row_number() OVER (PARTITION BY question_id ORDER BY greatest(CASE WHEN u > 0 THEN i / u ELSE 0 END, CASE WHEN s > 0 THEN shared / s ELSE 0 END) DESC, label_a, label_b) AS INT) AS rank FROM f QUALIFY rank <= 8"
)
def jn11_duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """By name or by members, the eight closest pairs of a question."""
    return taxonomy.duplicate_candidates(_named_taxonomy(spark, d).where("name IS NOT NULL"), _members(spark, d)).select("question_id", "label_a", "label_b", "rank")


_ITEMS = f"WITH {_NT}, k AS (SELECT question_id, parent_id, label_id, {_tokens_sql('name', PLAN_STOPWORDS)} AS t FROM nt WHERE name IS NOT NULL), p AS (SELECT a.label_id AS label_a, b.label_id AS label_b, a.question_id AS qa, b.question_id AS qb, a.parent_id AS ca, b.parent_id AS cb, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(list_concat(a.t, b.t))) AS u FROM k a JOIN k b ON a.label_id < b.label_id)"
_SPECIES_SQL = {"category": "qa <> qb", "category_sameq": "qa = qb", "subtheme_xcat": "qa = qb AND ca <> cb", "subtheme_xq": "qa <> qb"}


@query(_ITEMS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT label_a, label_b, '{s}' AS species, CAST(i AS INT) AS n_shared, CAST(u AS INT) AS n_union, (label_a = '4_001' AND label_b = '4_009') OR (label_a = '1_001' AND label_b = '4_001') AS forced FROM p WHERE ({w}) AND ((i > 0 AND 100 * i >= 40 * u) OR (label_a = '4_001' AND label_b = '4_009') OR (label_a = '1_001' AND label_b = '4_001'))" for s, w in _SPECIES_SQL.items()) + ")")
def jn12_nominated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All four species, with two pairs forced."""
    items = _named_taxonomy(spark, d).where("name IS NOT NULL").withColumnRenamed("parent_id", "category_id")
    forced = spark.createDataFrame([("4_009", "4_001"), ("1_001", "4_001")], "label_a string, label_b string")
    return taxonomy.nominate(items, taxonomy.SPECIES, 40, forced)


@query(f"WITH {C}, {M}, x AS (SELECT DISTINCT question_id, label_id, CAST(split_part(response_key, ':', 3) AS INT) // 50 AS chunk FROM m), s AS (SELECT question_id, label_id AS name, count(*) AS chunk_support, CASE WHEN CAST(split_part(label_id, '_', 2) AS INT) % 4 > 0 THEN 'Theme ' || CAST(split_part(label_id, '_', 2) AS INT) % 4 END AS parent FROM x GROUP BY ALL), d AS (SELECT DISTINCT question_id, parent FROM s WHERE parent IS NOT NULL), q AS (SELECT *, question_id || '_P' || lpad(CAST(row_number() OVER (PARTITION BY question_id ORDER BY parent) AS VARCHAR), 2, '0') AS parent_id FROM d) SELECT s.question_id, s.question_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY s.question_id ORDER BY chunk_support DESC, name) AS VARCHAR), 3, '0') AS label_id, name, parent_id, CAST(chunk_support AS BIGINT) AS chunk_support, chunk_support = 1 AS singleton, chunk_support = 1 AS needs_review FROM s LEFT JOIN q ON q.question_id = s.question_id AND q.parent = s.parent")
def tx06_assemble_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Ids by support and name, parents by name, labels without a theme left to review."""
    m = _members(spark, d).withColumn("chunk", F.floor(F.split("response_key", ":")[2].cast("int") / 50))
    labels = m.groupBy("question_id", F.col("label_id").alias("name")).agg(F.count_distinct("chunk").alias("chunk_support"))
    theme = F.split("name", "_")[1].cast("int") % 4
    return taxonomy.assemble(labels.withColumn("parent", F.when(theme > 0, F.concat(F.lit("Theme "), theme.cast("string")))), 5)


_BLANKS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"  # what Python takes for blanks


def _line_numbers(user: str) -> list[tuple[int, str]]:
    return [(int(n), t) for n, _, t in (line.partition("\t") for line in user.splitlines())]


def _label_by_length(system: str, user: str) -> str:
    """A stand-in that labels by the length of a text; what is divisible by five has no category, until there is an incremental one."""
    import json

    rows = [{"n": n, "label_ids": [] if len(t) % 5 == 0 else ["1" if len(t) % 2 else "2"], "uncategorized": len(t) % 5 == 0, "fit": 3} for n, t in _line_numbers(user)]
    return json.dumps({"results": rows})


def _propose_by_length(system: str, user: str) -> str:
    """A stand-in that proposes one category for all it sees, one under a known name, and cites a number that is not there."""
    import json

    shown = [n for n, _ in _line_numbers(user)]
    return json.dumps({"candidates": [{"name": "Left over", "description": "all", "include": ["x"], "evidence": [*shown[:3], 9999]}, {"name": "Known Label", "evidence": shown[:1]}, {"name": " "}]})


@query(
    f"WITH {C}, r AS (SELECT question_id, response_key, trim(regexp_replace(response_text, '{_BLANKS}', ' ', 'g')) AS t, uncategorized FROM c WHERE response_text IS NOT NULL), p AS (SELECT count(*) >= 20 AS enough FROM r WHERE uncategorized IS NULL AND length(t) % 5 = 0) "
    "SELECT question_id, CASE WHEN uncategorized IS NOT NULL THEN 'kept' WHEN length(t) % 5 = 0 AND enough THEN 'relabelled' ELSE 'labelled' END AS how, CAST(count(*) AS BIGINT) AS n FROM r, p GROUP BY ALL"
)
def tx10_incremental_run(spark: SparkSession, d: str) -> DataFrame:
    """New responses labelled, the uncovered pool given a proposed category and labelled again, all laid over the prior records."""
    c = corpus(spark, d, "question_id", "response_text", "label_ids", "uncategorized", "fit").where("response_text IS NOT NULL")
    rows = c.select("question_id", "response_key", F.col("response_text").alias("text"))
    prior = corpora.coded(c).select("question_id", "response_key", "label_ids", "uncategorized", "fit")
    labels = c.select("question_id").distinct().select("question_id", F.explode(F.array(F.lit("001"), F.lit("002"))).alias("n"))
    known = labels.select("question_id", F.concat_ws("_", "question_id", "n").alias("label_id"), F.lit(None).cast("string").alias("parent_id"), F.when(F.col("n") == "001", "Known label").otherwise("Other label").alias("name"))
    run = induction.run_incremental(rows, known, prior, labeling.EchoClient(_label_by_length), labeling.EchoClient(_propose_by_length))
    return run.records.groupBy("question_id", "how").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {C}, r AS (SELECT question_id, response_key, sha256('7:' || response_key) AS o FROM c WHERE response_text IS NOT NULL), k AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY o, response_key) - 1 AS pos, count(*) OVER (PARTITION BY question_id) AS n FROM r), b AS (SELECT question_id, pos % CAST(ceil(n / 120) AS BIGINT) AS batch, count(*) AS size FROM k GROUP BY ALL) "
    "SELECT question_id, CAST(batch AS INT) AS batch, CAST(size AS BIGINT) AS n_responses, CAST(2 AS BIGINT) AS n_candidates, CAST(1 AS BIGINT) AS n_invalid, FALSE AS batch_failed FROM b"
)
def ml01_map_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One call per seeded chunk of 120 responses of every question; what each chunk gave."""
    rows = corpus(spark, d, "question_id", "response_text").where("response_text IS NOT NULL").select("question_id", "response_key", F.col("response_text").alias("text"))
    got = induction.map_candidates(rows, ["question_id"], labeling.EchoClient(_propose_by_length))
    return got.report.select("question_id", "batch", "n_responses", "n_candidates", "n_invalid", "batch_failed")


@query(
    f"WITH {C}, r AS (SELECT question_id, count(*) AS n FROM c WHERE response_text IS NOT NULL GROUP BY 1), l AS (SELECT question_id, unnest(['Known Label', 'Left over']) AS name, CAST(ceil(n / 120) AS BIGINT) AS k FROM r) SELECT question_id, name, k AS chunk_support, k = 1 AS singleton FROM l"
)
def ml01_induced_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all chunks united by name into a first taxonomy."""
    rows = corpus(spark, d, "question_id", "response_text").where("response_text IS NOT NULL").select("question_id", "response_key", F.col("response_text").alias("text"))
    return induction.induce(rows, labeling.EchoClient(_propose_by_length))[0].select("question_id", "name", "chunk_support", "singleton")


@query(f"WITH {C}, {M}, s AS (SELECT m.label_id, c.response_key, trim(regexp_replace(response_text, '{_BLANKS}', ' ', 'g')) AS t FROM m JOIN c USING (response_key) WHERE response_text IS NOT NULL) SELECT label_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (length(t) % 5 <> 0 AND length(t) % 2 = 1) AS BIGINT) AS first, CAST(count(*) FILTER (length(t) % 5 = 0) AS BIGINT) AS generic FROM s GROUP BY 1")
def ml04_sub_label_run(spark: SparkSession, d: str) -> DataFrame:
    """The members of every category labelled with two sub-themes of its own."""
    c = corpus(spark, d, "dataset_id", "question_id", "response_text", "label_ids").where("response_text IS NOT NULL")
    m = corpora.members(c).select("response_key", "label_id").join(c.select("response_key", F.col("response_text").alias("text")), "response_key")
    subs = m.select("label_id").distinct().select("label_id", F.explode(F.array(F.lit("_s_1"), F.lit("_s_2"))).alias("s")).select("label_id", F.concat("label_id", "s").alias("sub_id"))
    out = induction.sub_label(m, subs, labeling.EchoClient(_label_by_length))
    return out.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get("sub_ids", F.lit(0)).endswith("_s_1")).alias("first"), F.count_if(F.size("sub_ids") == 0).alias("generic"))
