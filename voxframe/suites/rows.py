"""Queries on rows, files and text: SC, SK, PR, JN, WN-01 .. 04, SF, AG-22 .. 23 families."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import corpus as corpora
from ..operators import matching, reshape
from ..registry import query
from ..sources import readers, sinks
from .base import A, C, M, attributes, corpus, read

FIELDS = ("respondent_id", "submitted", "district", "age_band", "answer_a", "answer_b")
ANSWERS = ("answer_a", "answer_b")
_WIDE = "w AS (SELECT dataset_id, upload_id, row_index, " + ", ".join(f"json_extract_string(any_value(cells), '$.{f}') AS {f}" for f in FIELDS) + " FROM raw_rows GROUP BY dataset_id, upload_id, row_index)"


def wide(spark: SparkSession, d: str) -> DataFrame:
    """raw_rows as the wide file they came from, rows delivered twice once."""
    once = read(spark, d, "raw_rows", "dataset_id", "upload_id", "row_index", "cells").groupBy("dataset_id", "upload_id", "row_index").agg(F.min("cells").alias("cells"))
    return once.select("dataset_id", "upload_id", "row_index", F.from_json("cells", ", ".join(f"{f} string" for f in FIELDS)).alias("c")).select("dataset_id", "upload_id", "row_index", "c.*")


# ---- scans and sinks -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey || '' AS c_custkey, c_name, c_nationkey || '' AS c_nationkey, c_mktsegment FROM customer")
def sc01_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A wide file through CSV and back: every cell a string."""
    from ..session import scratch

    place = scratch(spark, "sc01.csv")
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")
    rows.write.mode("overwrite").csv(place, header=True, escape='"')
    return readers.read_csv(spark, place)


@query(f"WITH {C} SELECT CASE WHEN response_text IS NULL OR trim(response_text) = '' THEN 'blank' WHEN is_nonanswer THEN 'nonanswer' ELSE 'usable' END AS answer_kind, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1")
def sc04_corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return corpora.split_answers(corpus(spark, d, "response_text", "is_nonanswer")).groupBy("answer_kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT response_key, response_text FROM responses WHERE question_id = 4")
def sc05_single_question(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_corpus(spark, f"{d}/responses.parquet", [4]).select("response_key", "response_text").distinct()


@query(f"WITH {C} SELECT question_id, arg_min(question_label, source_row_index) AS question_label, CAST(count(*) AS BIGINT) AS n_rows FROM c GROUP BY 1")
def sc06_questions(spark: SparkSession, d: str) -> DataFrame:
    return corpora.questions(corpus(spark, d, "question_id", "question_label", "source_row_index"))


@query("SELECT dataset_id, max_by(stored_filename, row_offset) AS stored_filename, max(row_offset) AS row_offset FROM uploads GROUP BY 1")
def sc09_latest_run(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.estimate import newest_runs

    return newest_runs(read(spark, d, "uploads", "dataset_id", "stored_filename", "row_offset"), ["dataset_id"], "row_offset")


_RUNS = "l AS (SELECT dataset_id, 0 AS question_id, 'r' || lpad(CAST(upload_id AS VARCHAR), 6, '0') AS run_id, 'r' || lpad(CAST(upload_id - 1 AS VARCHAR), 6, '0') AS manifest_run FROM uploads), x AS (SELECT dataset_id, question_id, run_id FROM l WHERE CAST(substr(run_id, 2) AS INT) % 3 <> 0)"


@query(
    f"WITH {_RUNS} SELECT l.dataset_id, l.question_id, l.run_id, coalesce(s.run_id, n.run_id, m.last) AS taxonomy_run, CASE WHEN s.run_id IS NOT NULL THEN 'same run' WHEN n.run_id IS NOT NULL THEN 'manifest' WHEN m.last IS NOT NULL THEN 'latest' ELSE 'none' END AS how "
    "FROM l LEFT JOIN x s ON s.dataset_id = l.dataset_id AND s.run_id = l.run_id LEFT JOIN x n ON n.dataset_id = l.dataset_id AND n.run_id = l.manifest_run LEFT JOIN (SELECT dataset_id, max(run_id) AS last FROM x GROUP BY 1) m ON m.dataset_id = l.dataset_id"
)
def sc10_taxonomy_pairing(spark: SparkSession, d: str) -> DataFrame:
    run = lambda shift: F.concat(F.lit("r"), F.lpad((F.col("upload_id") - shift).cast("string"), 6, "0"))
    labels = read(spark, d, "uploads", "dataset_id", F.lit(0).alias("question_id"), run(0).alias("run_id"), run(1).alias("manifest_run"))
    return readers.taxonomy_run(labels, labels.where(F.substring("run_id", 2, 6).cast("int") % 3 != 0).select("dataset_id", "question_id", "run_id"))


@query(f"WITH {C}, {M}, x AS (SELECT DISTINCT response_key, label_id, label_id || 's' || lpad(CAST(CAST(split_part(response_key, ':', 3) AS INT) % 3 AS VARCHAR), 2, '0') AS sub_id FROM m WHERE label_id LIKE '%_001') SELECT * FROM x")
def sc12_sub_theme_context(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "source_row_index", "label_ids")
    sub = lambda label: F.array(F.concat(label, F.lit("s"), F.lpad((F.col("source_row_index") % 3).cast("string"), 2, "0")))
    subs = c.where("size(label_ids) > 0").select("response_key", F.map_from_entries(F.transform(F.array_distinct("label_ids"), lambda x: F.struct(x, sub(x)))).alias("subs"))
    ok = c.select(F.explode("label_ids").alias("label_id")).distinct().withColumn("outcome", F.when(F.col("label_id").endswith("_001"), "ok").otherwise("does_not_decompose"))
    return readers.sub_members(subs, ok)


@query(f"WITH {C} SELECT dataset_id, question_id, response_key, array_to_string(label_ids, ',') AS label_ids, uncategorized, fit, response_date FROM c")
def sk01_export(spark: SparkSession, d: str) -> DataFrame:
    """Written with the fixed schema and read back."""
    from ..session import scratch

    place = scratch(spark, "sk01.parquet")
    sinks.write_export(corpus(spark, d), place)
    return spark.read.parquet(place).select("dataset_id", "question_id", "response_key", F.array_join("label_ids", ",").alias("label_ids"), "uncategorized", "fit", "response_date")


@query(f"WITH {A} SELECT respondent_key, source_row_index, field, value FROM a")
def sk02_sidecar(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sidecar_frame(attributes(spark, d))


@query(f"WITH {C} SELECT response_key, coalesce(CAST(to_json(label_ids) AS VARCHAR), '') AS label_ids, coalesce(CAST(to_json(locations) AS VARCHAR), '') AS locations FROM c")
def sk03_csv_lists(spark: SparkSession, d: str) -> DataFrame:
    return sinks.csv_frame(corpus(spark, d)).select("response_key", "label_ids", "locations")


@query(f"WITH {C} SELECT dataset_id, question_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (is_nonanswer) AS BIGINT) AS n_nonanswers, CAST(count(*) FILTER (was_encoding_repaired) AS BIGINT) AS n_repaired, CAST(count(uncategorized) AS BIGINT) AS n_labelled FROM c GROUP BY ALL")
def sk04_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(corpus(spark, d, "dataset_id", "question_id", "is_nonanswer", "was_encoding_repaired", "uncategorized"))


@query(f"WITH {C} SELECT CAST(count(DISTINCT r.respondent_key) AS BIGINT) AS n_unmatched FROM respondents r ANTI JOIN c ON c.respondent_key = r.respondent_key")
def jn05_unmatched_keys(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "respondents", F.col("respondent_key").alias("response_key"))
    return sinks.unmatched_keys(a, corpus(spark, d, "respondent_key").select(F.col("respondent_key").alias("response_key")))


# ---- projections ---------------------------------------------------------------------------------------------------------------

_LONG = "u AS (SELECT dataset_id, upload_id, row_index, source_column, raw_text FROM (SELECT dataset_id, upload_id, row_index, answer_a, answer_b FROM w) UNPIVOT (raw_text FOR source_column IN (answer_a, answer_b)) WHERE trim(raw_text) <> '')"


@query(f"WITH {_WIDE}, {_LONG} SELECT * FROM u")
def pr01_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unpivot_answers(wide(spark, d), ["dataset_id", "upload_id", "row_index"], list(ANSWERS))


@query(f"WITH {_WIDE} SELECT w.dataset_id, w.row_index FROM w SEMI JOIN (SELECT * FROM row_hashes WHERE is_duplicate = false) h ON h.dataset_id = w.dataset_id AND h.row_index = w.row_index")
def pr02_owned_rows(spark: SparkSession, d: str) -> DataFrame:
    return reshape.owned(wide(spark, d).select("dataset_id", "row_index"), read(spark, d, "row_hashes", "dataset_id", "row_index", "is_duplicate"))


@query("SELECT h.dataset_id, h.upload_id, h.row_index, h.row_index + u.row_offset AS source_row_index FROM row_hashes h JOIN uploads u USING (dataset_id, upload_id)")
def pr02_global_index(spark: SparkSession, d: str) -> DataFrame:
    out = reshape.with_global_index(read(spark, d, "row_hashes", "dataset_id", "upload_id", "row_index"), read(spark, d, "uploads", "dataset_id", "upload_id", "row_offset"))
    return out.drop("row_offset")


@query(f"WITH {C} SELECT response_key, dataset_id || ':' || question_id || ':' || source_row_index = response_key AS is_same, split_part(response_key, ':', 1) || ':' || split_part(response_key, ':', 3) AS respondent_key FROM c")
def pr03_keys(spark: SparkSession, d: str) -> DataFrame:
    made = corpora.response_key(F.col("dataset_id"), F.col("question_id"), F.col("source_row_index"))
    return corpus(spark, d, "dataset_id", "question_id", "source_row_index").select("response_key", (made == F.col("response_key")).alias("is_same"), corpora.respondent_key(F.col("response_key")).alias("respondent_key"))


_OUTER = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"WITH {_WIDE}, v AS (SELECT dataset_id, row_index, field, regexp_replace(value, '^{_OUTER}|{_OUTER}$', '', 'g') AS value FROM (SELECT dataset_id, row_index, district, age_band FROM w) UNPIVOT (value FOR field IN (district, age_band))) SELECT * FROM v WHERE value <> ''")
def pr04_attributes(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unpivot_attributes(wide(spark, d), ["dataset_id", "row_index"], ["district", "age_band", "no_such_column"])


@query()
def pr05_encoding_repair(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.encoding import with_repair

    return with_repair(corpus(spark, d, "raw_text_original"), "raw_text_original").where("was_repaired").select("response_key", "raw_text_original")


_NA = ", ".join("'" + v.replace("'", "''") + "'" for v in text.NON_ANSWERS)


@query(rf"WITH {C}, s AS (SELECT response_key, regexp_replace(lower(regexp_replace(response_text, '^{_OUTER}|{_OUTER}$', '', 'g')), '^[ \t.!?]+|[ \t.!?]+$', '', 'g') AS s FROM c WHERE response_text IS NOT NULL) SELECT response_key, s = '' OR s IN ({_NA}) AS is_nonanswer FROM s")
def pr06_nonanswers(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "response_text").where("response_text IS NOT NULL")
    return c.select("response_key", text.is_nonanswer(F.col("response_text")).alias("is_nonanswer"))


@query(
    f"WITH {_WIDE}, l AS (SELECT dataset_id, row_index, source_column, v FROM (SELECT dataset_id, row_index, district, age_band, submitted FROM w) UNPIVOT INCLUDE NULLS (v FOR source_column IN (district, age_band, submitted))) "
    "SELECT dataset_id, source_column, CAST(count(*) FILTER (trim(v) <> '') AS BIGINT) AS n_filled, coalesce(string_agg(v, '|' ORDER BY row_index) FILTER (trim(v) <> '' AND row_index < 5), '') AS sample FROM l GROUP BY ALL"
)
def pr07_column_preview(spark: SparkSession, d: str) -> DataFrame:
    long = wide(spark, d).select("dataset_id", "row_index", "district", "age_band", "submitted").unpivot(["dataset_id", "row_index"], ["district", "age_band", "submitted"], "source_column", "v")
    return reshape.column_preview(long, ["dataset_id", "source_column"], "row_index", "v")


_TWO = "s AS (SELECT DISTINCT p_partkey AS k, p_brand AS v, p_partkey % 7 AS g FROM part WHERE p_partkey % 5 <> 0), i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS v, p_partkey % 7 AS g FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 < 4)"


@query(f"WITH {_TWO} SELECT coalesce(s.k, i.k) AS k, CASE WHEN s.k IS NULL THEN 'insert' WHEN i.k IS NULL THEN CASE WHEN s.g < 4 THEN 'delete' ELSE 'keep' END WHEN s.v IS NOT DISTINCT FROM i.v THEN 'keep' ELSE 'update' END AS action, coalesce(i.v, s.v) AS v FROM s FULL JOIN i ON s.k = i.k")
def pr09_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), "p_brand", "p_type", (F.col("p_partkey") % 7).alias("g"))
    stored = p.where("k % 5 <> 0").select("k", F.col("p_brand").alias("v"), "g")
    incoming = p.where("k % 4 <> 0 AND g < 4").select("k", F.when(F.col("k") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("v"), "g")
    return reshape.upsert(stored, incoming, ["k"], "v", scope="g")


@query("SELECT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) AS norm, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL")
def pr12_normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_name").groupBy("p_name", text.normalized_name(F.col("p_name")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))


@query()
def pr11_normalized_questions(spark: SparkSession, d: str) -> DataFrame:
    """NFKC and case folding have no built-in; the questions are few and asked once each."""
    from ..session import ship_package

    ship_package(spark)

    @F.pandas_udf("string")
    def _question(s: pd.Series) -> pd.Series:
        return s.map(text.normalized_question)

    return read(spark, d, "responses", "question_label").distinct().where("question_label IS NOT NULL").select("question_label", _question("question_label").alias("norm"))


@query(f"WITH {C} SELECT question_id, CAST(count(*) FILTER (length(response_text) > 160) AS BIGINT) AS n_cut, CAST(sum(length(CASE WHEN length(response_text) > 160 THEN rtrim(substr(response_text, 1, 160), ' ') || '…' ELSE response_text END)) AS BIGINT) AS chars FROM c GROUP BY 1")
def pr13_truncation(spark: SparkSession, d: str) -> DataFrame:
    cut = text.truncated(F.col("response_text"), 160)
    return corpus(spark, d, "question_id", "response_text").groupBy("question_id").agg(F.count_if(F.length("response_text") > 160).alias("n_cut"), F.sum(F.length(cut)).alias("chars"))


@query(f"WITH {C}, x AS (SELECT response_key, response_text, unnest(locations) AS s, generate_subscripts(locations, 1) AS i FROM c WHERE response_text IS NOT NULL), k AS (SELECT response_key, trim(s) AS s, i FROM x WHERE trim(s) <> '' AND contains(lower(response_text), lower(trim(s))) QUALIFY row_number() OVER (PARTITION BY response_key, lower(trim(s)) ORDER BY i) = 1) SELECT response_key, string_agg(s, '|' ORDER BY i) AS kept FROM k GROUP BY 1")
def pr14_verbatim_spans(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "response_text", "locations").where("response_text IS NOT NULL AND size(locations) > 0")
    return c.select("response_key", F.array_join(text.verbatim(F.col("locations"), F.col("response_text")), "|").alias("kept")).where("kept <> ''")


@query(f"WITH {C}, {M}, b AS (SELECT DISTINCT question_id, label_id, regexp_extract(label_id, '_0*(\\d+)$', 1) AS bare FROM m) SELECT question_id, bare, min(label_id) AS label_id FROM b WHERE bare <> '' GROUP BY ALL HAVING count(*) = 1")
def pr15_bare_ids(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labeling import suffix_map

    return suffix_map(corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids")).select("question_id", "label_id").distinct())


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def pr17_json_in_prose(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object out of a reply with fences and talk around it."""
    reply = F.concat(F.lit("Sure, here it is:\n```json\n"), F.col("props"), F.lit("\n```\nAnything else?"))
    return read(spark, d, "events", "event_id", "props").select("event_id", text.json_in_prose(reply, "k bigint")["k"].alias("k"))


# ---- joins ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {C}, l AS (SELECT response_key, fit, actionability, row_number() OVER (PARTITION BY response_key ORDER BY run_id DESC) AS r FROM (SELECT response_key, fit, actionability, 'r2' AS run_id FROM c WHERE uncategorized IS NOT NULL AND source_row_index % 3 <> 0 UNION ALL SELECT response_key, 9, 'old', 'r1' FROM c WHERE source_row_index % 4 <> 0)) SELECT c.response_key, l.fit, l.actionability FROM c LEFT JOIN l ON l.response_key = c.response_key AND l.r = 1")
def jn01_latest_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Responses with the block of the later of two runs, null where neither covers one."""
    c = corpus(spark, d, "source_row_index", "uncategorized", "fit", "actionability")
    late = c.where("uncategorized IS NOT NULL AND source_row_index % 3 <> 0").select("response_key", "fit", "actionability", F.lit("r2").alias("run_id"))
    early = c.where("source_row_index % 4 <> 0").select("response_key", F.lit(9).cast("long").alias("fit"), F.lit("old").alias("actionability"), F.lit("r1").alias("run_id"))
    return corpora.with_labels(c.select("response_key"), late.unionByName(early)).select("response_key", "fit", "actionability")


@query(f"WITH {C}, {A}, f AS (SELECT respondent_key, min(coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y'))) AS day FROM a WHERE field = 'Survey date' GROUP BY 1) SELECT c.response_key, strftime(f.day, '%Y-%m-%d') AS day FROM c LEFT JOIN f USING (respondent_key)")
def jn02_first_date(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.dates import parse_date

    f = attributes(spark, d).where("field = 'Survey date'").groupBy("respondent_key").agg(F.min(parse_date(F.col("value"))).cast("string").alias("day"))
    return corpus(spark, d, "respondent_key").join(f, "respondent_key", "left").select("response_key", "day")


@query(f"WITH {C}, {A} SELECT a.field, a.value, CAST(count(DISTINCT c.response_key) AS BIGINT) AS n_responses, CAST(count(DISTINCT a.respondent_key) AS BIGINT) AS n_respondents FROM a JOIN c USING (respondent_key) WHERE c.uncategorized IS NOT NULL GROUP BY ALL")
def jn03_sidecar_corpus(spark: SparkSession, d: str) -> DataFrame:
    """One person, many responses."""
    joined = attributes(spark, d).select("respondent_key", "field", "value").distinct().join(corpora.coded(corpus(spark, d, "respondent_key", "uncategorized")), "respondent_key")
    return joined.groupBy("field", "value").agg(F.count_distinct("response_key").alias("n_responses"), F.count_distinct("respondent_key").alias("n_respondents"))


@query(f"WITH {C} SELECT response_key FROM c WHERE uncategorized IS NULL")
def jn04_never_labelled(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labeling import never_labelled

    c = corpus(spark, d, "uncategorized")
    return never_labelled(c, corpora.coded(c)).select("response_key")


@query("SELECT dataset_id, upload_id FROM uploads ANTI JOIN (SELECT DISTINCT dataset_id, upload_id FROM column_fingerprints) USING (dataset_id, upload_id)")
def jn06_uploads_without_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uploads", "dataset_id", "upload_id").join(read(spark, d, "column_fingerprints", "dataset_id", "upload_id").distinct(), ["dataset_id", "upload_id"], "left_anti")


_MATCH = "f AS (SELECT upload_id AS file_id, lower(row_hash) AS h, count(*) AS n FROM row_hashes WHERE is_duplicate IS NULL GROUP BY ALL), s AS (SELECT dataset_id, lower(row_hash) AS h, count(*) AS n FROM row_hashes WHERE is_duplicate IS NOT NULL GROUP BY ALL)"


@query(
    f"WITH {_MATCH}, fr AS (SELECT file_id, sum(n) AS r FROM f GROUP BY 1), sr AS (SELECT dataset_id, sum(n) AS r FROM s GROUP BY 1), k AS (SELECT file_id, dataset_id, sum(least(f.n, s.n)) AS matched FROM f JOIN s USING (h) GROUP BY ALL) "
    "SELECT file_id, dataset_id, CAST(matched AS BIGINT) AS matched, CAST(fr.r AS BIGINT) AS file_rows, CAST(sr.r AS BIGINT) AS dataset_rows, CASE WHEN matched = fr.r AND matched = sr.r THEN 'exact' ELSE 'partial' END AS outcome FROM k JOIN fr USING (file_id) JOIN sr USING (dataset_id)"
)
def ag22_dataset_matches(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "row_hashes", "dataset_id", "upload_id", F.lower("row_hash").alias("row_hash"), "is_duplicate")
    file = h.where("is_duplicate IS NULL").select(F.col("upload_id").alias("file_id"), "row_hash")
    return matching.dataset_matches(file, h.where("is_duplicate IS NOT NULL").select("dataset_id", "row_hash"))


@query(f"WITH {_MATCH} SELECT file_id, dataset_id, CAST(sum(least(f.n, s.n)) AS BIGINT) AS matched FROM f JOIN s USING (h) GROUP BY ALL")
def jn07_multiset_join(spark: SparkSession, d: str) -> DataFrame:
    return ag22_dataset_matches(spark, d).select("file_id", "dataset_id", "matched")


@query("SELECT f.column_name, f.upload_id, d.dataset_id FROM column_fingerprints f JOIN uploads u USING (dataset_id, upload_id) JOIN datasets d USING (dataset_id) WHERE d.status = 'ingested'")
def jn08_three_table_join(spark: SparkSession, d: str) -> DataFrame:
    ingested = read(spark, d, "datasets", "dataset_id", "status").where("status = 'ingested'").drop("status")
    return read(spark, d, "column_fingerprints", "dataset_id", "upload_id", "column_name").join(read(spark, d, "uploads", "dataset_id", "upload_id"), ["dataset_id", "upload_id"]).join(ingested, "dataset_id").select("column_name", "upload_id", "dataset_id")


_FILES = "l AS (SELECT upload_id AS file_id, column_name, fingerprint FROM column_fingerprints WHERE upload_id % 2 = 0), r AS (SELECT upload_id, column_name, fingerprint FROM column_fingerprints WHERE upload_id % 2 = 1), q AS (SELECT DISTINCT file_id, upload_id FROM l JOIN r USING (fingerprint))"


_MATCHED = (
    f"{_FILES}, a AS (SELECT file_id, q.upload_id, column_name, fingerprint AS ff FROM l JOIN q USING (file_id)), b AS (SELECT file_id, q.upload_id, column_name, fingerprint AS sf FROM r JOIN q USING (upload_id)), n AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.upload_id, b.upload_id) AS upload_id, coalesce(a.column_name, b.column_name) AS column_name, ff, sf FROM a FULL JOIN b ON a.file_id = b.file_id AND a.upload_id = b.upload_id AND a.column_name = b.column_name), "
    "x AS (SELECT file_id, upload_id, sf AS fp, row_number() OVER (PARTITION BY file_id, upload_id, sf ORDER BY column_name) AS k, column_name AS sn FROM n WHERE ff IS NULL), y AS (SELECT file_id, upload_id, ff AS fp, row_number() OVER (PARTITION BY file_id, upload_id, ff ORDER BY column_name) AS k, column_name AS fn FROM n WHERE sf IS NULL) "
    "SELECT file_id, upload_id, CASE WHEN ff = sf THEN 'matched' ELSE 'changed' END AS kind, column_name AS stored_name, column_name AS file_name FROM n WHERE ff IS NOT NULL AND sf IS NOT NULL UNION ALL "
    "SELECT coalesce(x.file_id, y.file_id), coalesce(x.upload_id, y.upload_id), CASE WHEN sn IS NULL THEN 'added' WHEN fn IS NULL THEN 'missing' ELSE 'renamed' END, coalesce(sn, ''), coalesce(fn, '') FROM x FULL JOIN y ON x.file_id = y.file_id AND x.upload_id = y.upload_id AND x.fp = y.fp AND x.k = y.k"
)


@query(f"WITH {_MATCHED}")
def ag23_column_matches(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "column_fingerprints", "upload_id", "column_name", "fingerprint")
    return matching.column_matches(f.where("upload_id % 2 = 0").withColumnRenamed("upload_id", "file_id"), f.where("upload_id % 2 = 1"))


_STEPS, _PAIRED = _MATCHED.split(" SELECT file_id, upload_id, CASE WHEN ff = sf", 1)
_KINDS = ("matched", "changed", "renamed", "missing", "added")


@query(
    f"WITH {_STEPS}, mm AS (SELECT file_id, upload_id, CASE WHEN ff = sf{_PAIRED}), k AS (SELECT file_id, upload_id, " + ", ".join(f"CAST(count(*) FILTER (kind = '{x}') AS BIGINT) AS {x}" for x in _KINDS) + " FROM mm GROUP BY ALL), "
    "lf AS (SELECT file_id, count(*) AS n FROM l GROUP BY 1), rf AS (SELECT upload_id, count(*) AS n FROM r GROUP BY 1) "
    "SELECT k.*, CAST(lf.n AS BIGINT) AS n_file, CAST(rf.n AS BIGINT) AS n_stored, matched + renamed >= 2 AND 2 * (matched + renamed) >= greatest(lf.n, rf.n) AS is_alike FROM k JOIN lf USING (file_id) JOIN rf USING (upload_id)"
)
def jn09_column_report(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "column_fingerprints", "upload_id", "column_name", "fingerprint")
    a, b = f.where("upload_id % 2 = 0").withColumnRenamed("upload_id", "file_id"), f.where("upload_id % 2 = 1")
    return matching.column_match_report(matching.column_matches(a, b), a, b)


_FLAG = "f AS (SELECT dataset_id, row_index, lower(row_hash) AS row_hash FROM row_hashes WHERE is_duplicate IS NULL), s AS (SELECT dataset_id, lower(row_hash) AS row_hash, count(*) AS n FROM row_hashes WHERE is_duplicate IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_FLAG} SELECT f.dataset_id, row_index, row_number() OVER (PARTITION BY f.dataset_id, f.row_hash ORDER BY row_index) <= coalesce(s.n, 0) AS is_duplicate FROM f LEFT JOIN s ON s.dataset_id = f.dataset_id AND s.row_hash = f.row_hash")
def wn01_duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "row_hashes", "dataset_id", "row_index", F.lower("row_hash").alias("row_hash"), "is_duplicate")
    return matching.flag_duplicates(h.where("is_duplicate IS NULL").drop("is_duplicate"), h.where("is_duplicate IS NOT NULL"), ["dataset_id"]).drop("row_hash")


@query("SELECT count(*) FILTER (h = lower(row_hash)) AS n_equal, count(*) AS n_rows FROM (SELECT DISTINCT r.dataset_id, r.row_index, x.row_hash, sha256(array_to_string(list_transform(json_keys(cells), lambda k: json_extract_string(cells, '$.' || k) || chr(0)), '')) AS h FROM raw_rows r JOIN row_hashes x ON x.dataset_id = r.dataset_id AND x.row_index = r.row_index)")
def sf01_row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 over the cells in file order reproduces the stored hashes."""
    r = read(spark, d, "raw_rows", "dataset_id", "row_index", "cells").distinct()
    cells = F.map_values(F.from_json("cells", "map<string,string>"))
    made = r.select("dataset_id", "row_index", hashing.array_hash(cells).alias("h"))
    both = made.join(read(spark, d, "row_hashes", "dataset_id", "row_index", "row_hash"), ["dataset_id", "row_index"]).distinct()
    return both.agg(F.count_if(F.col("h") == F.lower("row_hash")).alias("n_equal"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "WITH w AS (SELECT DISTINCT dataset_id, upload_id, row_index, cells FROM wave_rows), n AS (SELECT dataset_id, upload_id, column_name FROM column_fingerprints), "
    "v AS (SELECT n.dataset_id, n.upload_id, n.column_name, sha256(string_agg(coalesce(json_extract_string(w.cells, '$.\"' || n.column_name || '\"'), '') || chr(0), '' ORDER BY w.row_index)) AS fingerprint FROM n JOIN w USING (dataset_id, upload_id) GROUP BY ALL) SELECT * FROM v"
)
def sf02_column_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "wave_rows", "dataset_id", "upload_id", "row_index", "cells").distinct()
    names = read(spark, d, "column_fingerprints", "dataset_id", "upload_id", "column_name")
    cells = w.select("dataset_id", "upload_id", "row_index", F.from_json("cells", "map<string,string>").alias("m")).join(names, ["dataset_id", "upload_id"])
    return hashing.ordered_fingerprint(cells, ["dataset_id", "upload_id", "column_name"], "row_index", F.try_element_at("m", F.col("column_name")))


@query(f"WITH {C} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS sum_a, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS sum_b FROM (SELECT sha256(response_key || chr(0) || coalesce(response_text, '') || chr(1)) AS h FROM c)")
def sf03_corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return hashing.corpus_fingerprint(corpus(spark, d, "response_text"), "response_key", "response_text")


@query("SELECT p_partkey, substr(sha256(lower(trim(p_name)) || chr(1) || lower(trim(p_type)) || chr(1) || lower(trim(p_brand)) || chr(1)), 1, 16) AS h FROM part")
def sf04_definition_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand").select("p_partkey", hashing.definition_hash(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(None)).alias("h"))


@query("SELECT question_id, question_label, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(question_label), '([a-z]+)', 1), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in text.PLAN_STOPWORDS) + ")), lambda w: CASE WHEN w LIKE '%s' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END))), ',') AS t FROM (SELECT DISTINCT question_id, question_label FROM responses WHERE question_label IS NOT NULL)")
def sf08_tokens(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "responses", "question_id", "question_label").where("question_label IS NOT NULL").distinct()
    return q.select("question_id", "question_label", F.array_join(F.array_sort(text.tokens(F.col("question_label"))), ",").alias("t"))


_CITED = "SELECT doc_id, coalesce(text, '') || ' [' || doc_id % 7 || ', ' || doc_id % 5 || '] and [' || doc_id % 7 || ']' AS text FROM documents"


@query(
    f"WITH t AS ({_CITED}), g AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[(\\d{{1,4}}(?:\\s*,\\s*\\d{{1,4}})*)\\]', 1)) AS g FROM t), n AS (SELECT doc_id, CAST(unnest(regexp_split_to_array(g, '\\s*,\\s*')) AS INT) AS n FROM g) "
    "SELECT doc_id, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS cited FROM n GROUP BY 1"
)
def sf17_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of a document that a sentence with two of them, one repeated, is added to."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), n(7), F.lit(", "), n(5), F.lit("] and ["), n(7), F.lit("]"))
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(F.array_sort(F.transform(text.citations(cited), lambda x: x.cast("string"))), ",").alias("cited"))


@query("SELECT lang, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, CAST(sum(ceil(length(text) / 4)) * 3 AS BIGINT) AS micro_usd FROM documents GROUP BY 1")
def sf13_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.estimate import heuristic_tokens, price

    t = read(spark, d, "documents", "lang", "text").groupBy("lang").agg(F.sum(heuristic_tokens(F.col("text"))).alias("tokens"))
    return t.withColumn("micro_usd", F.round(price(F.col("tokens"), F.lit(3_000_000))).cast("long"))


@query(
    "WITH p AS (SELECT item_id, text, i, substr(text, i * 80 + 1, 40) AS piece FROM eval_items, range(0, 3) t(i) WHERE length(text) > i * 80 + 40) SELECT item_id, CAST(i AS INT) AS i, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), trim(lower(regexp_replace(piece, '\\s+', ' ', 'g')))) AS is_contained FROM p"
)
def jn14_containment(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.verify import contained_quotes

    items = read(spark, d, "eval_items", F.col("item_id").alias("source_id"), "text")
    pieces = items.select("source_id", "text", F.explode(F.array(*map(F.lit, range(3)))).alias("i")).where("length(text) > i * 80 + 40").select("source_id", "i", F.expr("substr(text, i * 80 + 1, 40)").alias("piece"))
    return contained_quotes(pieces, items).select(F.col("source_id").alias("item_id"), "i", "is_contained")
