"""Queries on what works on one document at a time (routes, checks, rendering, checked model stages, files): many documents, one each per row.

The functions under test run on the workers, in Arrow batches; the SQL states what they have to give for documents made from table columns.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, hashing
from ..models import stages
from ..operators import corpus as corpora
from ..operators import labeling, reshape, sampling, tallies
from ..plans import render, verify
from ..plans import route as routes
from ..registry import query
from ..session import scratch, ship_package
from ..sources import readers, sinks
from ..streaming import append
from .base import C, M, corpus, read
from .counts import _CONCEPT_SQL, CONCEPTS


def each_row(df: DataFrame, schema: str, work: Callable[[pd.Series], dict]) -> DataFrame:
    """``work`` on every row, in batches."""
    ship_package(df.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([work(r) for r in p.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def raises(work: Callable[[], object]) -> bool:
    try:
        work()
    except (ValueError, FileNotFoundError):
        return True
    return False


# ---- answers and their checks ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS k, (p_size * 37) || CASE WHEN p_partkey >= 13 AND p_partkey <> p_size * 37 THEN ',' || p_partkey ELSE '' END AS stated, p_size * 37 >= 13 AND p_size % 2 = 1 AS is_untraceable FROM part")
def sf19_stated_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Counts in bold and with a unit, beside a citation, a percentage, a decimal and a small number; odd ones are not allowed for."""
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))

    def work(r) -> dict:
        text = f"In all **{r.n * 37:,}** cases [{r.n}, 77], 45% or 3.14, x{r.k}; 5 mentions, {r.k} responses and (12)."
        allowed = {r.k} | ({r.n * 37} if r.n % 2 == 0 else set())
        return {"k": r.k, "stated": ",".join(map(str, verify.stated_numbers(text))), "is_untraceable": bool(set(verify.untraceable_numbers(text, allowed)))}

    return each_row(p, "k long, stated string, is_untraceable boolean", work)


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS n_untraceable FROM eval_items WHERE length(text) > 60 AND NOT regexp_matches(substr(text, 1, 60), '[“”\"…]|\\.\\.\\.')")
def sf20_untraceable_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Two pieces of an item quoted around an ellipsis in other case and with other blanks; every third quote is changed."""
    i = read(spark, d, "eval_items", "item_id", "text").where("length(text) > 60").where(~F.substring("text", 1, 60).rlike('[“”"…]|\\.\\.\\.'))

    def work(r) -> dict:
        piece = f"{r.text[:25].upper()}…{r.text[30:60].replace(' ', '  ')}"
        if r.item_id % 3 == 0:
            piece = "zq " + piece
        return {"item_id": r.item_id, "n_untraceable": len(verify.untraceable_quotes(f"They say “{piece}” [9] [1] and “not cited at all”.", {1: r.text, 9: "another"}))}

    return each_row(i, "item_id long, n_untraceable int", work)


@query("SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN '' ELSE '2' END AS misplaced FROM part")
def sf21_misplaced_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Citations under headings and bullets; one of them belongs elsewhere unless the heading is about something else."""
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))

    def work(r) -> dict:
        head = "Something else" if r.n % 4 == 0 else ("Broken light" if r.n % 2 else "The broken lights")
        text = f"Intro [2]\n## {head}\nDark [1] and late [2].\n- **Late buses** again [3]"
        return {"k": r.k, "misplaced": ",".join(map(str, verify.misplaced_quotes(text, {1: "Broken lights", 2: "Late buses", 3: "Late buses"}, ["Broken lights", "Late buses"])))}

    return each_row(p, "k long, misplaced string", work)


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN '2. B — ' || (p_partkey + 5) || ' responses' ELSE '' END AS missing FROM part")
def sf22_missing_sections(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))

    def work(r) -> dict:
        plan = f"1. A — {r.k + 5000} responses\n2. B — {r.k + 5} responses\nno count here"
        text = f"**{r.k + 5000:,} responses** say A [{r.k % 9}]." + ("" if r.n % 3 == 0 else f" Another {r.k + 5} responses say B.")
        return {"k": r.k, "missing": "|".join(verify.missing_sections(text, plan))}

    return each_row(p, "k long, missing string", work)


@query(f"WITH {C}, {M}, n AS (SELECT question_id, label_id, count(*) AS n FROM m GROUP BY ALL), u AS (SELECT question_id, count(DISTINCT response_key) AS u FROM m GROUP BY 1), l AS (SELECT question_id, label_id, '- Name ' || label_id || ' (' || label_id || '): ' || n || ' responses (' || CAST(CASE WHEN (200 * n) % (2 * u) = u AND ((100 * n) // u) % 2 = 0 THEN (100 * n) // u ELSE (200 * n + u) // (2 * u) END AS BIGINT) || '%)' AS line, n FROM n JOIN u USING (question_id)) SELECT question_id, string_agg(line, chr(10) ORDER BY n DESC, label_id) || chr(10) || '- unique responses: ' || max(u) AS block FROM l JOIN u USING (question_id) GROUP BY 1")
def sf23_counts_block(spark: SparkSession, d: str) -> DataFrame:
    """The counts block of every question as an answer shows it."""
    m = corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids"))
    n = m.groupBy("question_id", "label_id").agg(F.count(F.lit(1)).alias("n")).groupBy("question_id").agg(F.collect_list(F.struct("label_id", "n")).alias("rows"))  # the categories of one question
    u = m.groupBy("question_id").agg(F.count_distinct("response_key").alias("u"))

    def work(r) -> dict:
        return {"question_id": r.question_id, "block": render.counts_block([(x["label_id"], f"Name {x['label_id']}", x["n"]) for x in r.rows], {}, r.u)}

    return each_row(n.join(u, "question_id"), "question_id long, block string", work)


@query(f"WITH {C}, q AS (SELECT question_id, count(*) AS n FROM c GROUP BY 1), a AS (SELECT question_id, n, least(n, 12) AS shown FROM q) SELECT question_id, CASE WHEN shown >= n THEN '' ELSE 'showing ' || shown || ' of ' || n || ' (6 chosen to cover 3 of 5 signals, 6 at random)' END AS note FROM a")
def wn12_sampling_notes(spark: SparkSession, d: str) -> DataFrame:
    n = corpus(spark, d, "question_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    detail = {"coverage_picks": 6, "tags_covered": 3, "tags_total": 5, "random_picks": 6}
    return each_row(n, "question_id long, note string", lambda r: {"question_id": r.question_id, "note": sampling.sampling_note(min(r.n, 12), r.n, detail)})


@query(f"WITH {C}, p AS (SELECT question_id, response_key, unnest(locations) AS place FROM c), k AS (SELECT question_id, place, count(DISTINCT response_key) AS n FROM p GROUP BY ALL), o AS (SELECT DISTINCT p.question_id, response_key, p.place, n FROM p JOIN k USING (question_id, place)), f AS (SELECT question_id, response_key, place FROM o QUALIFY row_number() OVER (PARTITION BY question_id, response_key ORDER BY n DESC, place) = 1) SELECT question_id, place, CAST(count(*) AS BIGINT) AS n_quoted FROM f GROUP BY ALL")
def wn07_quoted_once(spark: SparkSession, d: str) -> DataFrame:
    """With room for all, every response is quoted under the place of its question that most responses name."""
    p = corpus(spark, d, "question_id", "locations").select("question_id", "response_key", F.explode(F.array_distinct("locations")).alias("place"))
    return sampling.first_place(p, ["question_id"]).groupBy("question_id", "place").agg(F.count(F.lit(1)).alias("n_quoted"))


# ---- routes and stages -----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'unanswerable' WHEN p_size % 2 = 0 THEN 'comparative' ELSE 'categories' END AS route, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 END AS n_labels, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS n_dropped, p_size % 5 <> 0 AND p_size % 2 = 0 AS has_groups, CASE WHEN p_size % 3 = 0 THEN 'night' ELSE '' END AS time FROM part")
def pr18_parsed_routes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with unknown and repeated labels, comparisons of one group, and a filter the data cannot answer."""
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))

    def work(r) -> dict:
        ids = [f"x{r.k}", f"y{r.k}"] if r.n % 5 == 0 else ["a", {"label_id": "b", "relevance": "HIGH"}, "a", f"x{r.k}"]
        groups = [{"name": "one", "label_ids": ["a", "zz"]}, {"name": "", "label_ids": ["b"]}] if r.n % 2 == 0 else [{"name": "one", "label_ids": ["a", "b"]}]
        got = routes.parse({"route": "Comparative", "candidates": ids, "groups": groups, "time_filter": "NIGHT"}, {"a", "b", "c"}, available={"time"} if r.n % 3 == 0 else set())
        return {"k": r.k, "route": got.route, "n_labels": len(got.labels), "n_dropped": got.dropped.get("labels", 0), "has_groups": bool(got.groups), "time": got.filters.time}

    return each_row(p, "k long, route string, n_labels int, n_dropped int, has_groups boolean, time string", work)


@query("SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 'refused' ELSE 'b,c' END AS labels, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'two:b' END AS groups FROM part")
def pr19_approved_routes(spark: SparkSession, d: str) -> DataFrame:
    """A selection narrower and wider than the proposal; one with an unknown label is refused."""
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))

    def work(r) -> dict:
        made = routes.parse({"route": "comparative", "candidates": ["a", "b"], "groups": [{"name": "one", "label_ids": ["a"]}, {"name": "two", "label_ids": ["a", "b"]}]}, {"a", "b", "c"})
        chosen = ["b", "c", "b"] + (["nope"] if r.n % 4 == 0 else [])
        try:
            got = routes.from_selection(made, chosen, {"a", "b", "c"})
        except ValueError:
            return {"k": r.k, "labels": "refused", "groups": ""}
        return {"k": r.k, "labels": ",".join(got.labels), "groups": "|".join(f"{n}:{','.join(i)}" for n, i in got.groups)}

    return each_row(p, "k long, labels string, groups string", work)


def _by_brand(spark: SparkSession, d: str) -> DataFrame:
    """Per brand its parts in order, as (key, name, type)."""
    p = read(spark, d, "part", "p_brand", "p_partkey", "p_name", "p_type", "p_size")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", "p_size"))).alias("parts"))


@query("WITH n AS (SELECT p_brand AS brand, lower(trim(p_name)) AS l, min(p_partkey) AS k FROM part GROUP BY ALL), f AS (SELECT n.brand, n.l, n.k, p.p_name FROM n JOIN part p ON p.p_partkey = n.k QUALIFY row_number() OVER (PARTITION BY n.brand ORDER BY n.k) <= 12) SELECT brand, string_agg(p_name, '|' ORDER BY k) AS themes FROM f GROUP BY 1")
def tx02_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """Names of a brand's parts as themes: each once whatever its case, twelve at most."""
    work = lambda r: {"brand": r.brand, "themes": "|".join(stages.vocabulary({"themes": [{"name": x["p_name"]} if x["p_partkey"] % 2 else x["p_name"] for x in r.parts] + ["", {"name": " "}]}))}
    return each_row(_by_brand(spark, d), "brand string, themes string", work)


@query("SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n_before, CAST(count(*) - count(*) FILTER (p_size % 3 = 0) + CASE WHEN count(*) FILTER (p_size % 3 = 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_after, CAST(count(*) AS BIGINT) AS n_members FROM part GROUP BY 1")
def tx04_dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    """One group of a third of a brand's labels, with a number that is not there and one named twice; what the reply forgets survives."""

    def work(r) -> dict:
        labels = [stages.Label(x["p_name"], x["p_type"], (str(x["p_partkey"]),)) for x in r.parts]
        third = [i for i, x in enumerate(r.parts, 1) if x["p_size"] % 3 == 0]
        out = stages.dedup({"groups": [{"name": "One", "members": [*third, *third, 10**6]}, {"name": "Two", "members": third[:1]}]}, labels)
        return {"brand": r.brand, "n_before": len(labels), "n_after": len(out), "n_members": len({m for x in out for m in x.members})}

    return each_row(_by_brand(spark, d), "brand string, n_before long, n_after long, n_members long", work)


@query("WITH t AS (SELECT p_brand AS brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1) SELECT brand, CAST(CASE WHEN types > 1 THEN 1 ELSE n END AS BIGINT) AS n_after FROM t")
def tx05_cross_merges(spark: SparkSession, d: str) -> DataFrame:
    """All labels of a brand in one group: refused where they are of one theme."""

    def work(r) -> dict:
        labels = [stages.Label(str(x["p_partkey"]), x["p_type"]) for x in r.parts]
        theme = {str(x["p_partkey"]): x["p_type"] for x in r.parts}
        return {"brand": r.brand, "n_after": len(stages.cross_merge({"groups": [{"members": list(range(1, len(labels) + 1))}]}, labels, theme))}

    return each_row(_by_brand(spark, d), "brand string, n_after long", work)


@query("SELECT p_brand AS brand, CAST(count(DISTINCT p_size % 7) AS BIGINT) AS n_groups FROM part GROUP BY 1")
def tx14_anchored_groups(spark: SparkSession, d: str) -> DataFrame:
    """Alike is an equivalence here, so the greedy groups are its classes."""
    from ..operators import taxonomy

    work = lambda r: {"brand": r.brand, "n_groups": len(taxonomy.anchored_groups([x["p_size"] for x in r.parts], lambda a, b: a % 7 == b % 7))}
    return each_row(_by_brand(spark, d), "brand string, n_groups long", work)


@query("WITH s AS (SELECT p_brand AS brand, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' ELSE 'c' END AS s FROM part), n AS (SELECT brand, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'b') AS b, count(*) AS n FROM s GROUP BY 1) SELECT brand, 'c:null' || CASE WHEN a >= b THEN ',b:a' ELSE ',a:b' END AS id_map, 'does_not_decompose' AS outcome FROM n")
def tx12_reviewed_sub_themes(spark: SparkSession, d: str) -> DataFrame:
    """Of two duplicates the larger stays, a restated category goes; with one sub-theme left the category no longer decomposes (TX-20)."""

    def work(r) -> dict:
        ids = {str(x["p_partkey"]): ["a" if x["p_size"] < 10 else "b" if x["p_size"] < 20 else "c"] for x in r.parts}
        counts = {s: sum(v == [s] for v in ids.values()) for s in "abc"}
        got = stages.review_sub_themes({"restatements": ["c", "zz"], "duplicates": [["a", "b", "c"], ["a"]]}, ["a", "b", "c"], counts)
        return {"brand": r.brand, "id_map": ",".join(f"{k}:{'null' if v is None else v}" for k, v in sorted(got.items(), key=lambda kv: (kv[1] is not None, kv[0]))), "outcome": stages.apply_review(ids, got)[1]}

    return each_row(_by_brand(spark, d), "brand string, id_map string, outcome string", work)


@query("WITH n AS (SELECT p_brand AS brand, p_name, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL), f AS (SELECT brand, count(*) AS names, count(*) FILTER (n > 1) AS repeated, sum(n - 1) AS extra FROM n GROUP BY 1) SELECT brand, CAST(names AS BIGINT) AS n_terms, CAST(1 AS BIGINT) AS invented, CAST(extra AS BIGINT) AS reused FROM f")
def ml06_grouped_terms(spark: SparkSession, d: str) -> DataFrame:
    """A concept per part with its name as term: used once, later uses and an invented term are dropped and counted."""

    def work(r) -> dict:
        names = list(dict.fromkeys(x["p_name"] for x in r.parts))
        document = {"concepts": [{"name": f"c{x['p_partkey']}", "terms": [x["p_name"].upper()]} for x in r.parts] + [{"name": "new", "terms": ["nobody said this"]}]}
        out, dropped = stages.grouped_terms(document, names)
        return {"brand": r.brand, "n_terms": sum(len(c["terms"]) for c in out), **dropped}

    return each_row(_by_brand(spark, d), "brand string, n_terms long, invented long, reused long", work)


@query("SELECT p_brand AS brand, CAST(2 + count(*) FILTER (p_size % 2 = 0) AS BIGINT) AS n_selected FROM part GROUP BY 1")
def ml08_ratified(spark: SparkSession, d: str) -> DataFrame:
    """A reply can only add what was missed: what it invents or has already changes nothing."""

    def work(r) -> dict:
        missed = [f"m{x['p_partkey']}" for x in r.parts]
        wanted = [f"m{x['p_partkey']}" for x in r.parts if x["p_size"] % 2 == 0]
        client = labeling.EchoClient(lambda system, user: json.dumps({"include": [*wanted, *wanted, "s1", "nobody"]}))
        return {"brand": r.brand, "n_selected": len(stages.ratify(client, "Which?", missed, ["s1", "s2"]))}

    return each_row(_by_brand(spark, d), "brand string, n_selected long", work)


@query("SELECT p_brand AS brand, CAST(count(*) - 1 AS BIGINT) AS n_pairs, CAST(count(*) FILTER (pos % 12 <> 11 AND pos < n - 1) AS BIGINT) AS n_ruled FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part) GROUP BY 1")
def ml10_ruled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring parts as pairs in batches of twelve; the twelfth of a batch gets an unknown verdict and stays unruled."""

    def work(r) -> dict:
        names = [str(x["p_partkey"]) for x in r.parts]
        pairs = list(zip(names, names[1:]))
        reply = lambda system, user: json.dumps({"rulings": [{"pair": n, "verdict": "maybe" if n == 12 else " Same"} for n in range(1, len(user.splitlines()) + 1)]})
        return {"brand": r.brand, "n_pairs": len(pairs), "n_ruled": len(stages.rule_pairs(labeling.EchoClient(reply), pairs))}

    return each_row(_by_brand(spark, d), "brand string, n_pairs long, n_ruled long", work)


@query("SELECT p_brand AS brand, CASE WHEN count(DISTINCT p_size % 5) FILTER (p_size % 5 < 2) >= 2 THEN 'ok' ELSE 'does_not_decompose' END AS outcome, CAST(CASE WHEN count(DISTINCT p_size % 5) FILTER (p_size % 5 < 2) >= 2 THEN count(*) FILTER (p_size % 5 < 2) ELSE 0 END AS BIGINT) AS n_members FROM part GROUP BY 1")
def tx11_induced_sub_themes(spark: SparkSession, d: str) -> DataFrame:
    """Two sub-themes found in every chunk of twenty, united over chunks with their evidence."""

    def work(r) -> dict:
        rows = [(str(x["p_partkey"]), f"size {x['p_size']}") for x in r.parts]
        chunks = [rows[i : i + 20] for i in range(0, len(rows), 20)]

        def reply(system: str, user: str) -> str:
            if system.startswith("Group"):
                return json.dumps({"groups": []})
            sizes = [int(line.rsplit(" ", 1)[1]) for line in user.splitlines()]
            return json.dumps({"sub_themes": [{"name": f"Rest {m}!", "responses": [i for i, s in enumerate(sizes, 1) if s % 5 == m] + [999]} for m in (0, 1)]})

        got = stages.induce_sub_themes(labeling.EchoClient(reply), "category", chunks)
        return {"brand": r.brand, "outcome": got.outcome, "n_members": sum(len(x.members) for x in got.labels)}

    return each_row(_by_brand(spark, d), "brand string, outcome string, n_members long", work)


# ---- keys, files, streams --------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS k, substr(sha256('{\"a\":' || p_size || ',\"name\":\"' || p_name || '\",\"z\":[1,\"x\"]}'), 1, 32) AS key FROM part")
def sf05_canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), "p_size", "p_name")
    return each_row(p, "k long, key string", lambda r: {"k": r.k, "key": hashing.canonical_key({"z": [1, "x"], "name": r.p_name, "a": int(r.p_size)})})


@query("SELECT upload_id, NOT regexp_matches(lower(stored_filename), '\\.(csv|xlsx|xls)$') AS is_refused, CASE WHEN upload_id % 2 = 0 THEN '.xls' ELSE '.csv' END AS suffix FROM uploads")
def sc03_checked_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are stored, and with a suffix in capitals."""
    u = read(spark, d, "uploads", "upload_id", "stored_filename")
    work = lambda r: {"upload_id": r.upload_id, "is_refused": raises(lambda: readers.check_upload(r.stored_filename)), "suffix": readers.check_upload(f"file {r.upload_id}" + (".XLS" if r.upload_id % 2 == 0 else ".Csv"))}
    return each_row(u, "upload_id long, is_refused boolean, suffix string", work)


@query("SELECT upload_id, count(*) < 2 OR upload_id % 5 = 0 AS is_refused FROM column_fingerprints GROUP BY 1")
def pr08_checked_selections(spark: SparkSession, d: str) -> DataFrame:
    """Per file its first two columns as questions, where it has them; every fifth file has one of them chosen twice."""
    c = read(spark, d, "column_fingerprints", "upload_id", "column_name").groupBy("upload_id").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))  # the columns of one file

    def work(r) -> dict:
        columns = list(r.columns)
        first = columns[:2] if len(columns) > 1 else [*columns, "no such column"]
        metadata = first[:1] if r.upload_id % 5 == 0 else []
        return {"upload_id": r.upload_id, "is_refused": raises(lambda: reshape.check_selection(columns, first, metadata, dict.fromkeys(columns, 1)))}

    return each_row(c, "upload_id long, is_refused boolean", work)


@query("SELECT p_partkey AS k, p_size % 3 = 0 OR p_size % 4 = 0 OR p_size % 5 = 0 AS is_refused FROM part")
def dt05_checked_periods(spark: SparkSession, d: str) -> DataFrame:
    """Two periods that overlap, have no label, or end before they start, by the size of a part."""
    p = read(spark, d, "part", F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))

    def work(r) -> dict:
        first = {"label": " " if r.n % 3 == 0 else "First", "start": "2021-01-01", "end": "2020-01-01" if r.n % 5 == 0 else "2021-06-30"}
        second = {"label": "Second", "start": "2021-06-30" if r.n % 4 == 0 else "2021-07-01", "end": "2021-12-31"}
        return {"k": r.k, "is_refused": raises(lambda: dates.periods([first, second]))}

    return each_row(p, "k long, is_refused boolean", work)


@query(f"WITH {C}, h AS (" + " UNION ALL ".join(f"SELECT question_id, '{n}' AS concept FROM c WHERE regexp_matches(response_text, '{s}')" for n, s in _CONCEPT_SQL.items()) + ") SELECT concept, CAST(count(*) AS BIGINT) AS n, TRUE AS is_reused FROM h GROUP BY 1")
def sc13_stored_matches(spark: SparkSession, d: str) -> DataFrame:
    """A sweep stored once and read again; other concepts or another corpus are a miss."""
    c = corpus(spark, d, "question_id", "response_text")
    place = scratch(spark, "matches")
    build = lambda found: tallies.concept_matches(found, CONCEPTS).select("response_key", "question_id", "concept")
    readers.cached_matches(spark, place, c, "response_key", "response_text", "v1", CONCEPTS, build)
    got, hit = readers.cached_matches(spark, place, c, "response_key", "response_text", "v1", CONCEPTS, build)
    fewer, other = readers.cached_matches(spark, place, c, "response_key", "response_text", "v1", {"bins": ["bin"]}, lambda f: build(f).limit(0))
    return got.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).withColumn("is_reused", F.lit(hit and not other))


@query(f"WITH {C} SELECT question_id, 'r2' AS run_id, CAST(count(*) AS BIGINT) AS n FROM c WHERE uncategorized IS NOT NULL GROUP BY 1 UNION ALL SELECT question_id, 'r1', count(*) FROM c GROUP BY 1")
def sk06_appended_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs stored beside each other, read back by partition."""
    place = scratch(spark, "runs")
    c = corpus(spark, d, "question_id", "uncategorized")
    for run, rows in (("r1", c), ("r2", c.where("uncategorized IS NOT NULL"))):
        sinks.append_runs(rows.select("question_id", "response_key"), place, run)
    return spark.read.parquet(place).groupBy(F.col("question_id").cast("long").alias("question_id"), "run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C}, {M} SELECT label_id, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def sk08_stored_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates written before they are used, and read from there."""
    m = corpora.members(corpus(spark, d, "dataset_id", "question_id", "label_ids"))
    return sinks.checkpoint_candidates(m, scratch(spark, "candidates")).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset_id, name, CAST(1 AS BIGINT) AS n_lines, FALSE AS has_part FROM datasets")
def sk05_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document and a log line per dataset, each file written over once; no half-written file is left (SK-05, SK-07)."""
    from ..sources.files import Files

    place = scratch(spark, "documents")
    files = Files(spark)
    rows = read(spark, d, "datasets", "dataset_id", "name").collect()  # one document per dataset
    document, log = (lambda r, n=n: f"{place}/{r.dataset_id}/{n}" for n in ("dataset.json", "log.jsonl"))
    files.each(files.write_json, [({"dataset_id": r.dataset_id, "name": "old"}, document(r)) for r in rows])
    files.each(files.write_json, [(r.asDict(), document(r)) for r in rows])
    files.each(files.append_jsonl, [({"asked": r.dataset_id}, log(r)) for r in rows])
    found = files.each(files.read_json, [(p,) for p in files.matching(f"{place}/*/dataset.json")])
    logs = files.each(files.read_text, [(p,) for p in files.matching(f"{place}/*/log.jsonl")])
    asked = Counter(json.loads(line)["asked"] for text in logs for line in text.splitlines())
    left = bool(files.matching(f"{place}/*/*.part"))
    back = [(x["dataset_id"], x["name"], asked[x["dataset_id"]], left) for x in found if x["dataset_id"] in asked]
    return spark.createDataFrame(back, "dataset_id long, name string, n_lines long, has_part boolean")


@query("WITH h AS (SELECT DISTINCT dataset_id, upload_id, row_index, lower(row_hash) AS h FROM row_hashes), o AS (SELECT h.*, dense_rank() OVER (PARTITION BY dataset_id ORDER BY u.row_offset) AS b FROM h JOIN uploads u USING (dataset_id, upload_id)), k AS (SELECT dataset_id, h, b, count(*) AS n FROM o GROUP BY ALL), m AS (SELECT dataset_id, h, max(n) AS kept FROM (SELECT dataset_id, h, b, n FROM k) GROUP BY ALL) SELECT dataset_id, CAST(sum(kept) AS BIGINT) AS n_held FROM m GROUP BY 1")
def st02_replayed_waves(spark: SparkSession, d: str) -> DataFrame:
    """Files of a dataset appended one after the other, each batch delivered twice: of a hash as many rows are held as one file had at most."""
    h = read(spark, d, "row_hashes", "dataset_id", "upload_id", "row_index", F.lower("row_hash").alias("row_hash")).distinct()
    at = h.join(read(spark, d, "uploads", "dataset_id", "upload_id", "row_offset"), ["dataset_id", "upload_id"])
    wave = append.wave_numbers(at)
    place = scratch(spark, "waves")
    for i in range(1, wave.agg(F.max("wave")).first()[0] + 1):  # as many batches as a dataset has files
        part = wave.where(F.col("wave") == i)
        for _ in range(2):
            append.append_new(part, i, place)
    return spark.read.parquet(place).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_held"))


@query(f"WITH {C} SELECT response_key FROM c WHERE uncategorized IS NULL")
def st03_unseen_responses(spark: SparkSession, d: str) -> DataFrame:
    """The stream-static anti join, on a batch."""
    c = corpus(spark, d, "uncategorized")
    return append.unseen(c, corpora.coded(c)).select("response_key")


@query("SELECT CAST(year(ts) AS VARCHAR) || '-' || lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS period, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def st04_period_totals(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the whole table: each period has one total, and nothing is too late for it."""
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_folder_of(spark, d, "events")).select(F.col("ts").cast("date").cast("string").alias("day"), F.col("ts").alias("loaded"))
    name = "periods_" + scratch(spark, "x").rsplit("/", 2)[1]
    q = append.period_stream(stream, "day", "month").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "period_state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _folder_of(spark: SparkSession, d: str, name: str) -> str:
    """A folder that holds the table's files, as streams read folders."""
    place = scratch(spark, name)
    read(spark, d, name).write.parquet(place)
    return place
