"""Taxonomies: overlaps, duplicates, merges, assembly, edits (JN-10 .. JN-12, AG-21, AG-33, AG-34, TX-01 .. TX-20, SF-10, SF-16)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PLAN_STOPWORDS, QUESTION_STOPWORDS, REVIEW_STOPWORDS, normalized_name, shared_tokens, tokens
from ..session import shared_table


def label_overlaps(members: DataFrame, least: int = 4) -> DataFrame:
    """JN-10: pairs of labels with shared responses: sizes and shared, overlap being shared / smaller.

    Pairs come from the labels of each single response (a handful), so only pairs that do meet are ever made; labels of fewer than
    ``least`` responses are dropped before.
    """
    sizes = members.groupBy("label_id").agg(F.count_distinct("response_key").alias("n")).where(F.col("n") >= least)
    own = members.join(sizes.select("label_id"), "label_id", "left_semi").groupBy("response_key").agg(F.sort_array(F.collect_set("label_id")).alias("l"))
    pair = F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("label_a"), y.alias("label_b"))))))
    shared = own.where(F.size("l") > 1).select(pair.alias("p")).groupBy("p.label_a", "p.label_b").agg(F.count(F.lit(1)).alias("shared"))
    side = lambda s: sizes.select(F.col("label_id").alias(f"label_{s}"), F.col("n").alias(f"n_{s}"))
    return shared.join(side("a"), "label_a").join(side("b"), "label_b")


def strongly_overlapping(overlaps: DataFrame, percent: int = 40) -> DataFrame:
    """JN-10: overlap coefficient of at least ``percent`` hundredths, compared in integers."""
    return overlaps.where(100 * F.col("shared") >= percent * F.least("n_a", "n_b"))


def similar_names(labels: DataFrame, scope: list[str], percent: int = 50, stopwords: tuple[str, ...] = PLAN_STOPWORDS) -> DataFrame:
    """JN-11, JN-12: pairs of names whose token sets have a Jaccard similarity of at least ``percent`` hundredths.

    Candidates share a token: an equi-join on tokens instead of all pairs.
    """
    t = labels.select(*scope, "label_id", tokens(F.col("name"), stopwords).alias("t"))
    words = t.select(*scope, "label_id", "t", F.explode("t").alias("w"))
    a, b = words.alias("a"), words.alias("b")
    inter, union = shared_tokens(F.col("a.t"), F.col("b.t"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*scope, "w"]]
    return (
        a.join(b, same).where("a.label_id < b.label_id").where(100 * inter >= percent * union)
        .select(*[F.col(f"a.{c}").alias(c) for c in scope], F.col("a.label_id").alias("label_a"), F.col("b.label_id").alias("label_b"), inter.alias("n_shared"), union.alias("n_union"))
        .distinct()
    )


def duplicate_candidates(labels: DataFrame, members: DataFrame, percent: int = 40, least: int = 5, top: int = 8) -> DataFrame:
    """JN-11: per question the ``top`` pairs of labels whose names, or whose members (of at least ``least`` in the smaller), overlap by ``percent`` hundredths.

    Name similarity is shared words out of all, member overlap shared members out of the smaller's; both stay pairs of integers, the larger ratio ranks.
    """
    names = similar_names(labels, ["question_id"], percent, REVIEW_STOPWORDS)
    common = label_overlaps(members, least).where(100 * F.col("shared") >= percent * F.least("n_a", "n_b"))
    side = labels.select(F.col("label_id").alias("label_a"), "question_id")
    other = labels.select(F.col("label_id").alias("label_b"), F.col("question_id").alias("_q"))
    inside = common.join(side, "label_a").join(other, "label_b").where("question_id = _q").select("question_id", "label_a", "label_b", "shared", F.least("n_a", "n_b").alias("n_smaller"))
    both = names.join(inside, ["question_id", "label_a", "label_b"], "full").na.fill(0, ["n_shared", "n_union", "shared", "n_smaller"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    score = F.greatest(ratio("n_shared", "n_union"), ratio("shared", "n_smaller"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(score.desc(), "label_a", "label_b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)


#: JN-12: which pairs a kind of nomination may hold.
SPECIES = ("category", "category_sameq", "subtheme_xcat", "subtheme_xq")


#: How many labels of one name at most meet those of another in one row of the join.
BLOCK_LABELS = 1024


def nominate(items: DataFrame, species: str | tuple[str, ...], percent: int = 40, forced: DataFrame | None = None) -> DataFrame:
    """JN-12: pairs worth a ruling, of names with ``percent`` hundredths of their words in common, or forced.

    ``items``: question_id, label_id, name (and category_id for sub-themes).  Species: categories of different questions, categories of one question,
    sub-themes of different categories of one question, sub-themes of different questions; of several species each gives its rows.  ``forced``:
    label_a, label_b in either order; it never breaks the species.

    Word sets are compared, each once, not labels.  Labels are held in blocks by their set, blocks of similar sets meet, and pairs are formed in that
    join: they grow with the square of the labels that share a name, so none is shuffled.
    """
    asked = (species,) if isinstance(species, str) else tuple(species)
    if unknown := [s for s in asked if s not in SPECIES]:
        raise ValueError(f"no such species: {', '.join(unknown)}")
    extra = ["category_id"] if "category_id" in items.columns else []
    if "subtheme_xcat" in asked and not extra:
        raise ValueError("sub-themes of different categories need a category_id")
    held = shared_table(items.select("label_id", "question_id", *extra, tokens(F.col("name"), PLAN_STOPWORDS).alias("t")))
    rows, named = held, None
    if forced is not None:
        named = forced.select(F.least("label_a", "label_b").alias("label_a"), F.greatest("label_a", "label_b").alias("label_b")).distinct()
        named = shared_table(named)
        rows = rows.join(named.groupBy(F.col("label_a").alias("label_id")).agg(F.collect_list("label_b").alias("_named")), "label_id", "left")
    rows = rows.withColumn("t", F.array_sort("t"))
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_LABELS)
    sets = shared_table(rows.groupBy("t").agg(blocks.alias("blocks")).where(F.size("t") > 0).withColumn("_set", F.monotonically_increasing_id()))
    words = sets.select("_set", "t", F.explode("t").alias("w"))
    x, y = words.alias("x"), words.alias("y")
    inter, union = shared_tokens(F.col("x.t"), F.col("y.t"))
    near = (
        x.join(y, F.col("x.w") == F.col("y.w")).where(F.col("x._set") <= F.col("y._set")).where(100 * inter >= percent * union)
        .select(F.col("x._set").alias("set_a"), F.col("y._set").alias("set_b"), inter.alias("n_shared"), union.alias("n_union")).distinct()
    )
    in_block = F.pmod(F.xxhash64("label_id"), F.col("blocks").cast("long"))
    one = F.struct("label_id", "question_id", *extra, *(["_named"] if named is not None else []))
    held_blocks = shared_table(rows.join(sets, "t").withColumn("_block", in_block).groupBy("_set", "_block").agg(F.collect_list(one).alias("_labels")))
    side = lambda s: held_blocks.select(F.col("_set").alias(f"set_{s}"), F.col("_block").alias(f"block_{s}"), F.col("_labels").alias(f"labels_{s}"))
    within = F.col("set_a") == F.col("set_b")
    ids = lambda s: held_blocks.select(F.col("_set").alias(f"set_{s}"), F.col("_block").alias(f"block_{s}"))
    meeting = shared_table(near.join(ids("a"), "set_a").join(ids("b"), "set_b").where(~within | (F.col("block_a") <= F.col("block_b"))))
    met = meeting.join(side("a"), ["set_a", "block_a"]).join(side("b"), ["set_b", "block_b"])
    met = met.withColumn("_own", within & (F.col("block_a") == F.col("block_b")))
    # a row stands for up to BLOCK_LABELS squared pairs: a few rows a task, however few bytes they are
    met = met.repartition(min(10_000, meeting.count() // 2 + 1), "set_a", "block_a", "set_b", "block_b")
    pair = met.select("n_shared", "n_union", "_own", "labels_b", F.explode("labels_a").alias("a")).select("n_shared", "n_union", "_own", "a", F.explode("labels_b").alias("b"))
    a, b = F.col("a.label_id"), F.col("b.label_id")
    pair = pair.where(F.when(F.col("_own"), a < b).otherwise(a != b))
    if named is not None:
        there = lambda p, q: F.coalesce(F.array_contains(F.col(f"{p}._named"), F.col(f"{q}.label_id")), F.lit(False))
        pair = pair.where(~there("a", "b") & ~there("b", "a"))
    fields = ["label_id", "question_id", *extra]
    pair = pair.select(*[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in fields], "n_shared", "n_union", F.lit(False).alias("forced"))
    if named is not None:
        t = lambda s: held.select(*[F.col(c).alias(f"{s}_{c}") for c in fields], F.col("t").alias(f"t_{s}"))
        inter, union = shared_tokens(F.col("t_a"), F.col("t_b"))
        both = named.toDF("a_label_id", "b_label_id").join(t("a"), "a_label_id").join(t("b"), "b_label_id")
        pair = pair.unionByName(both.select(*pair.columns[: 2 * len(fields)], inter.alias("n_shared"), union.alias("n_union"), F.lit(True).alias("forced")))
    same = F.col("a_question_id") == F.col("b_question_id")
    listed = lambda kinds: F.array(*[F.lit(s) for s in asked if s in kinds]).cast("array<string>")
    fits = F.when(~same, listed(("category", "subtheme_xq")))
    if extra:
        fits = fits.when(same & (F.col("a_category_id") != F.col("b_category_id")), listed(("category_sameq", "subtheme_xcat")))
    fits = fits.when(same, listed(("category_sameq",)))
    a, b = F.col("a_label_id"), F.col("b_label_id")
    return pair.select(F.least(a, b).alias("label_a"), F.greatest(a, b).alias("label_b"), F.explode(fits).alias("species"), "n_shared", "n_union", "forced")


def diagnostics(taxonomy: DataFrame, members: DataFrame, corpus: DataFrame) -> DataFrame:
    """AG-21: categories, those without members, without parent, with a name used twice, and the pool of uncovered responses."""
    n = members.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    names = Window.partitionBy("question_id", normalized_name(F.col("name")))
    t = taxonomy.join(n, "label_id", "left").withColumn("same_name", F.count(F.lit(1)).over(names))
    per = t.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if(F.col("n").isNull()).alias("zero_count"), F.count_if(F.col("parent_id").isNull()).alias("orphans"), F.count_if(F.col("same_name") > 1).alias("duplicate_names")
    )
    pool = corpus.groupBy("question_id").agg(
        F.count_if(F.coalesce("uncategorized", F.lit(False)) | F.coalesce(F.col("fit") == 1, F.lit(False))).alias("pool"), F.count_if(F.col("uncategorized").isNotNull()).alias("coded")
    )
    return per.join(pool, "question_id", "left")


def chunk_support(candidates: DataFrame) -> DataFrame:
    """AG-33: distinct chunks and members per label."""
    return candidates.groupBy("label_id").agg(F.count_distinct("chunk").alias("chunk_support"), F.count(F.lit(1)).alias("n_members"))


def merge_by_name(candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """AG-34: candidates of one normalised name become one: first name, longest description, includes once each in order.

    ``scope`` keeps questions apart; where candidates have a ``batch``, ``n_chunks`` counts the chunks that proposed one.
    """
    c = candidates.withColumn("norm", normalized_name(F.col("name")))
    lists = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "include"))), lambda s: s["include"])))
    longest = F.min_by("description", F.struct(-F.length("description"), F.col("position")))
    chunks = [F.count_distinct("batch").alias("n_chunks")] if "batch" in c.columns else []
    return c.groupBy(*(scope or []), "norm").agg(F.min_by("name", "position").alias("name"), longest.alias("description"), lists.alias("include"), F.count(F.lit(1)).alias("n_merged"), F.min("position").alias("position"), *chunks)


def assemble(labels: DataFrame, n_chunks: int | Column) -> DataFrame:
    """TX-06: labels by support and name get their sequence ids, parents theirs in order of their names; those seen in one chunk of several need review.

    ``labels`` has a ``parent`` (a name) where themes were assigned.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc("chunk_support"), "name")
    several = (n_chunks if isinstance(n_chunks, Column) else F.lit(n_chunks)) > 1
    numbered = labels.withColumn("seq", F.row_number().over(order)).withColumn("needs_review", (F.col("chunk_support") == 1) & several)
    own = F.concat(F.col("question_id").cast("string"), F.lit("_"), F.lpad(F.col("seq").cast("string"), 3, "0"))
    out = numbered.withColumn("label_id", own).withColumn("singleton", F.col("chunk_support") == 1)
    if "parent" not in labels.columns:
        return out.select("question_id", "label_id", "name", "chunk_support", "singleton", "needs_review")
    themes = labels.where("parent IS NOT NULL").select("question_id", "parent").distinct()
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("parent"))
    ids = themes.select("question_id", "parent", F.concat(F.col("question_id").cast("string"), F.lit("_P"), F.lpad(place.cast("string"), 2, "0")).alias("parent_id"))
    return out.join(ids, ["question_id", "parent"], "left").select("question_id", "label_id", "name", "parent_id", "chunk_support", "singleton", "needs_review")


def resolve_evidence(cited: DataFrame, chunk: DataFrame, cap: int = 10) -> DataFrame:
    """TX-01: prompt numbers to rows: unknown numbers are counted, repeated ones dropped, at most ``cap`` kept in order."""
    each = cited.select("label_id", F.posexplode("numbers").alias("at", "number")).groupBy("label_id", "number").agg(F.min("at").alias("at"))
    there = each.join(chunk.select(F.col("position").alias("number"), "response_key"), "number", "left")
    rank = F.row_number().over(Window.partitionBy("label_id").orderBy(F.col("response_key").isNull(), "at"))
    return there.withColumn("rank", rank).groupBy("label_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("response_key").isNotNull() & (F.col("rank") <= cap), F.struct("at", "response_key")))), lambda s: s["response_key"]).alias("evidence"),
        F.count_if(F.col("response_key").isNull()).alias("n_invalid"),
    )


def first_answers(answers: DataFrame, themes: DataFrame) -> DataFrame:
    """TX-03: the first answer per label wins; a theme nobody knows is unsorted."""
    first = answers.groupBy("label_id").agg(F.min_by("theme", "position").alias("theme"))
    known = themes.select(F.col("name").alias("theme"), F.lit(True).alias("known"))
    return first.join(known, "theme", "left").select("label_id", F.when(F.col("known"), F.col("theme")).otherwise("(unsorted)").alias("theme"))


def last_sequence(labels: DataFrame) -> DataFrame:
    """SF-15: per question the greatest number of an incremental id (``7_i012``), 0 where there is none."""
    number = F.regexp_extract("label_id", r"^\d+_i(\d+)$", 1)
    return labels.groupBy("question_id").agg(F.max(F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0))).alias("last"))


def extend(taxonomy: DataFrame, proposed: DataFrame) -> DataFrame:
    """TX-09, SF-15: proposals with a new name get the next incremental ids of their question, the others are dropped.

    A proposal may name a ``parent``: one the taxonomy has (``parent_id``) is taken, any other leaves the label an orphan for review.
    Proposals without ``question_id`` are made for every question of the taxonomy; of each name only the first meets the questions.
    """
    norm = normalized_name(F.col("name"))
    if "question_id" not in proposed.columns:
        firsts = [F.min_by(c, "position").alias(c) for c in proposed.columns if c not in ("norm", "position")]
        each = proposed.withColumn("norm", norm).groupBy("norm").agg(*firsts, F.min("position").alias("position")).drop("norm")
        proposed = shared_table(each).crossJoin(shared_table(taxonomy.select("question_id").distinct()))
    new = proposed.withColumn("norm", norm).join(taxonomy.where("name IS NOT NULL").select("question_id", norm.alias("norm")).distinct(), ["question_id", "norm"], "left_anti")
    seq = F.row_number().over(Window.partitionBy("question_id").orderBy("position"))
    # the first proposal of a name stands for it; ids beyond 999 grow a digit
    parent = [F.min_by("parent", "position").alias("parent_id")] if "parent" in proposed.columns else []
    first = new.groupBy("question_id", "norm").agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"), *parent)
    number = F.col("seq").cast("string")
    made = first.join(last_sequence(taxonomy), "question_id", "left").withColumn("seq", seq + F.coalesce("last", F.lit(0)))
    own = F.concat(F.col("question_id").cast("string"), F.lit("_i"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0"))
    out = made.withColumn("label_id", own)
    if not parent:
        return out.select("question_id", "label_id", "name")
    known = taxonomy.where("parent_id IS NOT NULL").select("question_id", "parent_id", F.lit(True).alias("known")).distinct()
    return out.join(known, ["question_id", "parent_id"], "left").select("question_id", "label_id", "name", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))


def remap(ids: Column, id_map: dict[str, str | None]) -> Column:
    """SF-16: ids through a merge map; null drops an id, each result is kept once, in order."""
    if not id_map:
        return ids
    pairs = [F.lit(x) for k, v in id_map.items() if v is not None for x in (k, v)]
    gone = [k for k, v in id_map.items() if v is None]
    out = F.filter(ids, lambda i: ~i.isin(*gone)) if gone else ids
    if pairs:
        table = F.create_map(*pairs)
        out = F.transform(out, lambda i: F.coalesce(F.try_element_at(table, i), i))
    return F.array_distinct(out)


def candidate_misses(entries: DataFrame, question: str, selected: list[str], comparative: bool = False, cap: int = 12) -> DataFrame:
    """SF-10: unselected categories that share two tokens with the question, or one long one, or (comparing) a selected one's parent."""
    asked = F.array_except(tokens(F.lit(question)), F.array(*map(F.lit, QUESTION_STOPWORDS)))
    own = tokens(F.concat_ws(" ", "name", "description"))
    hits = F.array_intersect(asked, own)
    near = entries.where(F.col("label_id").isin(*selected)).select("parent_id").where("parent_id IS NOT NULL").distinct().withColumn("near", F.lit(True))
    sibling = F.coalesce(F.col("near"), F.lit(False)) & F.lit(comparative)
    return (
        entries.where(~F.col("label_id").isin(*selected)).join(near, "parent_id", "left")
        .where((F.size(hits) >= 2) | F.exists(hits, lambda h: F.length(h) >= 5) | sibling)
        .select("label_id", (F.size(hits) + sibling.cast("int")).alias("score"))
        .orderBy(F.desc("score"), "label_id").limit(cap)
    )


ORDERS = ("name", "id", "score")


def ordering(rows: DataFrame, how: str, by: list[str]) -> DataFrame:
    """WN-15: the rank of a category under ``by``: by count and lower-cased name, by count and id, or by score and id."""
    if how not in ORDERS:
        raise ValueError(f"no such order: {how}")
    keys = {"name": [F.desc("n"), F.lower("name"), F.col("label_id")], "id": [F.desc("n"), F.col("label_id")], "score": [F.desc("score"), F.col("label_id")]}[how]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def headings(heads: DataFrame, labels: DataFrame, percent: int = 34) -> DataFrame:
    """TX-16: each heading with the category of every question whose name is most like it, above ``percent`` hundredths; candidates share a word."""
    g = heads.select("heading", tokens(F.col("heading")).alias("g"), F.explode(tokens(F.col("heading"))).alias("w"))
    t = labels.select("question_id", "label_id", tokens(F.col("name")).alias("t"), F.explode(tokens(F.col("name"))).alias("w"))
    i, u = shared_tokens(F.col("g"), F.col("t"))
    near = t.join(g, "w").select("question_id", "heading", "label_id", i.alias("i"), u.alias("u")).distinct().where(100 * F.col("i") > percent * F.col("u"))
    return near.groupBy("question_id", "heading").agg(F.min_by("label_id", F.struct(-(F.col("i") / F.col("u")), F.col("label_id"))).alias("label_id"))


def search(entries: DataFrame, needle: str) -> DataFrame:
    """TX-15: categories whose name, description or parent contains the text; hits in the name come first."""
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    rank = F.when(has("name"), 0).when(has("description"), 1).when(has("parent_id"), 2)
    return entries.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name", "label_id")


def fused_lines(lines: DataFrame, rulings: DataFrame | None = None, percent: int = 50) -> DataFrame:
    """TX-13: lines of section plans (plan_id, position, label_id, name) in groups of one idea, by complete linkage: ``plan_id, label_id, group_no``.

    With ``rulings`` (label_a, label_b, verdict in force) two lines are one idea only where they are ruled the same; what nobody ruled on
    stays apart.  Without, names decide, strictly above ``percent`` hundredths of their words.  A plan is a few dozen lines; plans are worked through
    in parallel.
    """
    t = lines.withColumn("t", tokens(F.col("name")))
    pairs = None if rulings is None else rulings.where("verdict = 'same'").select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()
    if pairs is not None:
        ends = pairs.union(pairs.select("b", "a")).toDF("label_id", "other")
        same = ends.groupBy("label_id").agg(F.collect_set("other").alias("same"))
        t = t.join(same, "label_id", "left")
    else:
        t = t.withColumn("same", F.lit(None).cast("array<string>"))
    by_name = rulings is None

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["position", "label_id"])
        words = {r.label_id: set(r.t if r.t is not None else ()) for r in rows.itertuples()}
        ruled = {r.label_id: set(r.same if r.same is not None else ()) for r in rows.itertuples()}

        def alike(a: str, b: str) -> bool:
            if not by_name:
                return b in ruled[a]
            return bool(words[a] and words[b]) and 100 * len(words[a] & words[b]) > percent * len(words[a] | words[b])

        got = [(rows["plan_id"].iloc[0], x, n) for n, g in enumerate(complete_linkage(list(rows["label_id"]), alike)) for x in g]
        return pd.DataFrame(got, columns=["plan_id", "label_id", "group_no"])

    kind = dict(lines.dtypes)["plan_id"]
    return t.groupBy("plan_id").applyInPandas(group, f"plan_id {kind}, label_id string, group_no int")


def complete_linkage(names: list[str], alike) -> list[list[str]]:
    """TX-13 (driver side, the dozens of lines of one plan): a name joins the first group all of whose members it is alike to."""
    groups: list[list[str]] = []
    for n in names:
        for g in groups:
            if all(alike(n, m) for m in g):
                g.append(n)
                break
        else:
            groups.append([n])
    return groups


def anchored_groups(names: list[str], alike) -> list[list[str]]:
    """TX-14: a name joins the first group whose first member it is alike to."""
    groups: list[list[str]] = []
    for n in names:
        home = next((g for g in groups if alike(n, g[0])), None)
        if home is None:
            groups.append([n])
        else:
            home.append(n)
    return groups
