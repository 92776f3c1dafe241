import pytest
from pyspark.sql import functions as F

from voxframe.operators import corpus, estimate, filters, graph, induction, labeling, matching, ranking, reshape, review, sampling, tallies, taxonomy
from voxframe.plans import verify


def test_unpivot_wide_file(spark):
    wide = spark.createDataFrame([("1", "More parks", "Dark streets"), ("2", "Lower rent", ""), ("3", "", "Speeding cars"), ("4", None, " \t ")], "respondent_id string, better_city string, unsafe string")
    long = reshape.unpivot_answers(wide, ["respondent_id"], ["better_city", "unsafe"])
    assert long.count() == 4 and long.where("source_column = 'unsafe'").count() == 2
    kept = reshape.unpivot_attributes(wide, ["respondent_id"], ["unsafe", "no such"])
    assert kept.count() == 2


def test_multiset_flags(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "a")], "dataset_id long, row_hash string")
    file = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "dataset_id long, row_index long, row_hash string")
    flags = [r.is_duplicate for r in matching.flag_duplicates(file, stored, ["dataset_id"]).orderBy("row_index").collect()]
    assert flags == [True, True, False, False]


def test_dataset_matches(spark):
    stored = spark.createDataFrame([(7, h) for h in "abcd"], "dataset_id long, row_hash string")
    part = spark.createDataFrame([(1, h) for h in "abx"] + [(2, h) for h in "abcd"] + [(3, "a")] * 3, "file_id long, row_hash string")
    got = {r.file_id: (r.matched, r.file_rows, r.outcome) for r in matching.dataset_matches(part, stored).collect()}
    assert got == {1: (2, 3, "partial"), 2: (4, 4, "exact"), 3: (1, 3, "partial")}


def test_column_matches(spark):
    f = spark.createDataFrame([(1, "a", "x"), (1, "b", "y2"), (1, "c", "z"), (1, "n", "w")], "file_id long, column_name string, fingerprint string")
    s = spark.createDataFrame([(9, "a", "x"), (9, "b", "y"), (9, "d", "z"), (9, "m", "v")], "upload_id long, column_name string, fingerprint string")
    got = sorted(tuple(r)[2:] for r in matching.column_matches(f, s).collect())
    assert got == [("added", "", "n"), ("changed", "b", "b"), ("matched", "a", "a"), ("missing", "m", ""), ("renamed", "d", "c")]
    assert matching.column_match_report(matching.column_matches(f, s), f, s).first().is_alike


def corpus_frame(spark):
    rows = [
        ("1:2:0", "1:0", 2, ["2_001", "2_002"], False, 2, ["Downtown"], ["at night"], "specific", True),
        ("1:2:1", "1:1", 2, ["2_001"], False, 1, ["The streets"], ["every day"], "general", False),
        ("1:2:2", "1:2", 2, [], True, None, [], ["day and night"], None, False),
        ("1:2:3", "1:3", 2, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "response_key string, respondent_key string, question_id long, label_ids array<string>, uncategorized boolean, fit long, locations array<string>, time_context array<string>, actionability string, event_occurred boolean")


def test_chained_denominators(spark):
    c = corpus_frame(spark)
    f = filters.Filters(labels=("2_001", "2_002"), actionability="specific", event=True, time="night")
    r = filters.denominators(c, f).first()
    assert (r.actionability_in_scope, r.actionability_coded, r.actionability_matching) == (2, 2, 1)
    assert (r.event_in_scope, r.event_coded, r.event_matching, r.time_matching, r.n) == (1, 1, 1, 1, 1)
    assert [x.response_key for x in filters.select(c, f).collect()] == ["1:2:0"]


def test_day_and_night(spark):
    t = tallies.time_tally(corpus_frame(spark)).first()
    assert (t.mentioned, t.day, t.night, t.both, t.day_or_night) == (3, 1, 2, 1, 2)
    assert t.day + t.night - t.both == t.day_or_night


def test_demographics_or_within_and_across(spark):
    a = spark.createDataFrame([("1:0", "Sex", "Female"), ("1:2", "Sex", "Female"), ("1:1", "Sex", "Male"), ("1:0", "Age", "18-24"), ("1:1", "Age", "18-24"), ("1:2", "Age", "65+")], "respondent_key string, field string, value string")
    c = filters.with_attributes(corpus_frame(spark), a)
    r = filters.denominators(c, filters.Filters(demographics={"Sex": ("Female",), "Age": ("18-24", "65+")})).first()
    assert (r.demographic_in_scope, r.demographic_coded, r.demographic_matching) == (4, 3, 2)
    counts = {(x.field, x.value): x.n for x in tallies.facets(a, {"Sex": ["Female"], "Age": ["18-24"]}).collect()}
    assert counts == {("Sex", "Female"): 1, ("Sex", "Male"): 1, ("Age", "18-24"): 1, ("Age", "65+"): 1}
    assert tallies.facet_total(a, {"Sex": ["Female"], "Age": ["18-24"]}).first().n_matching == 1
    assert filters.check_demographics(a, {"Sex": ["Male", " "], "Age": []}) == {"Sex": ("Male",)}
    with pytest.raises(ValueError):
        filters.check_demographics(a, {"Sex": ["Other"]})


def test_counts_are_unions(spark):
    m = spark.createDataFrame([("1:2:0", "a"), ("1:2:1", "a"), ("1:2:1", "b"), ("1:2:2", "b"), ("1:2:2", "2_999")], "response_key string, label_id string")
    groups = spark.createDataFrame([("g", "a"), ("g", "b")], "group_name string, label_id string")
    assert tallies.unique_responses(m, groups).first().n_unique == 3
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "label_id string")
    assert {r.label_id: r.n for r in tallies.category_counts(m, t).collect()} == {"a": 2, "b": 2, "c": 0}
    assert [tuple(r) for r in tallies.unknown_labels(m, t).collect()] == [("2_999", 1)]


def test_span_counts(spark):
    c = spark.createDataFrame([(1, "k0", ["Downtown", "downtown"]), (1, "k1", ["the streets"]), (1, "k2", []), (1, "k3", None), (2, "k4", ["Streets"])], "question_id long, response_key string, locations array<string>")
    counts = tallies.span_counts(c)
    assert {r.span: r.n for r in counts.collect()} == {"downtown": 1, "streets": 2}
    assert tallies.span_report(counts, cap=0).first() == (2, 1, 1)


def test_overlaps(spark):
    m = spark.createDataFrame([(f"k{i}", x) for i in range(4) for x in ("L1", "L2")] + [("k9", "L1"), ("k9", "L3")], "response_key string, label_id string")
    r = taxonomy.label_overlaps(m).collect()
    assert [(x.label_a, x.label_b, x.shared, min(x.n_a, x.n_b)) for x in r] == [("L1", "L2", 4, 4)]


TAXONOMY = {"a": review.Label("A", "p"), "b": review.Label("B", "p"), "c": review.Label("C", "p"), "d": review.Label("D", "q"), "x": review.Label("X", "q")}


def edited(*edits):
    return review.Review(TAXONOMY, {"p": "Parent", "q": "Other"}).apply(edits)


def test_edits():
    e = edited({"op": "merge", "from": "a", "into": "b"}, {"op": "merge", "from": "b", "into": "c"}, {"op": "merge", "from": "x", "into": "d"}, {"op": "delete", "label_id": "d"})
    assert e.id_map() == {"d": None, "a": "c", "b": "c", "x": None}
    assert set(e.labels) == {"c"} and e.labels["c"].merged == ["b", "a"]
    assert set(TAXONOMY) == set("abcdx") and not TAXONOMY["c"].merged  # the input stays as it was


def test_add_parent_add_label_reparent_chain():
    e = edited(
        {"op": "add_parent", "parent_id": "n", "name": "New"}, {"op": "add_label", "label_id": "y", "parent_id": "n", "name": "Y"}, {"op": "reparent", "label_id": "a", "parent_id": "n"},
        {"op": "rename", "label_id": "a", "name": "A2", "description": "more"}, {"op": "rename", "parent_id": "n", "name": "Newer"}, {"op": "merge", "from": "b", "into": "a"}, {"op": "reparent", "label_id": "b", "parent_id": None},
    )
    assert e.parents["n"] == "Newer" and e.added == ["y"] and e.labels["y"].parent_id == "n"
    assert (e.labels["a"].name, e.labels["a"].description, e.labels["a"].parent_id) == ("A2", "more", None)  # b means a by now
    assert len(e.log) == 7


@pytest.mark.parametrize("edits", [
    [{"op": "merge", "from": "a", "into": "zz"}], [{"op": "merge", "from": "a", "into": "b"}, {"op": "merge", "from": "b", "into": "a"}], [{"op": "merge", "from": "a", "into": "a"}], [{"op": "delete", "label_id": "zz"}],
    [{"op": "delete", "label_id": "a"}, {"op": "rename", "label_id": "a", "name": "n"}], [{"op": "add_parent", "parent_id": "p", "name": "n"}], [{"op": "add_label", "label_id": "a", "name": "n"}],
    [{"op": "add_label", "label_id": "y", "parent_id": "zz", "name": "n"}], [{"op": "reparent", "label_id": "a", "parent_id": "zz"}], [{"op": "explode"}], [{"op": "merge", "from": "a", "into": "b"}, {"op": "add_label", "label_id": "a", "name": "n"}],
])
def test_an_edit_that_cannot_be_applied_raises(edits):
    with pytest.raises(ValueError):
        edited(*edits)


def test_edited_assignments(spark):
    r = spark.createDataFrame([(["a", "b", "d"], False), (["d"], False), (["zz", "c"], None), (None, None)], "label_ids array<string>, uncategorized boolean")
    e = edited({"op": "merge", "from": "a", "into": "b"}, {"op": "delete", "label_id": "d"})
    assert [tuple(x) for x in e.assignments(r).collect()] == [(["b"], False), ([], True), (["c"], None), ([], True)]


def test_remap_and_suggestions(spark):
    got = spark.createDataFrame([(["a", "b", "c", "d"],)], "l array<string>").select(taxonomy.remap(F.col("l"), {"a": "b", "d": None})).first()[0]
    assert got == ["b", "c"]
    members = [(f"r{i}", "a") for i in range(10)] + [(f"r{i}", "b") for i in range(4)] + [(f"r{i}", "c") for i in range(1, 5)] + [(f"r{i}", "q") for i in range(9)] + [("r1", "t")]
    m = spark.createDataFrame(members, "response_key string, label_id string")
    t = spark.createDataFrame([(1, x, p, n) for x, p, n in (("a", "p", "A"), ("b", "p", "B"), ("c", "p", "C"), ("q", "z", "Q"), ("t", "z", "c!"), ("e", "p", "E"), ("n", "p", None))], "question_id long, label_id string, parent_id string, name string")
    got = {tuple(x) for x in review.suggested_edits(t, m).collect()}
    assert got == {("merge", "b", "a"), ("merge", "c", "a"), ("merge", "t", "a"), ("delete", "e", None), ("delete", "n", None)}
    edits = [{"op": o, "from": x, "into": i, "label_id": x} for o, x, i in sorted(got, key=str)]
    assert set(review.Review({x.label_id: review.Label(x.name or "") for x in t.collect()}, {}).apply(edits).labels) == {"a", "q"}


def test_ranks_over_ranges_are_row_numbers(spark):
    import random

    r = random.Random(1)
    rows = [(s, r.randrange(50), i) for i, s in enumerate(["hot"] * 400 + [None] * 30 + ["x", "y"] * 20)]
    df = spark.createDataFrame(rows, "s string, o int, k int")
    got = {x.k: (x.rank, x.rank_of) for x in ranking.ranked(df, ["s"], ["o", "k"], with_size=True).collect()}
    for s in ("hot", None, "x", "y"):
        own = sorted((o, k) for t, o, k in rows if t == s)
        assert [got[k] for _, k in own] == [(i, len(own)) for i in range(1, len(own) + 1)]
    assert ranking.ranked(df.limit(0), ["s"], ["o", "k"]).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 310), (310, 305), (7, 7)]
    got = {x.c: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {310: 300, 305: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_terciles_like_a_sorted_list(spark):
    lengths = [1, 1, 2, 2, 2, 3, 5, 8, 8, 13, 21]
    df = spark.createDataFrame([(1, f"k{i}", "x" * n) for i, n in enumerate(lengths)], "g long, response_key string, t string")
    got = {len(x.t): x.band for x in sampling.length_tercile(df, ["g"], "t").collect()}
    s = sorted(lengths)
    lo, hi = s[len(s) // 3], s[2 * len(s) // 3]
    assert got == {n: "short" if n <= lo else "long" if n > hi else "mid" for n in lengths}


def test_fused_lines(spark):
    lines = spark.createDataFrame([(1, 1, "a", "Bus stops"), (1, 2, "b", "Bus stops and shelters"), (1, 3, "c", "Dark streets"), (1, 4, "d", "The bus stop"), (2, 1, "a", "Bus stops")], "plan_id long, position int, label_id string, name string")
    names = {x.label_id: x.name for x in lines.where("plan_id = 1").collect()}
    want = taxonomy.complete_linkage(list("abcd"), lambda x, y: verify.similarity(names[x], names[y]) > 0.5)
    got = {}
    for x in taxonomy.fused_lines(lines).where("plan_id = 1").collect():
        got.setdefault(x.group_no, []).append(x.label_id)
    assert sorted(got.values()) == sorted(want) == [["a", "b", "d"], ["c"]]
    ruled = spark.createDataFrame([("a", "c", "same"), ("b", "a", "distinct")], "label_a string, label_b string, verdict string")
    got = {(x.plan_id, x.label_id): x.group_no for x in taxonomy.fused_lines(lines, ruled).collect()}
    assert got[1, "a"] == got[1, "c"] != got[1, "b"] and got[1, "b"] != got[1, "d"]


def test_counted_tokens(spark):
    prompts = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(100)], "position long, text string")
    count = lambda t: len(t.split())
    assert tuple(estimate.counted_tokens(prompts.where("position < 5"), count).first()) == (15, "exact", 5)
    assert tuple(estimate.counted_tokens(prompts, count).first()) == (5050, "sampled", 8)
    assert estimate.counted_tokens(prompts, None).first().basis == "heuristic"
    assert tuple(estimate.counted_tokens(prompts.limit(0), count).first()) == (0, "exact", 0)


def test_budgets_of_sub_coded_categories(spark):
    rows = spark.createDataFrame([("a", 500, 10), ("b", 400, 0), ("c", 3, 2)], "label_id string, n long, n_subs int")
    assert {x.label_id: x.budget for x in sampling.budgets(rows, 10, 120).collect()} == {"a": 34, "b": 10, "c": 3}
    assert {x.label_id: x.budget for x in sampling.budgets(rows, 10, 30).collect()} == {"a": 18, "b": 5, "c": 3}


def test_proper_nouns_like_python(spark):
    import re
    from collections import Counter

    texts = ["Trash at Main Park and VTA. The park; Main St. is O'Hara's place!", "in Main Park? VTA vta Park", "no names here", None, "Nobody sees MAINTENANCE", "at Park-Hill, Main"]
    stop = ["the", "and"]
    want = Counter()
    for t in filter(None, texts):
        for s in re.split(r"(?<=[.!?/;])\s+", t):
            for w in re.findall(r"(?<!\w)[A-Za-z][A-Za-z'&.-]*(?!\w)", s)[1:]:
                if w.lower() not in stop and ((w[0].isupper() and not w.isupper() and len(w) > 1) or (w.isupper() and 2 <= len(w) <= 6)):
                    want[w] += 1
    got = {x.term: x.n for x in tallies.proper_nouns(spark.createDataFrame([(t,) for t in texts], "t string"), "t", stop, least=1).collect()}
    assert got == dict(want)


def unsteady(once, always):
    """A client that fails on the first call of every prompt that holds a word, and for good on another; local, so that it reaches the workers by value."""

    class Client:
        def __init__(self):
            self.seen = set()

        def complete(self, system, user):
            import json

            if always in user or (once in user and user not in self.seen):
                self.seen.add(user)
                raise RuntimeError("busy")
            rows = [{"n": int(line.split("\t")[0]), "label_ids": ["1"], "fit": 3} for line in user.splitlines()]
            return json.dumps({"results": rows, "candidates": [{"name": "One", "evidence": [1, 99]}]})

    return Client()


def test_label_run_sweeps_failed_batches(spark):
    rows = spark.createDataFrame([(1, f"1:1:{i:02d}", t) for i, t in enumerate(["good"] * 3 + ["once a", "once b", "never", "fine"])] + [(1, "1:1:99", None)], "question_id long, response_key string, text string")
    labels = spark.createDataFrame([(1, "1_001")], "question_id long, label_id string")
    got = {x.response_key: x for x in induction.label_run(rows, labels, unsteady("once", "never"), size=1).collect()}
    assert len(got) == 7 and all(x.label_ids == ["1_001"] and not x.batch_failed for k, x in got.items() if k != "1:1:05")
    assert got["1:1:05"].batch_failed and got["1:1:05"].label_ids == []


def test_induction_discloses_failed_chunks(spark):
    rows = spark.createDataFrame([(1, f"1:1:{i:02d}", "never" if i == 3 else f"text {i}") for i in range(12)], "question_id long, response_key string, text string")
    got = induction.map_candidates(rows, ["question_id"], unsteady("once", "never"), size=4)
    assert sorted((x.n_responses, x.n_candidates, x.n_invalid, x.batch_failed) for x in got.report.collect()) == [(4, 0, 0, True), (4, 1, 1, False), (4, 1, 1, False)]
    assert all(len(x.evidence) == 1 for x in got.candidates.collect())
    taxonomy_, _ = induction.induce(rows, unsteady("once", "never"), size=4)
    assert [(x.label_id, x.name, x.chunk_support) for x in taxonomy_.collect()] == [("1_001", "One", 2)]
    with pytest.raises(induction.NothingInduced):
        induction.map_candidates(rows, ["question_id"], unsteady("once", "te"), size=4)


def test_incremental_run_outcomes(spark):
    rows = spark.createDataFrame([(1, f"1:1:{i:02d}", f"text {i}") for i in range(30)], "question_id long, response_key string, text string")
    tax = spark.createDataFrame([(1, "1_001", None, "Known")], "question_id long, label_id string, parent_id string, name string")
    prior = spark.createDataFrame([(1, "1:1:00", ["1_001"], False, 3)], "question_id long, response_key string, label_ids array<string>, uncategorized boolean, fit int")
    nothing = labeling.EchoClient(lambda s, u: __import__("json").dumps({"results": [{"n": int(x.split("\t")[0]), "uncategorized": True} for x in u.splitlines()]}))
    propose = lambda name: labeling.EchoClient(lambda s, u: __import__("json").dumps({"candidates": [{"name": name, "evidence": [1]}]}))
    small = induction.run_incremental(rows, tax, prior, nothing, propose("New"), least_pool=40)
    assert small.outcome.startswith("skipped") and (small.n_new, small.n_pool) == (29, 29) and small.records.count() == 30
    known = induction.run_incremental(rows, tax, prior, nothing, propose("KNOWN!"))
    assert known.outcome.startswith("no new category") and known.taxonomy.count() == 1
    wide = induction.run_incremental(rows, tax, prior, nothing, propose("New"))
    assert wide.outcome == "extended" and {x.label_id for x in wide.taxonomy.collect()} == {"1_001", "1_i001"}
    assert sorted((x.how, x["count"]) for x in wide.records.groupBy("how").count().collect()) == [("kept", 1), ("relabelled", 29)]
    broken = induction.run_incremental(rows, tax, prior, nothing, labeling.EchoClient(lambda s, u: "no json"))
    assert broken.outcome.startswith("failed") and broken.records.count() == 30
    with pytest.raises(ValueError):
        induction.run_incremental(rows.where("response_key = '1:1:00'"), tax, prior, nothing)


def test_clustering():
    alike = lambda a, b: abs(a - b) <= 1
    assert taxonomy.complete_linkage([1, 2, 3], alike) == [[1, 2], [3]]
    assert taxonomy.anchored_groups([2, 1, 3, 5], alike) == [[2, 1, 3], [5]]


def test_label_parse(spark):
    batch = spark.createDataFrame([(2, 0, p, f"k{p}", "Cars on Main Street") for p in (1, 2, 3)], "question_id long, batch int, position int, response_key string, text string")
    reply = 'ok {"results": [{"n": 1, "labels": ["2", "2_001", "9_9"], "fit": 5, "locations": ["main street", "Moon"], "event_occurred": "Yes"}, {"number": 2, "label_ids": [], "uncategorized": true, "fit": 1}]} bye'
    replies = spark.createDataFrame([(2, 0, reply)], "question_id long, batch int, reply string")
    labels = spark.createDataFrame([(2, "2_001"), (2, "2_002")], "question_id long, label_id string")
    got = {r.position: r for r in labeling.parse_labels(batch, replies, labels).collect()}
    assert got[1].label_ids == ["2_002", "2_001"] and got[1].n_invalid == 1 and got[1].fit is None and got[1].event_occurred and got[1].locations == ["main street"]
    assert got[2].uncategorized and got[2].fit == 1 and not got[2].not_returned
    assert got[3].not_returned and got[3].label_ids == []


class Flaky:
    """Fails on the first batch, answers the others."""

    def complete(self, system, user):
        if "b0" in user:
            raise RuntimeError("no reply")
        return user


def test_failed_batches_are_contained(spark):
    rows = spark.createDataFrame([("q", i // 2, i) for i in range(6)], "scope string, batch int, position int")
    got = {r.batch: r for r in labeling.run_batches(rows, ["scope"], lambda pdf: ("", f"b{pdf['batch'].iloc[0]}"), labeling.EchoClient(lambda s, u: u)).collect()}
    assert [got[b].reply for b in range(3)] == ["b0", "b1", "b2"]

    def fail_first(system, user):
        if user == "b0":
            raise RuntimeError("no reply")
        return user

    got = {r.batch: r for r in labeling.run_batches(rows, ["scope"], lambda pdf: ("", f"b{pdf['batch'].iloc[0]}"), labeling.EchoClient(fail_first)).collect()}
    assert got[0].batch_failed and got[0].failure.startswith("RuntimeError") and not got[1].batch_failed


def test_composite_sample_like_the_literal_one(spark):
    import random

    r = random.Random(2)
    data = [("L", f"k{i:03d}", sorted(r.sample("abcdefghijklmnop", r.randint(1, 4)))) for i in range(200)]
    got = sampling.composite_sample(spark.createDataFrame(data, "label_id string, response_key string, tags array<string>"), 10, 7).collect()
    assert len(got) == len({x.response_key for x in got}) == 10
    tags = {k: set(t) for _, k, t in data}
    covered, chosen = set(), []
    while len(chosen) < 5 and covered != set("abcdefghijklmnop"):
        best = max(sorted(set(tags) - set(chosen)), key=lambda k: len(tags[k] - covered))
        chosen.append(best)
        covered |= tags[best]
    assert sorted(x.response_key for x in got if x.reason == "cover") == sorted(chosen)
    again = sampling.composite_sample(spark.createDataFrame(data[::-1], "label_id string, response_key string, tags array<string>"), 10, 7).collect()
    assert sorted(got) == sorted(again)


def test_samples(spark):
    rows = spark.createDataFrame([("L", f"k{i}", "s1" if i < 20 else "s2") for i in range(24)], "label_id string, response_key string, sub_id string")
    got = sampling.stratified_sample(rows, 8, 3, 1).collect()
    assert len(got) == 8 and sum(x.sub_id == "s2" and x.reason == "stratum" for x in got) == 3
    assert sampling.spread_indices(3, 10) == [0, 3, 6] and sampling.spread_indices(5, 2) == [0, 1]
    assert sampling.sampling_note(5, 5) == "" and sampling.sampling_note(5, 30).startswith("showing 5 of 30")
    assert sampling.quote_once([("a", ["x", "y"]), ("b", ["y", "z"])], 2) == {"a": ["x", "y"], "b": ["z"]}
    counts = spark.createDataFrame([("a", 30), ("b", 2)], "label_id string, n long")
    assert {r.label_id: r.budget for r in sampling.budgets(counts, 5, 120).collect()} == {"a": 5, "b": 2}
    assert {r.label_id: r.budget for r in sampling.budgets(counts, 5, 1).collect()} == {"a": 1, "b": 0}


def test_estimates(spark):
    runs = spark.createDataFrame([(1, "a", 10, 400), (1, "b", 20, 400), (2, "a", 90, 100)], "q int, run_id string, amount long, base long")
    newest = estimate.newest_runs(runs, ["q"])
    assert estimate.pooled_rates(newest.withColumn("all", F.lit(1)), "amount", "base", ["all"]).first() == (1, 20, 400, 1)
    sizes = spark.createDataFrame([(10, 1.0), (10, 3.0), (1000, 6.0)], "size long, usd double")
    wanted = spark.createDataFrame([(1,), (10,), (100,), (5000,)], "size long")
    assert {r["at"]: round(r.estimate, 6) for r in estimate.interpolated(sizes, wanted, "size", "usd").collect()} == {1: 2.0, 10: 2.0, 100: 4.0, 5000: 6.0}


def test_corpus_helpers(spark):
    df = spark.createDataFrame([("1:2:3",), ("1:2",), (None,)], "k string")
    assert [r[0] for r in df.select(corpus.respondent_key(F.col("k"))).collect()] == ["1:3", None, None]
    with pytest.raises(ValueError):
        corpus.resolve(df, {"text": ["response_text", "text"]})
    with pytest.raises(ValueError):
        reshape.check_selection(["a"], ["a", "b"], [], {"a": 1})
    with pytest.raises(ValueError):
        reshape.check_selection(["a"], ["a"], ["a"], {"a": 1})


def test_concept_sweep_misses_nothing_the_patterns_find(spark):
    from voxframe.functions.text import concept_pattern

    texts = ["Bus lanes", "BUSES", "light   rail", "Light\nRails", "busy", "Biſcuits", "bİke", "Kiosk", "", None, "CAFÉS", "straße"]
    concepts = {"bus": ["bus"], "rail": ["light rail"], "biscuit": ["biscuit"], "bike": ["bike"], "kiosk": ["kiosk"], "café": ["café"], "street": ["straße", "road"]}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response_text string")
    got = {(r.i, r.concept) for r in tallies.concept_matches(df, concepts).collect()}
    plain = {(r.i, n) for n, t in concepts.items() for r in df.where(F.col("response_text").rlike(concept_pattern(t))).collect()}
    assert got == plain and (3, "rail") in got
