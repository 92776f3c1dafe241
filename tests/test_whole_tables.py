"""Queries run over all of their tables."""

from collections import Counter

import pytest

from voxframe import registry
from voxframe.operators import taxonomy
from voxframe.suites.base import corpus

QUERIES = registry.queries()


@pytest.fixture(scope="session")
def small():
    """Tables large enough for the caps to bite."""
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,size", [("pr16_parse_records", 50), ("pr20_sub_records", 40)])
def test_every_event_is_parsed_in_small_batches(spark, small, name, size):
    """Each event once, and no batch over its size."""
    got = QUERIES[name](spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/events.parquet").count() > 1000
    assert len({(r.batch, r.position) for r in got}) == len(got) and max(r.position for r in got) <= size


def test_concepts_in_every_document(spark, tmp_path):
    """Texts beyond ASCII count, and a letter beyond ASCII is part of a word."""
    texts = {1: "the bus", 2: "Café beside the library", 3: "Größere BUSES, bitte", 4: "übus", 5: "busé", 6: None, 7: "—bike  lanes—", 8: "señal"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hit for r in QUERIES["sf06_concept_pattern"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 7: True, 8: False}


def test_member_texts_that_were_cut_short(spark, tmp_path):
    rows = [("1:4:1", 1, 4, ["4_001"], "x" * 700, None), ("1:4:2", 1, 4, ["4_001"], "short", None)]
    spark.createDataFrame(rows, "response_key string, dataset_id long, question_id long, label_ids array<string>, response_text string, loaded_at timestamp").write.parquet(f"{tmp_path}/responses.parquet")
    assert [tuple(r) for r in QUERIES["tx21_member_rows"](spark, str(tmp_path)).collect()] == [("4_001", 2, 601 + 5)]


def test_evidence_of_every_chunk(spark, small):
    """Against plain Python."""
    rows = corpus(spark, small, "question_id", "source_row_index", "label_ids").collect()
    keys, place, cited = {}, {}, {}
    for q in {r.question_id for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r.question_id == q), key=lambda r: (r.source_row_index, r.response_key))):
            keys[q, i // 50, i % 50] = r.response_key
            place[r.response_key] = q, i // 50
    for r in rows:
        q, chunk = place[r.response_key]
        for label in set(r.label_ids or ()):
            cited.setdefault((label, chunk), set()).add((q, chunk, int(r.response_key.split(":")[2]) % 60))
    want = {k: (",".join([keys[n] for n in sorted(v) if n in keys][:10]), sum(n not in keys for n in v)) for k, v in cited.items()}
    assert len({c for _, c in want}) > 1
    assert {(r.label_id, r.chunk): (r.evidence, r.n_invalid) for r in QUERIES["tx01_evidence"](spark, small).collect()} == want


def test_every_part_is_proposed(spark, small):
    got = {r.question_id: r for r in QUERIES["tx09_extend_taxonomy"](spark, small).collect()}
    names = {"".join(c for c in r[0].lower() if c.isalnum() or c == " ").strip() for r in spark.read.parquet(f"{small}/part.parquet").select("p_name").collect()}
    assert got and all(len(names) / 2 < r.n_new <= len(names) and r.n_new == r.n_ids for r in got.values())


def test_a_thousand_new_labels_have_ids_of_their_own(spark):
    known = spark.createDataFrame([(4, "4_001", "old")], "question_id long, label_id string, name string")
    names = [(4, f"name {i // 2}" if i % 2 else f"Name {i // 2}!", i) for i in range(2400)]
    got = {r.label_id: r.name for r in taxonomy.extend(known, spark.createDataFrame(names, "question_id long, name string, position long")).collect()}
    assert len(got) == 1200 and got["4_i001"] == "Name 0!" and got["4_i1200"] == "Name 1199!"


def test_every_dataset_is_appended(spark, small):
    got = Counter(r[0] for r in QUERIES["se06_append"](spark, small).collect())
    assert len(got) == corpus(spark, small).count() and set(got.values()) == {1}


def test_a_proposal_for_every_question_meets_them_once_a_name(spark):
    """A hundred copies of a name are one before they meet the questions; the ids are those of proposals made question by question."""
    known = spark.createDataFrame([(4, "4_001", "old"), (7, "7_i012", "name 3"), (9, "9_001", None)], "question_id long, label_id string, name string")
    names = spark.range(0, 40_000).selectExpr("concat('Name ', id % 20, repeat('!', cast(id % 3 as int))) AS name", "id AS position").unionByName(spark.sql("SELECT 'Old' AS name, -1L AS position"))
    each = names.crossJoin(known.select("question_id"))
    got, want = ({tuple(r) for r in taxonomy.extend(known, p).collect()} for p in (names, each))
    assert got == want and len(got) == 20 + 1 + 20 + 20 and (4, "4_i001", "Name 0") in got and (7, "7_i013", "Old") in got


def test_all_species_at_once_in_blocks(spark, monkeypatch):
    """Against plain Python, names in several blocks, one forced pair alike anyway and one not."""
    monkeypatch.setattr(taxonomy, "BLOCK_LABELS", 3)
    names = ["bus lane", "lane bus", "bus lanes", "red bus lane", "park", "the", None]
    items = [(f"L{i:02d}", i % 4, f"c{i % 3}", names[i % 7]) for i in range(40)]
    words = {i: {w.removesuffix("s") if len(w) > 3 else w for w in (n or "").split() if w != "the"} for i, _, _, n in items}
    forced = {("L00", "L01"), ("L00", "L04")}
    want = set()
    for a in items:
        for b in items:
            i, u = len(words[a[0]] & words[b[0]]), len(words[a[0]] | words[b[0]])
            if a[0] < b[0] and ((i and 100 * i >= 40 * u) or (a[0], b[0]) in forced):
                fits = ["category", "subtheme_xq"] if a[1] != b[1] else ["category_sameq", *["subtheme_xcat"] * (a[2] != b[2])]
                want |= {(a[0], b[0], s, i, u, (a[0], b[0]) in forced) for s in fits}
    rows = spark.createDataFrame(items, "label_id string, question_id long, category_id string, name string")
    asked = spark.createDataFrame([("L01", "L00"), ("L00", "L04")], "label_a string, label_b string")
    got = [tuple(r) for r in taxonomy.nominate(rows, taxonomy.SPECIES, 40, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
