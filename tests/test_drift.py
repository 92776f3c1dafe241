import json
import random

import pytest

from pyspark.sql import functions as F

from voxframe.operators.drift import SKETCH, Drift, best_matching, name_similarity

CELLS = "dataset_id long, upload_id long, row_index long, cells string"
UPLOADS = "dataset_id long, upload_id long, row_offset long"


def changes(spark, files, extra=(), fingerprints=None):
    rows, uploads, at = [], [], 0
    for i, file in enumerate(files, 1):
        uploads.append((1, i, at))
        for r in file:
            rows.append((1, i, at, json.dumps(r)))
            at += 1
    drift = Drift(spark.createDataFrame(rows + rows[:2] + list(extra), CELLS), spark.createDataFrame(uploads, UPLOADS), fingerprints)
    return drift, sorted(tuple(r)[1:] for r in drift.changes().collect())


def people(**columns):
    return [{"respondent_id": f"P{i}"} | {k: f(i) for k, f in columns.items()} for i in range(30)]


def test_every_kind_of_change(spark):
    one = people(age=lambda i: str(20 + i), pet=lambda i: ["yes", "no"][i % 2], visit=lambda i: f"{i % 12 + 1}/{i % 28 + 1}/2022", old=lambda i: f"x{i}", miles=lambda i: f"{i}.5")
    two = people(**{"How old?": lambda i: str(20 + i), "pet": lambda i: ["1", "0"][i % 2], "visit": lambda i: f"2022-{i % 12 + 1:02d}-{i % 28 + 1:02d}", "new": lambda i: f"y{i}", "miles": lambda i: f"{i},5"})
    three = people(**{"How old?": lambda i: f"about {20 + i}", "Has a pet": lambda i: ["Y", "N"][i % 2], "visit": lambda i: "n/a" if i else "-", "new": lambda i: "", "miles": lambda i: f"{i}"})
    _, got = changes(spark, [one, two, three])
    assert got == sorted([
        (2, "renamed", "age", "How old?"), (2, "removed", "old", ""), (2, "added", "", "new"), (2, "retyped", "pet", "pet"),
        (3, "retyped", "How old?", "How old?"), (3, "renamed", "pet", "Has a pet"), (3, "retyped", "pet", "Has a pet"), (3, "retyped", "miles", "miles"),
    ])


def test_unified_table(spark):
    one = people(age=lambda i: str(i), day=lambda i: "1/2/2022")
    two = people(years=lambda i: str(i), day=lambda i: "44563")
    drift, got = changes(spark, [one, two])
    assert (2, "renamed", "age", "years") in got
    rows = drift.unified().collect()
    assert len(rows) == 60
    cells = [json.loads(r.cells) for r in rows]
    assert {c["day"] for c in cells} == {"2022-01-02"} and all("age" in c and "years" not in c for c in cells)


def test_awkward_files(spark):
    drift, got = changes(spark, [people(a=lambda i: "")], extra=[(1, 1, 900, None), (1, 1, 901, "no json"), (2, 7, 0, "{}"), (None, None, None, None)])
    assert got == [] and drift.unified().count() >= 30
    empty = Drift(spark.createDataFrame([], CELLS), spark.createDataFrame([], UPLOADS))
    assert empty.changes().count() == empty.unified().count() == 0


def test_a_blank_column_left_out_of_the_cells(spark):
    fp = spark.createDataFrame([(1, 2, "gone"), (1, 1, "gone"), (1, 1, "a"), (1, 2, "a")], "dataset_id long, upload_id long, column_name string")
    _, got = changes(spark, [people(a=lambda i: f"v{i}", gone=lambda i: "x"), people(a=lambda i: f"v{i}")], fingerprints=fp)
    assert got == []


@pytest.mark.parametrize("seed", range(20))
def test_matching_is_optimal(seed):
    from itertools import permutations

    r = random.Random(seed)
    left, right = "abcd"[: r.randint(1, 4)], "wxyz"[: r.randint(1, 4)]
    weights = {(a, b): r.random() + 0.01 for a in left for b in right if r.random() < 0.6}
    got = best_matching(weights)
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and got <= set(weights)
    short, long = sorted((left, right), key=len)
    total = lambda p: sum(weights.get((x, y) if short == left else (y, x), 0) for x, y in zip(short, p))
    assert abs(sum(weights[p] for p in got) - max(map(total, permutations(long, len(short))))) < 1e-9


def test_name_similarity():
    assert name_similarity("Years resident", "years_resident") == 1.0


@pytest.mark.parametrize("renamed", [True, False])
def test_a_rename_with_few_common_respondents_in_the_sketches(spark, renamed):
    """Two sketched respondents are common and one of them has a corrected value: only the exact check may decide."""
    ids = [f"P{i}" for i in range(600)]
    ranked = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "r string").orderBy(F.xxhash64("r")).collect()]
    after = ranked[:2] + ranked[SKETCH : SKETCH + 58]
    wrong = set(after[:1] if renamed else after[:30])
    one = [{"respondent_id": r, "age": r[1:]} for r in ids]
    two = [{"respondent_id": r, "years": "corrected" if r in wrong else r[1:]} for r in after]
    _, got = changes(spark, [one, two])
    names = {c[1:] for c in got}
    assert names == ({("renamed", "age", "years"), ("retyped", "age", "years")} if renamed else {("removed", "age", ""), ("added", "", "years")})


def test_what_a_sketch_rules_out():
    from voxframe.operators.drift import possible

    assert all(possible(same, common) for common in range(9) for same in range(common + 1))
    assert possible(SKETCH * 9 // 10, SKETCH) and not possible(SKETCH * 6 // 10, SKETCH) and not possible(0, 9)
