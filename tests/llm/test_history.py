import json
import random
import shutil

import numpy as np
from pyspark.sql import functions as F

from voxframe.llm import history


def test_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [r.sample(words, r.randint(8, 40)) for _ in range(60)]
    for upload in (1, 2, 3):
        for i in range(120):
            text = list(r.choice(base))
            for _ in range(r.randint(0, 6)):
                text[r.randrange(len(text))] = r.choice([*words, *text])
            half = len(text) // 2
            rows.append((1, upload, (upload - 1) * 120 + i, " ".join(text[:half]), " ".join(text[half:])))
    raw = spark.createDataFrame([(d, u, i, json.dumps({"answer_b": b, "answer_a": a})) for d, u, i, a, b in rows], "dataset_id long, upload_id long, row_index long, cells string")
    hashes = spark.createDataFrame([(d, i, f"{hash((a, b)) & 0xFFFFFFFFFFFF:012x}".upper() if i % 2 else f"{hash((a, b)) & 0xFFFFFFFFFFFF:012x}") for d, u, i, a, b in rows], "dataset_id long, row_index long, row_hash string")
    uploads = spark.createDataFrame([(1, u, (u - 1) * 120) for u in (1, 2, 3)], "dataset_id long, upload_id long, row_offset long")
    expected = set()
    for d, u, i, a, b in rows:
        x, n = set(f"{a} {b}".split()), len(f"{a} {b}".split())
        earlier = [(c, e) for _, v, _, c, e in rows if v < u]
        if (a, b) in earlier:
            expected.add((d, i, "exact"))
        elif n >= 12 and any(len(f"{c} {e}".split()) >= 12 and 4 * len(x & (y := set(f"{c} {e}".split()))) >= 3 * len(x | y) for c, e in earlier):
            expected.add((d, i, "near"))
    assert {k for *_, k in expected} == {"exact", "near"}
    assert {tuple(g) for g in history.matched_rows(raw, hashes, uploads).collect()} == expected
    keys = ("dataset_id", "row_index", "o")
    made = history.points(raw.withColumnRenamed("upload_id", "o"), list(keys))
    for order in (np.zeros(history.CLASSES, np.int64), np.arange(history.CLASSES)[::-1].copy()):  # the order of the pivots decides nothing
        table = history.with_distances(made, order, history.THRESHOLD)
        small_blocks = {tuple(g) for g in history.near_rows(table, table, *keys, block_rows=7).collect()}
        assert small_blocks == {tuple(g) for g in history.near_rows(table, table, *keys).collect()}
        assert {(d, i) for d, i, kind in expected if kind == "near"} <= {(d, i) for d, i, _ in small_blocks}
    report = {g.upload_id: g for g in history.file_report(raw, hashes, uploads).collect()}
    assert report[1].exact_rows == report[1].near_rows == 0
    assert sum(g.exact_rows + g.near_rows for g in report.values()) == len(expected)


def test_appending_in_steps_equals_one_run(spark, tmp_path):
    r = random.Random(9)
    base = [r.sample([f"w{i}" for i in range(300)], r.randint(12, 40)) for _ in range(30)]
    rows = []
    for i in range(240):
        text = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            text[r.randrange(len(text))] = f"w{r.randrange(300)}"
        rows.append((i % 2, i, i // 80, json.dumps({"answer_a": " ".join(text)})))
    schema = "dataset_id long, row_index long, o long, cells string"
    keys = ("dataset_id", "row_index", "o")
    hashed = lambda df: df.select(*keys, F.unhex(F.sha2("cells", 256)).alias("h"))
    frame = lambda part: spark.createDataFrame(part, schema)
    whole = {tuple(g) for g in history.History(spark, f"{tmp_path}/whole", *keys).append(frame(rows), hashed(frame(rows))).collect()}
    stored, steps = history.History(spark, f"{tmp_path}/steps", *keys), set()
    for upload in (0, 1, 2, 2):  # the last one comes twice
        new = frame([x for x in rows if x[2] == upload])
        found = stored.append(new, hashed(new)).collect()
        steps |= {tuple(g) for g in found}
        assert {i for _, i, _ in found} <= {x[1] for x in rows if x[2] == upload}
    assert {k for *_, k in whole} == {"exact", "near"} and steps == whole
    assert spark.read.parquet(f"{tmp_path}/steps/near").count() == spark.read.parquet(f"{tmp_path}/steps/exact").count() == 240


def test_history_is_read_as_distances_only(spark, tmp_path):
    """What is stored has no text, and a new file reads the parts of its own datasets alone."""
    keys = ("dataset_id", "row_index", "o")
    schema = "dataset_id long, row_index long, o long, cells string"
    words = [f"w{i}" for i in range(20)]
    first = spark.createDataFrame([(d, 0, 0, json.dumps({"answer_a": " ".join(words)})) for d in range(40)], schema)
    stored = history.History(spark, str(tmp_path), *keys)
    stored.near(first)
    assert "cells" not in spark.read.parquet(f"{tmp_path}/near").columns
    for part in tmp_path.glob("near/part=*"):
        if part.name != f"part={stored._parts_of(first.where('dataset_id = 3'))[0]}":
            shutil.rmtree(part)  # nothing of the other datasets is needed
    new = spark.createDataFrame([(3, 1, 1, json.dumps({"answer_a": " ".join(words[1:])})), (3, 2, 1, json.dumps({"answer_a": " ".join(words[9:])}))], schema)
    assert [tuple(g) for g in stored.near(new).collect()] == [(3, 1, 1)]
