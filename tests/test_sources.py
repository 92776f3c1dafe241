import time

import pytest
from pyspark.sql import functions as F

from voxframe.sources.files import Files
from voxframe.sources import readers, sinks
from voxframe.streaming import append


def test_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_bytes(b'\xef\xbb\xbfrespondent_id,better_city,unsafe\r\n1,"More ""parks""\nand trees",007\r\n2,,\r\n')
    rows = readers.read_wide(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("1", 'More "parks"\nand trees', "007"), ("2", "", "")]


def test_upload_checks(tmp_path):
    (tmp_path / "empty.csv").touch()
    for bad in ("x.txt", "noext", str(tmp_path / "empty.csv")):
        with pytest.raises(ValueError):
            readers.check_upload(bad)
    assert readers.check_upload("a.XLSX") == ".xlsx"


def test_excel_says_what_is_missing(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    path.write_bytes(b"PK")
    with pytest.raises(Exception):
        readers.read_wide(spark, str(path)).collect()


def test_exports(tmp_path):
    a, b = tmp_path / "1" / "responses.parquet", tmp_path / "2" / "responses.parquet"
    for p in (a, b):
        p.parent.mkdir()
        p.touch()
        time.sleep(0.01)
    assert readers.newest_export([str(a), str(b)]) == str(b)
    assert readers.dataset_export(str(tmp_path), 1) == str(a)
    with pytest.raises(FileNotFoundError):
        readers.dataset_export(str(tmp_path), 3)


def test_fixed_schema_and_lists(spark, tmp_path):
    c = spark.createDataFrame([("1:1:1", ["a", "b"], None), ("1:1:2", None, "x")], "response_key string, label_ids array<string>, extra string")
    sinks.write_export(c, str(tmp_path / "e.parquet"))
    back = spark.read.parquet(str(tmp_path / "e.parquet"))
    assert back.columns == [f.name for f in readers.CORPUS]
    rows = {r.response_key: r.label_ids for r in sinks.csv_frame(c).collect()}
    assert rows == {"1:1:1": '["a","b"]', "1:1:2": ""}
    sinks.write_csv(c, str(tmp_path / "e.csv"))
    sinks.add_bom(str(tmp_path / "e.csv"))
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "e.csv").glob("part-*.csv"))


def test_json(spark, tmp_path):
    files, place = Files(spark), str(tmp_path / "x")
    files.write_json({"a": 1}, f"{place}/a.json")
    files.write_json({"a": "é"}, f"{place}/a.json")
    files.append_jsonl({"a": 1}, f"{place}/log.jsonl")
    files.append_jsonl({"a": 2}, f"file://{place}/log.jsonl")
    assert files.read_json(f"{place}/a.json") == {"a": "é"} and files.read_text(f"{place}/log.jsonl").count("\n") == 2
    assert [p.rsplit("/", 1)[1] for p, _ in files.walk(place)] == ["a.json", "log.jsonl"]
    sinks.answer_artifacts(files, place, "Dark [1]", {"route": "categories"})
    assert files.read_text(f"{place}/answer.md") == "Dark [1]" and files.folders(str(tmp_path)) == ["x"] and files.modified(place) > 0 == files.modified(f"{place}/none")
    assert files.delete(place) and not files.exists(place) and files.walk(place) == [] and files.folders(place) == []


def test_many_documents(spark, tmp_path):
    """Written and read in seconds, not a command of the system for each; what is replaced leaves no checksum and no half-written file."""
    files, place = Files(spark), f"file://{tmp_path}/x"
    spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(f"{place}/1")
    old = files.matching(f"{place}/1/part-*.txt")[0]
    files.write_text("new", old)
    assert files.read_text(old) == "new" and [r.value for r in spark.read.text(old).collect()] == ["new"]
    began = time.time()
    for name in ("old", "né"):
        files.each(files.write_json, [({"n": n, "name": name}, f"{place}/{n}/d.json") for n in range(2, 802)])
    files.each(files.append_jsonl, [({"n": n}, f"{place}/{n}/log.jsonl") for n in range(2, 802)])
    assert time.time() - began < 20
    found = files.matching(f"{place}/*/d.json")
    assert files.each(files.read_json, [(p,) for p in found]) == [{"n": int(p.split("/")[-2]), "name": "né"} for p in found] and len(found) == 800
    assert files.matching(f"{place}/*/*.part") == files.matching(f"{place}/none/*") == []
    with pytest.raises(ZeroDivisionError):
        files.each(lambda n: 1 // n, [(1,), (0,)])


def test_runs_are_appended(spark, tmp_path):
    r = spark.createDataFrame([("k", 1)], "response_key string, fit int")
    for run in ("r1", "r2"):
        sinks.append_run(r, str(tmp_path / "runs"), 1, 2, run)
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == 2 and readers.latest_run(runs, ["dataset_id", "question_id"]).first().run_id == "r2"


def test_cache_misses_when_anything_changes(spark, tmp_path):
    calls = []

    def build(c):
        calls.append(1)
        return c.withColumn("concept", F.lit("x"))

    c = spark.createDataFrame([("k1", "a"), ("k2", "b")], "k string, t string")
    x = {"x": ["one", "two"]}
    for frame, version, concepts, hit in (
        (c, "v1", x, False), (c.repartition(3), "v1", {"x": ["two", "one"]}, True), (c.limit(1), "v1", x, False), (c, "v2", x, False), (c, "v1", {"x": ["one"]}, False), (c, "v1", x | {"y": ["z"]}, False),
    ):
        assert readers.cached_matches(spark, str(tmp_path), frame, "k", "t", version, concepts, build)[1] is hit
    assert len(calls) == 5
    assert readers.cached_matches(spark, str(tmp_path), c, "k", "t", "v1", {"w": ["one"]}, build)[1] is False
    assert readers.cached_matches(spark, str(tmp_path), c, "k", "t", "v1", {"w": ["one"]}, build)[1] is False  # what is stored names a concept nobody has


def test_what_is_stored_is_not_taken_for_nothing(spark, tmp_path):
    (tmp_path / "held").mkdir()
    (tmp_path / "held" / "part.parquet").write_text("no parquet")
    rows = spark.createDataFrame([(1, 1, 0, "a")], append.ROW)
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET|FAILED_READ"):
        append.append_new(rows, 1, str(tmp_path / "held"))


def test_append_stream_is_a_multiset(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "held"
    first = [(1, 1, 0, "a"), (1, 1, 1, "a"), (1, 1, 2, "b")]
    second = [(1, 2, 0, "a"), (1, 2, 1, "a"), (1, 2, 2, "a"), (1, 2, 3, "c")]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, append.ROW).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(append.ROW).parquet(str(source))
        q = append.append_stream(stream, str(target), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    held = spark.read.parquet(str(target))
    assert sorted((r.upload_id, r.row_hash) for r in held.collect()) == [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "c")]
    assert held.select(F.count_distinct("source_row_index")).first()[0] == 5
    append.append_new(spark.createDataFrame(second, append.ROW), 1, str(target))  # a replay changes nothing
    assert spark.read.parquet(str(target)).count() == 5


def test_period_stream(spark, tmp_path):
    import datetime as dt

    rows = [("2023-09-19", dt.datetime(2023, 10, 1)), ("9/20/2023", dt.datetime(2023, 10, 1)), ("2024-01-02", dt.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "d string, loaded timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("d string, loaded timestamp").parquet(str(tmp_path / "in"))
    q = append.period_stream(stream, "d", "quarter").writeStream.outputMode("complete").format("memory").queryName("periods").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.period: r.n for r in spark.table("periods").collect()} == {"2023 Q3": 2, "2024 Q1": 1}
