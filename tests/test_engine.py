import json
import threading
import time

import pytest

from voxframe.__main__ import main
from voxframe.engine import Busy as Busy_
from voxframe.engine import Engine, Memo
from voxframe.models import stages
from voxframe.models.client import Busy, CannedClient, RetryingClient
from voxframe.plans import render, route


def write(path, rows):
    path.write_text("respondent_id,better_city,unsafe,district\n" + "\n".join(rows) + "\n")
    return str(path)


def test_upload_append_ask_delete(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    first = write(tmp_path / "one.csv", ["1,More parks,Dark streets,D1", "2,Lower rent,,D2", "3,,Speeding cars,", "3,,Speeding cars,"])
    meta = e.upload(first, "City", ["better_city", "unsafe"], ["district"], "respondent_id")
    assert meta["uploads"][0]["new_row_count"] == 4 and e.corpus(1).count() == 5
    second = write(tmp_path / "two.csv", ["3,,Speeding cars,", "3,,Speeding cars,", "3,,Speeding cars,", "9,mÃ¡s luces,n/a,D1"])
    meta = e.append(1, second)
    assert (meta["uploads"][1]["new_row_count"], meta["uploads"][1]["duplicate_row_count"], meta["uploads"][1]["row_offset"]) == (2, 2, 4)
    rows = {r.response_key: r for r in e.corpus(1).collect()}
    assert len(rows) == 8 and rows["1:1:7"].response_text == "más luces" and rows["1:1:7"].was_encoding_repaired and rows["1:2:7"].is_nonanswer
    assert [u["kind"] for u in e.history(1)] == ["created", "appended"]
    assert {(r.value, r.n) for r in e.attributes(1).collect()} == {("D1", 2), ("D2", 1)}
    e.label(1, spark.createDataFrame([("1:2:0", ["2_001"], False, "specific")], "response_key string, label_ids array<string>, uncategorized boolean, actionability string"), "r1")
    e.label(1, spark.createDataFrame([("1:2:0", ["2_002"], False, "specific")], "response_key string, label_ids array<string>, uncategorized boolean, actionability string"), "r2")
    r = e.route(1, {"candidates": ["2_002", "2_001"], "actionability_filter": "specific", "time_filter": "day"})
    assert r.labels == ("2_002",) and r.dropped == {"labels": 1, "time_filter": 1}
    blocks = e.answer(1, r)
    assert blocks["unique"].first().n_unique == 1 and blocks["denominators"].first().n == 1
    assert e.cache_key(1, "What's up?") == e.cache_key(1, "whats up") != e.cache_key(1, "other")
    assert [q["n_rows"] for q in e.questions(1)] == [3, 5]
    before = e.cache_key(1, "What's up?")
    assert e.cached_answer(1, before, lambda: {"text": "first"}) == ({"text": "first"}, False) and e.cached_answer(1, before, lambda: {"text": "second"}) == ({"text": "first"}, True)
    e.label(1, spark.createDataFrame([("1:2:2", ["2_001"], False, "specific")], "response_key string, label_ids array<string>, uncategorized boolean, actionability string"), "r3")
    assert e.cache_key(1, "What's up?") != before
    assert e.context(1)["labelled"] == 2
    preview = e.deletion_preview(1)[str(tmp_path / "root")]
    assert preview["files"] > 4 and preview["bytes"] > 100
    with pytest.raises(ValueError):
        e.delete(1, "wrong")
    e.delete(1, "City")
    with pytest.raises(KeyError):
        e.corpus(1)
    with pytest.raises(ValueError):
        e.upload(first, "City", ["no such"])


def test_any_file_system(spark, tmp_path):
    """A root with a scheme is the same place."""
    e = Engine(spark, f"file://{tmp_path}/root", roots=(f"file://{tmp_path}/other",))
    e.upload(write(tmp_path / "one.csv", ["1,More parks,Dark streets,D1"]), "City", ["better_city"], [], "respondent_id")
    e.files.write_json({"micro_usd": 7}, f"{tmp_path}/other/1/runs/r1/manifest.json")
    assert [d["name"] for d in Engine(spark, f"{tmp_path}/root").datasets()] == ["City"]
    assert e.deletion_preview(1)[f"file://{tmp_path}/other"] == {"files": 1, "bytes": e.files.walk(f"{tmp_path}/other")[0][1], "runs": 1, "micro_usd": 7}
    e.reset(1, "City")
    e.delete(1, "City")
    assert e.datasets() == [] and not e.files.exists(f"{tmp_path}/other/1")


def test_many_partitions_keep_file_order(spark, tmp_path):
    rows = [(f"r{i}",) for i in range(300)]
    e = Engine(spark, str(tmp_path))
    got = e.hashed(spark.createDataFrame(rows, "a string").repartition(1).repartitionByRange(7, "a")).collect()
    assert sorted(x.row_index for x in got) == list(range(300))


def test_config_is_checked(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.config() == {} and e.put_config({"batch": 40, "label_model": "m"}) == {"batch": 40, "label_model": "m"}
    assert e.put_config({"batch": None}) == {"label_model": "m"} == e.config()
    for bad in ({"no": 1}, {"batch": 0}, {"batch": "x"}, {"label_model": " "}, {"batch": True}):
        with pytest.raises(ValueError):
            e.put_config({"seed": 3} | bad)
    assert "seed" not in e.config()
    runs = spark.createDataFrame([(1, "r1", 900, 100), (1, "r2", 500, 250), (2, "r1", 10, 5)], "question_id long, run_id string, amount long, base long")
    assert e.recalibrate(runs) == {"amount": 500, "base": 250, "n_runs": 1}
    assert e.recalibrate(runs.limit(0)) == {"amount": 500, "base": 250, "n_runs": 1}


def test_one_job_at_a_time(spark, tmp_path):
    e, go = Engine(spark, str(tmp_path)), threading.Event()
    job = e.run_job(1, [stages.Stage("a", lambda: go.wait(20) and 1.0), stages.Stage("b", lambda: 2.0)], wait=False)
    with pytest.raises(Busy_):
        e.run_job(1, [])
    assert e.run_job(2, [stages.Stage("c", lambda: 0.5)]).cost == 0.5
    job.cancel()
    go.set()
    while job.is_active:
        time.sleep(0.01)
    assert [s["status"] for s in e.job(1).report()["stages"]] == ["done", "skipped"]
    assert not e.run_job(1, []).is_active


def test_a_memo_lasts_a_while():
    now, made = [0.0], []
    m = Memo(120, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert m.get("k", make) == m.get("k", make) == 1
    now[0] = 121
    assert m.get("k", make) == 2 and m.get("other", make) == 3
    m.forget()
    assert m.get("k", make) == 4


def test_second_round_of_deduplication():
    """Labels of different batches meet, whatever their number."""
    labels = [stages.Label(f"n{i}") for i in range(9)]
    seen = []

    class Client:
        def complete(self, system, user):
            seen.append(user.count("\n") + 1)
            return json.dumps({"groups": [{"name": "all", "members": list(range(1, seen[-1] + 1))}]} if len(seen) == 4 else {"groups": []})

    got = stages.dedup_theme(Client(), "t", labels, batch=3)
    assert seen == [3, 3, 3, 9] and [x.name for x in got] == ["all"]


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "root")
    path = write(tmp_path / "one.csv", ["1,More parks,Dark streets,D1", "2,Lower rent,,D2"])
    main(["--root", root, "upload", path, "--name", "City", "--question", "better_city", "--attribute", "district", "--respondent", "respondent_id"])
    main(["--root", root, "questions", "1"])
    main(["--root", root, "config", "batch=30"])
    main(["--root", root, "induce", "1", "--client", "voxframe.models.client:FirstWords"])
    main(["--root", root, "label", "1", "--client", "voxframe.models.client:FirstWords"])
    (tmp_path / "edits.json").write_text(json.dumps([{"op": "rename", "label_id": "1_001", "name": "Renamed"}]))
    main(["--root", root, "review", "1", "--edits", str(tmp_path / "edits.json")])
    (tmp_path / "route.json").write_text(json.dumps({"candidates": ["1_001"]}))
    main(["--root", root, "ask", "1", str(tmp_path / "route.json")])
    for command in ("review", "summarize", "build-lexicon", "build-locations", "history"):
        main(["--root", root, command, "1"])
    main(["--root", root, "reset", "1", "--name", "City"])
    main(["--root", root, "delete", "1", "--name", "City"])
    out = capsys.readouterr().out
    assert '"n_rows": 2' in out and '"batch": 30' in out and "Renamed" in out and "unique responses: 1" in out


def test_retries_and_usage():
    waits = []

    class Twice:
        n = 0

        def complete(self, system, user):
            self.n += 1
            if self.n < 3:
                raise Busy(after=5.0 if self.n == 1 else None)
            return "ok"

    c = RetryingClient(Twice(), spacing=0, sleep=waits.append)
    assert c.complete("a", "bc") == "ok" and waits[0] == 5.0 and 1 <= waits[1] <= 3 and c.usage.chars_in == 3
    with pytest.raises(Busy):
        RetryingClient(Twice(), attempts=2, spacing=0, sleep=waits.append).complete("", "")


def test_json_is_asked_for_once_more():
    assert stages.ask_json(CannedClient("no", 'well {"a": 1}'), "", "") == {"a": 1}
    with pytest.raises(stages.BadReply):
        stages.ask_json(CannedClient("no"), "", "")


def test_consolidation_keeps_forgotten_labels():
    labels = [stages.Label(n, "d" * i, (f"k{i}",)) for i, n in enumerate(["Lights", "Dark lamps", "Buses", "Rent"])]
    replies = [{"themes": ["A", "a", "B"]}, {"assignments": [{"n": 1, "theme": "A"}, {"n": 2, "theme": "a"}, {"n": 3, "theme": "B"}, {"n": 4, "theme": "zzz"}, {"n": 1, "theme": "B"}]}, {"groups": [{"name": "Lighting", "members": [1, 2, 9]}]}, {"groups": [{"members": [2, 3]}]}]
    got = stages.consolidate(CannedClient(*map(json.dumps, replies)), labels)
    names = sorted(x.name for v in got.values() for x in v)
    assert names == ["Buses", "Lighting"] and {m for v in got.values() for x in v for m in x.members} == {"k0", "k1", "k2", "k3"}


def test_sub_themes_and_reviews():
    chunk = [[("k1", "a"), ("k2", "b")]]
    one = json.dumps({"sub_themes": [{"name": "X", "responses": [1, 7]}]})
    assert stages.induce_sub_themes(CannedClient(one), "c", chunk).outcome == "does_not_decompose"
    two = json.dumps({"sub_themes": [{"name": "X", "responses": [1]}, {"name": "Y", "responses": [1, 2]}]})
    assert [x.name for x in stages.induce_sub_themes(CannedClient(two, "{}"), "c", chunk).labels] == ["Y", "X"]
    m = stages.review_sub_themes({"duplicates": [["s1", "s2", "zz"]], "restatements": ["s3"]}, ["s1", "s2", "s3", "s4"], {"s1": 1, "s2": 5})
    assert m == {"s3": None, "s1": "s2"}
    assert stages.apply_review({"k": ["s1", "s2"], "l": ["s3"], "m": ["s4"]}, m) == ({"k": ["s2"], "m": ["s4"]}, "ok")
    assert stages.apply_review({"k": ["s1"]}, m) == ({}, "does_not_decompose")


def test_guards():
    concepts, dropped = stages.grouped_terms({"concepts": [{"name": "Bus", "terms": ["bus", "tram"]}, {"name": "b2", "terms": ["BUS"]}]}, ["Bus", "rail"])
    assert concepts == [{"name": "bus", "terms": ["Bus"]}] and dropped == {"invented": 1, "reused": 1}
    assert stages.ratify(CannedClient('{"include": ["b", "zz"]}'), "q", ["b", "c"], ["a"]) == ["a", "b"]
    assert stages.rule_pairs(CannedClient('{"rulings": [{"pair": 1, "verdict": "Same"}, {"pair": 1, "verdict": "distinct"}, {"pair": 2, "verdict": "odd"}]}'), [("a", "b"), ("c", "d")]) == {("a", "b"): ("same", "")}
    with pytest.raises(stages.BadReply):
        stages.vocabulary({"themes": []})


def test_calls_around_the_guards():
    subs = [("s1", "Lamps", 3), ("s2", "Lights", 9), ("s3", "Dark", 1)]
    client = CannedClient('{"duplicates": [["s1", "s2"]], "restatements": ["s3"]}')
    assert stages.review_call(client, "Light", subs, [("s1", "s2")]) == {"s3": None, "s1": "s2"} and stages.review_call(client, "Light", subs[:1]) == {}
    got, dropped = stages.build_lexicon(CannedClient('{"concepts": [{"name": "bus", "terms": ["Bus", "Tram", "bus stop"]}]}'), {"words": [("bus", 5), ("tram", 2)], "pairs": [("bus stop", 3)]}, most=2)
    assert got == [{"name": "bus", "terms": ["bus", "bus stop"]}] and dropped == {"invented": 1, "reused": 0}  # a share of one term a kind
    places, _ = stages.build_places(CannedClient('{"concepts": [{"name": "Main", "spans": ["main st"], "kind": "street"}, {"name": "P", "spans": ["park"], "kind": "planet"}]}'), [("main st", 4), ("park", 2)])
    assert [(p["name"], p["kind"]) for p in places] == [("main", "street"), ("p", "place")] and stages.build_places(client, []) == ([], {"invented": 0, "reused": 0})
    asked = CannedClient('{"candidates": ["a", "zz"]}', '{"include": ["c", "a", "q"]}')
    r = stages.route_call(asked, "Why?", "summary", {"a", "b", "c"}, missed=lambda chosen: ["c"])
    assert r.labels == ("a", "c") and r.dropped == {"labels": 1}
    assert stages.route_call(CannedClient('{"answerable": false}'), "Why?", "", {"a"}, missed=lambda chosen: ["a"]).route == "unanswerable"


def test_jobs_stop_at_a_failure():
    def fail():
        raise RuntimeError("x")

    job = stages.Job([stages.Stage("a", lambda: 1.5), stages.Stage("b", fail), stages.Stage("c", lambda: 1)]).start()
    assert [s.status.split(":")[0] for s in job.stages] == ["done", "failed", "skipped"] and job.cost == 1.5


def test_rendering():
    text = render.counts_block([("a", "Lights", 3), ("b", "Buses", 5)], {"event_in_scope": 9, "event_coded": 8, "event_matching": 2, "n": 2}, 8)
    assert text.splitlines()[0].startswith("- Buses (b): 5 responses (62%)") and "event: 2 of 8 coded, 9 in scope" in text
    block, numbered = render.quotes_block([("Lights", "k1", "dark"), ("Lights", "k2", "x" * 5000)])
    assert numbered[1] == "dark" and block.count("## Lights") == 1 and "…" in block
    assert render.section_plan([("a", 3), ("b", 2)], 7, 1).endswith("Everything else — 7 responses")
    text = render.summary_text([(1, "Why?", [("a", "Lights", 1), ("b", "buses", 2)]), (2, "How?", [])], {"bus": 3}, {"park": 1, "hall": 4})
    assert text.splitlines() == ["Q1: Why?", "  b buses (2)", "  a Lights (1)", "Q2: How?", "  (no categories)", "Concepts: bus (3)", "Places: hall (4), park (1)"]
    text = render.review_report({"n_labels": 3, "coded": 8, "pool": 2}, [("a", "b", 1, 4), ("a", "c", 3, 4)], {"x": ["a", "b"]}, ["c"], ["a"], [(f"k{i}", "t" * 200) for i in range(12)])
    assert text.splitlines()[:4] == ["3 categories, 8 coded responses, 2 uncovered (25%)", "overlap: a and c share 3 of 4 (75%)", "overlap: a and b share 1 of 4 (25%)", "one name: x: a, b"] and text.endswith("and 2 more uncovered")
    r = route.parse({"candidates": ["a", "zz"], "time_filter": "day"}, {"a"}, available={"time"})
    assert render.process_note(r, 3, 1) == "Searched 1 categories; 3 responses matched; 1 quoted. Filters: day. Left out: 1 labels."
