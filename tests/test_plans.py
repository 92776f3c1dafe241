import pytest

from voxframe.plans import route, rulings, verify


def test_route_validation():
    doc = {"candidates": [{"label_id": "2_001", "relevance": "HIGH"}, {"label_id": "2_001"}, {"label_id": "9_9"}, {"label_id": "2_002", "relevance": "odd"}], "concepts": ["Buses", "nope"], "time_filter": "night", "event_filter": "yes"}
    r = route.parse(doc, {"2_001", "2_002"}, {"buses"}, available={"event"})
    assert r.labels == ("2_001", "2_002") and [c.relevance for c in r.candidates] == ["high", "medium"]
    assert r.concepts == ("buses",) and r.dropped == {"labels": 1, "concepts": 1, "time_filter": 1}
    assert r.filters.event and r.filters.time == ""
    assert route.parse({"candidates": []}, set()).route == "unanswerable"
    assert route.parse({"route": "aggregate_direct", "aggregate_target": "event"}, set()).target == "event"
    assert route.parse({"route": "comparative", "candidates": ["a"], "groups": [{"label_ids": ["a"]}]}, {"a"}).route == "categories"


def test_approved_selection_keeps_groups():
    doc = {"route": "comparative", "candidates": ["a", "b", "c"], "groups": [{"name": "x", "label_ids": ["a", "b"]}, {"name": "y", "label_ids": ["c"]}]}
    made = route.parse(doc, set("abcd"))
    approved = route.from_selection(made, ["a", "c", "d"], set("abcd"))
    assert approved.groups == (("x", ("a",)), ("y", ("c",)))
    assert route.changes(made, approved) == (["b"], ["d"])
    with pytest.raises(ValueError):
        route.from_selection(made, ["zz"], set("abcd"))


def test_numbers():
    allowed = verify.legitimate([3708, 1048, 872, 160], [[1350, 275]], "Everything else — 5,844 responses")
    assert {1075, 5844} <= allowed
    assert verify.untraceable_numbers("In all **383 of 3,708** responses [18], 25% or 12; 1075 respondents; **rents [17]**; (5_043)", allowed) == [383]


def test_quotes():
    sources = {1: "The streets are dark … and nobody comes", 2: "Buses"}
    assert verify.untraceable_quotes("“the STREETS are dark...nobody comes” [1] and “never said this” [2]", sources) == ["never said this"]


def test_placement_and_sections():
    text = "## Broken lights\nSay [1] and [2]\n## Late buses\nSay [3]"
    assert verify.misplaced_quotes(text, {1: "Broken lights", 2: "Late buses", 3: "Late buses"}, ["Broken lights", "Late buses"]) == [2]
    assert verify.missing_sections("**40 responses** say so", "A — 40 responses\nB — 12 responses") == ["B — 12 responses"]
    assert verify.similarity("Bus stops and shelters", "The bus stop") == 2 / 3


def test_stale_rulings(spark):
    r = spark.createDataFrame([("a", "b", 10, 10), ("a", "c", 10, 10)], "label_a string, label_b string, n_a long, n_b long")
    now = spark.createDataFrame([("a", 12), ("b", 11), ("c", 20)], "label_id string, n long")
    assert [x.label_b for x in rulings.stale(r, now).collect()] == ["c"]
