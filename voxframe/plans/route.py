"""The route: an analyst's request as a checked plan (PR-18, PR-19, JN-18, API-02)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Filters

ROUTES = ("categories", "comparative", "aggregate_direct", "lexicon", "unanswerable")
TARGETS = ("locations", "time", "event")
RELEVANCE = ("high", "medium", "low")


@dataclass(frozen=True)
class Candidate:
    label_id: str
    relevance: str = "medium"
    why: str = ""


@dataclass(frozen=True)
class Route:
    route: str
    candidates: tuple[Candidate, ...] = ()
    groups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    concepts: tuple[str, ...] = ()
    filters: Filters = field(default_factory=Filters)
    target: str = ""
    group_by: str = "category"
    dropped: dict[str, int] = field(default_factory=dict)

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(c.label_id for c in self.candidates)


def _choice(raw: object, allowed: tuple[str, ...], otherwise: str = "") -> str:
    word = str(raw or "").strip().lower()
    return word if word in allowed else otherwise


def parse(document: dict, labels: set[str], concepts: set[str] = frozenset(), places: set[str] = frozenset(), available: set[str] = frozenset()) -> Route:
    """PR-18: a model's document as a route.  What is unknown is dropped and counted, never guessed.

    ``available`` names the filters the data can answer (actionability, event, time); a filter without data is dropped and counted.  A
    comparison of fewer than two groups is a plain selection, and an aggregate without a target is not answerable.
    """
    dropped: dict[str, int] = {}

    def drop(what: str) -> None:
        dropped[what] = dropped.get(what, 0) + 1

    seen: dict[str, Candidate] = {}
    for raw in document.get("candidates") or []:
        item = raw if isinstance(raw, dict) else {"label_id": raw}
        label = str(item.get("label_id", "")).strip()
        if label not in labels:
            drop("labels")
        elif label not in seen:
            seen[label] = Candidate(label, _choice(item.get("relevance"), RELEVANCE, "medium"), str(item.get("why", ""))[:200])
    groups = []
    for g in document.get("groups") or []:
        inside = tuple(dict.fromkeys(x for x in map(str, g.get("label_ids") or []) if x in seen))
        if inside:
            groups.append((str(g.get("name", "")).strip() or f"Group {len(groups) + 1}", inside))
    known = {c.lower(): c for c in concepts}
    found = [known.get(str(c).strip().lower()) for c in document.get("concepts") or []]
    there = {p.lower(): p for p in places}
    spots = [there.get(str(p).strip().lower()) for p in document.get("locations") or []]
    for what, got in (("concepts", found), ("places", spots)):
        for g in got:
            if g is None:
                drop(what)
    asked = {
        "actionability": _choice(document.get("actionability_filter"), ("specific", "general")),
        "event": "yes" if document.get("event_filter") in (True, "yes", "true", "event") else "",
        "time": _choice(document.get("time_filter"), ("day", "night")),
    }
    for name, value in asked.items():
        if value and name not in available:
            drop(f"{name}_filter")
            asked[name] = ""
    route = _choice(document.get("route"), ROUTES, "categories")
    target = _choice(document.get("aggregate_target"), TARGETS)
    if route == "comparative" and len(groups) < 2:
        route = "categories"
    if route == "aggregate_direct" and not target:
        route = "categories"
    if document.get("answerable") is False or (route != "aggregate_direct" and not seen and not any(found)):
        route = "unanswerable"
    filters = Filters(labels=tuple(seen), places=tuple(s for s in spots if s), actionability=asked["actionability"], event=bool(asked["event"]), time=asked["time"])
    return Route(
        route, tuple(seen.values()), tuple(groups) if route == "comparative" else (), tuple(dict.fromkeys(c for c in found if c)), filters, target,
        _choice(document.get("group_by"), ("category", "place"), "category"), dropped,
    )


def from_selection(proposed: Route, selected: list[str], labels: set[str], **filters: object) -> Route:
    """PR-19: the route an analyst approved.  Unknown labels raise; groups stay, without the labels that were taken out."""
    unknown = [s for s in selected if s not in labels]
    if unknown:
        raise ValueError(f"unknown labels: {', '.join(unknown)}")
    by_id = {c.label_id: c for c in proposed.candidates}
    chosen = tuple(by_id.get(s, Candidate(s)) for s in dict.fromkeys(selected))
    keep = {c.label_id for c in chosen}
    groups = tuple((n, inside) for n, ids in proposed.groups if (inside := tuple(i for i in ids if i in keep)))
    return replace(proposed, candidates=chosen, groups=groups, filters=replace(proposed.filters, labels=tuple(keep & set(selected)), **filters))


def changed_labels(proposed: DataFrame, approved: DataFrame, by: list[str]) -> DataFrame:
    """JN-18 for many routes at once: ``label_id`` of what was taken out and added per ``by``, as ``change``."""
    keys = [*by, "label_id"]
    gone = proposed.join(approved.select(*keys), keys, "left_anti").select(*keys, F.lit("deselected").alias("change"))
    return gone.unionByName(approved.join(proposed.select(*keys), keys, "left_anti").select(*keys, F.lit("added").alias("change")))


def changes(proposed: Route, approved: Route) -> tuple[list[str], list[str]]:
    """JN-18: labels taken out of and added to a proposal."""
    a, b = set(proposed.labels), set(approved.labels)
    return sorted(a - b), sorted(b - a)
