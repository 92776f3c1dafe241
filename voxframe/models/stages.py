"""Checked stages over what a model replies: vocabulary, dedup, merges, sub-themes, lexicon, places, ratification, synthesis, rulings.

Everything here works on lists as long as a taxonomy (tens to hundreds), after Spark has counted; a reply can only choose among what it was
shown, and whatever it invents is dropped and counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..plans.route import Route, from_selection
from ..plans.route import parse as parse_route
from ..plans.rulings import VERDICTS
from .client import ModelClient


class BadReply(ValueError):
    """A reply without the JSON asked for."""


def parse_json(reply: str) -> dict:
    """PR-17 on the driver: the outermost object, whatever is around it."""
    at, end = reply.find("{"), reply.rfind("}")
    if at < 0 or end <= at:
        raise BadReply("no JSON object in the reply")
    try:
        got = json.loads(reply[at : end + 1])
    except json.JSONDecodeError as e:
        raise BadReply(str(e)) from e
    return got


def ask_json(client: ModelClient, system: str, user: str) -> dict:
    """One call, and one more that shows the model its error."""
    reply = client.complete(system, user)
    try:
        return parse_json(reply)
    except BadReply as e:
        return parse_json(client.complete(system, f"{user}\n\nYour last reply could not be read ({e}). Reply with the JSON only."))


@dataclass(frozen=True)
class Label:
    name: str
    description: str = ""
    members: tuple[str, ...] = ()
    merged_from: tuple[str, ...] = ()


def unite(labels: list[Label], name: str | None = None) -> Label:
    """One label of several: the given or first name, the longest description, members once each in order."""
    return Label(
        name or labels[0].name, max((x.description for x in labels), key=len), tuple(dict.fromkeys(m for x in labels for m in x.members)),
        tuple(dict.fromkeys(n for x in labels for n in (x.merged_from or (x.name,)))),
    )


def vocabulary(document: dict, cap: int = 12) -> list[str]:
    """TX-02: theme names, each once, at most ``cap``; none at all is an error."""
    names = [str(t.get("name", "") if isinstance(t, dict) else t).strip() for t in document.get("themes") or []]
    first: dict[str, str] = {}
    for n in filter(None, names):
        first.setdefault(n.lower(), n)
    if not first:
        raise BadReply("no themes")
    return list(first.values())[:cap]


def _groups(document: dict, n: int) -> list[tuple[str | None, list[int]]]:
    """Groups of 1-based numbers, each number in the first group that names it."""
    seen: set[int] = set()
    out = []
    for g in document.get("groups") or []:
        ids = [i for i in dict.fromkeys(g.get("members") or []) if isinstance(i, int) and 1 <= i <= n and i not in seen]
        seen.update(ids)
        if ids:
            out.append((str(g.get("name") or "").strip() or None, ids))
    return out


def dedup(document: dict, labels: list[Label]) -> list[Label]:
    """TX-04: labels grouped within a theme; a label the reply forgets survives as it is."""
    groups = _groups(document, len(labels))
    used = {i for _, ids in groups for i in ids}
    merged = [unite([labels[i - 1] for i in ids], name) for name, ids in groups]
    return merged + [x for i, x in enumerate(labels, 1) if i not in used]


def dedup_theme(client: ModelClient, theme: str, labels: list[Label], batch: int = 60) -> list[Label]:
    """TX-04, ML-02: one call, or with more than ``batch`` labels one per batch and always a second round over all that is left, so that labels of
    different batches meet whatever their number."""
    if len(labels) < 2:
        return labels
    if len(labels) > batch:
        labels = [x for i in range(0, len(labels), batch) for x in dedup_theme(client, theme, labels[i : i + batch], batch)]
    return dedup(ask_json(client, f"Group labels of one meaning. Theme: {theme}", numbered(labels)), labels)


def cross_merge(document: dict, labels: list[Label], theme_of: dict[str, str]) -> list[Label]:
    """TX-05: merges across themes; a group inside one theme is refused, dedup had its say."""
    groups = [(n, ids) for n, ids in _groups(document, len(labels)) if len({theme_of.get(labels[i - 1].name) for i in ids}) > 1]
    used = {i for _, ids in groups for i in ids}
    return [unite([labels[i - 1] for i in ids], name) for name, ids in groups] + [x for i, x in enumerate(labels, 1) if i not in used]


def consolidate(client: ModelClient, labels: list[Label], batch: int = 120) -> dict[str, list[Label]]:
    """ML-02: vocabulary, assignment in batches (unknown themes are unsorted), dedup per theme, merges across themes."""
    themes = vocabulary(ask_json(client, "Name the themes.", numbered(labels)))
    by_lower = {t.lower(): t for t in themes}
    theme_of: dict[str, str] = {}
    for i in range(0, len(labels), batch):
        part = labels[i : i + batch]
        got = ask_json(client, "Assign a theme to each label: " + ", ".join(themes), numbered(part))
        for row in got.get("assignments") or []:
            n = row.get("n")
            if isinstance(n, int) and 1 <= n <= len(part):
                theme_of.setdefault(part[n - 1].name, by_lower.get(str(row.get("theme", "")).strip().lower(), "(unsorted)"))
    out: dict[str, list[Label]] = {}
    for x in labels:
        out.setdefault(theme_of.get(x.name, "(unsorted)"), []).append(x)
    flat = [y for t, xs in out.items() for y in dedup_theme(client, t, xs)]
    back = {n: t for t, xs in out.items() for x in xs for n in (x.name,)}
    home = {y.name: back.get(y.merged_from[0] if y.merged_from else y.name, back.get(y.name, "(unsorted)")) for y in flat}
    final = cross_merge(ask_json(client, "Merge labels that are the same across themes.", numbered(flat)), flat, home)
    grouped: dict[str, list[Label]] = {}
    for y in final:
        grouped.setdefault(home.get(y.name, home.get(y.merged_from[0], "(unsorted)") if y.merged_from else "(unsorted)"), []).append(y)
    return grouped


def numbered(labels: list[Label]) -> str:
    return "\n".join(f"{i}. {x.name}: {x.description[:200]} ({len(x.members)})" for i, x in enumerate(labels, 1))


@dataclass(frozen=True)
class SubThemes:
    outcome: str
    labels: tuple[Label, ...] = ()


def induce_sub_themes(client: ModelClient, category: str, chunks: list[list[tuple[str, str]]], least: int = 2) -> SubThemes:
    """TX-11, ML-01: sub-themes of a category from its chunks of (key, text); fewer than ``least`` that survive: it does not decompose."""
    found: dict[str, list[Label]] = {}
    for chunk in chunks:
        got = ask_json(client, f"Find sub-themes of {category}.", "\n".join(f"{i}. {t[:500]}" for i, (_, t) in enumerate(chunk, 1)))
        for s in got.get("sub_themes") or []:
            name = str(s.get("name", "")).strip()
            keys = tuple(chunk[n - 1][0] for n in s.get("responses") or [] if isinstance(n, int) and 1 <= n <= len(chunk))
            if name and keys:
                found.setdefault(re.sub(r"[^a-z0-9 ]", "", name.lower()), []).append(Label(name, str(s.get("description", "")), keys))
    labels = dedup_theme(client, category, [unite(v) for v in found.values()])
    return SubThemes("ok", tuple(sorted(labels, key=lambda x: (-len(x.members), x.name)))) if len(labels) >= least else SubThemes("does_not_decompose")


def review_sub_themes(document: dict, ids: list[str], counts: dict[str, int]) -> dict[str, str | None]:
    """TX-12, ML-05: id map of a review: in a group of duplicates the largest survives, a restated category becomes null."""
    out: dict[str, str | None] = {i: None for i in document.get("restatements") or [] if i in ids}
    for g in document.get("duplicates") or []:
        group = [i for i in dict.fromkeys(g) if i in ids and i not in out]
        if len(group) > 1:
            keep = max(group, key=lambda i: (counts.get(i, 0), -ids.index(i)))
            out.update({i: keep for i in group if i != keep})
    return out


def review_call(client: ModelClient, category: str, subs: list[tuple[str, str, int]], doubtful: list[tuple[str, str]] = ()) -> dict[str, str | None]:
    """ML-05: one call over the sub-themes of a category (id, name, count), with the pairs that code finds doubtful (JN-11) named one by one."""
    if len(subs) < 2:
        return {}
    shown = "\n".join(f"{i}. {name} ({n})" for i, name, n in subs) + "".join(f"\nSame or not: {a} and {b}?" for a, b in doubtful)
    return review_sub_themes(ask_json(client, f"Which sub-themes of {category} are duplicates, which only restate it?", shown), [i for i, *_ in subs], {i: n for i, _, n in subs})


def apply_review(records: dict[str, list[str]], id_map: dict[str, str | None], least: int = 2) -> tuple[dict[str, list[str]], str]:
    """TX-20: records under a review's id map; a category left with fewer than ``least`` sub-themes no longer decomposes."""
    new = {k: list(dict.fromkeys(x for i in ids if (x := id_map.get(i, i)) is not None)) for k, ids in records.items()}
    kept = {x for ids in new.values() for x in ids}
    return ({k: v for k, v in new.items() if v}, "ok") if len(kept) >= least else ({}, "does_not_decompose")


def grouped_terms(document: dict, candidates: list[str], kinds: tuple[str, ...] = ()) -> tuple[list[dict], dict[str, int]]:
    """ML-06, ML-07: concepts of candidate terms; an invented term and one already used are dropped and counted."""
    known, used = {c.lower(): c for c in candidates}, set()
    dropped = {"invented": 0, "reused": 0}
    out = []
    for c in document.get("concepts") or []:
        terms = []
        for t in c.get("terms") or c.get("spans") or []:
            low = str(t).strip().lower()
            if low not in known:
                dropped["invented"] += 1
            elif low in used:
                dropped["reused"] += 1
            else:
                used.add(low)
                terms.append(known[low])
        name = str(c.get("name", "")).strip().lower()
        if name and terms:
            out.append({"name": name, "terms": terms} | ({"kind": c["kind"] if c.get("kind") in kinds else kinds[0]} if kinds else {}))
    return out, dropped


def build_lexicon(client: ModelClient, candidates: dict[str, list[tuple[str, int]]], most: int = 240) -> tuple[list[dict], dict[str, int]]:
    """ML-06: concepts out of candidate terms by kind (proper, words, pairs; AG-18), each kind with an equal share of what one call is shown."""
    share = most // max(1, len(candidates))
    shown = {kind: terms[:share] for kind, terms in candidates.items()}
    text = "\n".join(f"[{kind}] " + ", ".join(f"{t} ({n})" for t, n in terms) for kind, terms in shown.items())
    return grouped_terms(ask_json(client, "Group terms of one concept.", text), [t for terms in shown.values() for t, _ in terms])


#: What a place can be (ML-07).
PLACE_KINDS = ("place", "street", "area", "facility")


def build_places(client: ModelClient, spans: list[tuple[str, int]], most: int = 300) -> tuple[list[dict], dict[str, int]]:
    """ML-07: places out of the most frequent spans (AG-17), each with its kind; without any span there is nothing to ask."""
    if not spans:
        return [], {"invented": 0, "reused": 0}
    shown = spans[:most]
    return grouped_terms(ask_json(client, "Group spellings of one place.", "\n".join(f"{s} ({n})" for s, n in shown)), [s for s, _ in shown], PLACE_KINDS)


def route_call(client: ModelClient, question: str, summary: str, labels: set[str], missed: Callable[[list[str]], list[str]] | None = None, **known: object) -> Route:
    """ML-08: one call makes a route of a question, checked against what there is; categories that code thinks were missed (SF-10) are put to a second call,
    which can only add."""
    made = parse_route(ask_json(client, "Which categories answer the question?", f"{question}\n\n{summary}"), labels, **known)
    offered = missed(list(made.labels)) if missed and made.route not in ("aggregate_direct", "unanswerable") else []
    wider = ratify(client, question, offered, list(made.labels))
    return made if wider == list(made.labels) else from_selection(made, wider, labels)


def ratify(client: ModelClient, question: str, missed: list[str], selected: list[str]) -> list[str]:
    """ML-08: which of the missed categories to add; it can only add, and only what was offered."""
    if not missed:
        return selected
    got = ask_json(client, "Which of these belong to the question?", f"{question}\n" + "\n".join(missed))
    return selected + [i for i in dict.fromkeys(got.get("include") or []) if i in missed and i not in selected]


def synthesize(client: ModelClient, question: str, plan: str, quotes: str) -> str:
    """ML-09: the answer's text; it is checked afterwards (``plans.verify``)."""
    return client.complete("Write the answer. State only the numbers given.", f"{question}\n\n{plan}\n\n{quotes}").strip()


def rule_pairs(client: ModelClient, pairs: list[tuple[str, str]], batch: int = 12) -> dict[tuple[str, str], tuple[str, str]]:
    """ML-10, TX-19: verdicts in batches; the first per pair counts, an unknown verdict is none, a failing batch leaves its pairs unruled."""
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for i in range(0, len(pairs), batch):
        part = pairs[i : i + batch]
        try:
            got = ask_json(client, "Same, broader or distinct?", "\n".join(f"{n}. {a} | {b}" for n, (a, b) in enumerate(part, 1)))
        except Exception:
            continue
        for r in got.get("rulings") or []:
            n, verdict = r.get("pair"), str(r.get("verdict", "")).strip().lower()
            if isinstance(n, int) and 1 <= n <= len(part) and verdict in VERDICTS:
                out.setdefault(part[n - 1], (verdict, str(r.get("why", ""))[:160]))
    return out


@dataclass
class Stage:
    name: str
    run: Callable[[], float]
    status: str = "waiting"
    cost: float = 0.0


@dataclass
class Job:
    """API-03, API-09: stages one after the other; a failure or a cancellation skips the rest, a stage that runs is not torn off."""

    stages: list[Stage] = field(default_factory=list)
    cancelled: bool = False
    is_active: bool = False

    def start(self) -> Job:
        self.is_active, stop = True, False
        try:
            for s in self.stages:
                if stop or self.cancelled:
                    s.status = "skipped"
                    continue
                s.status = "running"
                try:
                    s.cost = float(s.run() or 0)
                    s.status = "done"
                except Exception as e:
                    s.status, stop = f"failed: {e}"[:160], True
        finally:
            self.is_active = False
        return self

    def cancel(self) -> None:
        self.cancelled = True

    @property
    def cost(self) -> float:
        return sum(s.cost for s in self.stages)

    def report(self) -> dict:
        return {"is_active": self.is_active, "cancelled": self.cancelled, "cost": self.cost, "stages": [{"name": s.name, "status": s.status, "cost": s.cost} for s in self.stages]}
