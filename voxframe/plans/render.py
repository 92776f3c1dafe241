"""SF-23: small collected blocks as text: counts, quotes, denominators, what was done."""

from __future__ import annotations

from .route import Route


def share(part: int, whole: int) -> str:
    """SF-11: a percentage rounded half to even; nothing for an empty whole."""
    return f" ({round(100 * part / whole)}%)" if whole else ""


def counts_block(selection: list[tuple[str, str, int]], denominators: dict[str, int], unique: int) -> str:
    lines = [f"- {name} ({label}): {n} responses{share(n, unique)}" for label, name, n in sorted(selection, key=lambda s: (-s[2], s[0]))]
    for name in dict.fromkeys(k.rsplit("_", 1)[0].removesuffix("_in") for k in denominators if k != "n"):
        scope, coded, match = (denominators.get(f"{name}_{k}", 0) for k in ("in_scope", "coded", "matching"))
        lines.append(f"- {name}: {match} of {coded} coded, {scope} in scope")
    return "\n".join([*lines, f"- unique responses: {unique}"])


def quotes_block(quotes: list[tuple[str, str, str]], limit: int = 4000) -> tuple[str, dict[int, str]]:
    """Numbered quotes under their category, and the number of each text."""
    out, numbered, last = [], {}, None
    for n, (category, key, text) in enumerate(quotes, 1):
        if category != last:
            out.append(f"## {category}")
            last = category
        numbered[n] = text
        out.append(f"[{n}] {text if len(text) <= limit else text[:limit].rstrip() + '…'} ({key})")
    return "\n".join(out), numbered


def section_plan(selection: list[tuple[str, int]], rest: int, sections: int = 8) -> str:
    """The largest categories, one line each, and what is left as one union."""
    lines = [f"{i}. {name} — {n} responses" for i, (name, n) in enumerate(selection[:sections], 1)]
    return "\n".join(lines + ([f"Everything else — {rest} responses"] if rest else []))


def process_note(route: Route, unique: int, cited: int) -> str:
    parts = [f"Searched {len(route.candidates)} categories; {unique} responses matched; {cited} quoted."]
    f = route.filters
    asked = [x for x in (f.actionability, "events only" if f.event else "", f.time, ", ".join(f.places), ", ".join(f"{k} = {' or '.join(v)}" for k, v in f.demographics.items())) if x]
    if asked:
        parts.append("Filters: " + "; ".join(asked) + ".")
    if route.dropped:
        parts.append("Left out: " + ", ".join(f"{n} {k}" for k, n in sorted(route.dropped.items())) + ".")
    return " ".join(parts)


def summary_text(questions: list[tuple[int, str, list[tuple[str, str, int]]]], concepts: dict[str, int] | None = None, places: dict[str, int] | None = None, shown: int = 200) -> str:
    """SF-23: what a model is told of a dataset before it makes a route: every question with its categories, largest first, then concepts and places."""
    out = []
    for number, wording, labels in questions:
        out.append(f"Q{number}: {wording[:shown]}")
        out += [f"  {label} {name} ({n})" for label, name, n in sorted(labels, key=lambda x: (-x[2], x[1].lower(), x[0]))] or ["  (no categories)"]
    for title, counts in (("Concepts", concepts), ("Places", places)):
        if counts:
            out.append(f"{title}: " + ", ".join(f"{c} ({n})" for c, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))))
    return "\n".join(out)


def review_report(counts: dict[str, int], overlaps: list[tuple[str, str, int, int]], twice: dict[str, list[str]], empty: list[str], orphans: list[str], pool: list[tuple[str, str]], shown: int = 10) -> str:
    """SF-23: the diagnostics of a taxonomy (AG-21, JN-10) for the person who reviews it; ``overlaps`` are label, label, shared, smaller."""
    out = [f"{counts.get('n_labels', 0)} categories, {counts.get('coded', 0)} coded responses, {counts.get('pool', 0)} uncovered{share(counts.get('pool', 0), counts.get('coded', 0))}"]
    out += [f"overlap: {a} and {b} share {n} of {smaller}{share(n, smaller)}" for a, b, n, smaller in sorted(overlaps, key=lambda o: (-o[2] / max(1, o[3]), o[0], o[1]))]
    out += [f"one name: {name}: {', '.join(ids)}" for name, ids in sorted(twice.items())]
    out += [f"no members: {x}" for x in empty] + [f"no parent: {x}" for x in orphans]
    out += [f"uncovered: {key}: {text[:160].rstrip() + '…' if len(text) > 160 else text}" for key, text in pool[:shown]]
    return "\n".join(out + ([f"and {len(pool) - shown} more uncovered"] if len(pool) > shown else []))
