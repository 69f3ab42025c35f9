"""Answers and findings as plain data for a page or a deck."""

from __future__ import annotations

import re
from typing import Any

from tracegrid.plans.catalog import Catalog
from tracegrid.plans.model import Answer, Citation, Value


def cell_ranges(cells: list[Citation]) -> list[str]:
    """Cells of one answer as ranges by sheet and column; odd addresses stand alone."""
    runs: dict[tuple[str, str], set[int]] = {}
    odd = []
    for c in cells:
        if m := re.fullmatch(r"([A-Z]+)(\d+)", c.a1):
            runs.setdefault((c.sheet, m[1]), set()).add(int(m[2]))
        else:
            odd.append(f"{c.sheet}!{c.a1}")
    out = []
    for (sheet, letter), rows in sorted(runs.items()):
        ordered = sorted(rows)
        start = prev = ordered[0]
        for r in [*ordered[1:], None]:
            if r is None or r != prev + 1:
                out.append(f"{sheet}!{letter}{start}" + (f":{letter}{prev}" if prev > start else ""))
                start = r
            prev = r
    return out + odd


def value_json(v: Value) -> dict[str, Any]:
    return {
        "raw": v.raw, "formatted": v.formatted, "unit": v.unit, "derivation": v.derivation, "ranges": cell_ranges(v.citations),
        "cells": [vars(c) for c in v.citations], "parts": {k: value_json(p) for k, p in v.parts.items()},
    }


def answer_json(a: Answer) -> dict[str, Any]:
    return {"question": a.question, "status": a.status, "text": a.text, "options": a.options, "note": a.note, "echo": a.echo, "slots": {k: value_json(v) for k, v in a.slots.items()}}


def pretty_sql(sql: str) -> str:
    """A statement with its clauses on lines of their own; for display only."""
    words = r"\b(FROM|WHERE|GROUP BY|HAVING|ORDER BY|LIMIT|UNION(?: ALL)?)\b"
    return re.sub(r"\s+" + words, lambda m: "\n" + m[1].upper(), " ".join(sql.split()), flags=re.I)


def starter_questions(catalog: Catalog, entity: str, period: str | None) -> list[str]:
    """Up to four questions made of the file's own labels; the last may be one it cannot answer."""
    tidy = lambda x: " ".join(str(x).split())
    who, when = catalog.labels_for(entity)[:1], (catalog.labels_for(period) if period else [])[-1:]
    measures = [c.name for c in catalog.columns if c.is_measure]
    if not when:
        out = [f"Which {entity} has the highest {tidy(m)}?" for m in measures[:2]]
        return [*out[:1], *[f"What is {tidy(w)}'s {tidy(measures[0])}?" for w in who if measures], *out[1:]][:4]
    out = [f"Which {entity} was highest in {tidy(when[0])}?"]
    out = [f"What was {tidy(w)} in {tidy(when[0])}?" for w in who] + out + [f"What share of the total was {tidy(w)} in {tidy(when[0])}?" for w in who]
    return (out + [f"How much {x} was there in {tidy(when[0])}?" for x in catalog.absent[:1]])[:4]


def footnote(cells: list[Citation], most: int = 3) -> str:
    refs = [f"{c.sheet}!{c.a1}" for c in cells]
    return ", ".join(refs[:most]) + (f" +{len(refs) - most} more" if len(refs) > most else "")


def slides(title: str, findings: list[dict[str, Any]], closing: str = "") -> list[dict[str, Any]]:
    """A deck as data: a cover, one slide for each finding with its footnote, and a closing slide."""
    out: list[dict[str, Any]] = [{"kind": "cover", "title": title}]
    for f in findings:
        kind = "leaderboard" if "rows" in f else "trend" if "points" in f else "stat"
        out.append({"kind": kind, "headline": f.get("text", ""), "data": f.get("rows") or f.get("points") or f.get("value"), "footnote": footnote(f.get("cells", []))})
    return [*out, {"kind": "closing", "text": closing}] if closing else out
