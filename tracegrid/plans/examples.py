"""Worked examples for a planner, made of the catalog's own columns and labels, so that none says a thing the file does not."""

from __future__ import annotations

import json
from typing import Any

from tracegrid.plans.catalog import Catalog, Column


def _equal(pairs: list[tuple[str | None, str | None]]) -> list[dict[str, str]]:
    return [{"column": c, "op": "=", "value": v} for c, v in pairs if c and v is not None]


def _query(measure: str, filters: list[dict], narration: str, group: str | None = None) -> dict[str, Any]:
    plan: dict[str, Any] = {"kind": "query", "metric": {"agg": "sum", "column": measure}, "filters": filters, "group_by": [group] if group else [], "narration": narration}
    return plan | ({"sort": "desc", "limit": 1} if group else {})


def _derived(measure: str, op: str, of: list[dict], by: list[dict], narration: str) -> dict[str, Any]:
    part = lambda name, filters: {"name": name, "agg": "sum", "column": measure, "filters": filters}
    return {"kind": "derived", "measures": [part("m1", of), part("m2", by)], "derive": {"op": op, "of": "m1", "by": "m2", "scale": 100}, "narration": narration}


def _third(catalog: Catalog, taken: set[str | None]) -> Column | None:
    """Another dimension to filter by: of those with labels, the one with fewest, as it is a closed set."""
    free = [c for c in catalog.columns if c.labels and not c.internal and c.name not in taken]
    return min(free, key=lambda c: len(c.labels), default=None)


def examples(catalog: Catalog) -> list[tuple[str, dict[str, Any]]]:
    """Questions with their plans. What has no label to show is left out; a file without periods shows no change over time."""
    named = [c.name for c in catalog.columns if not c.internal]
    entity = catalog.entity or next((n for n in named if catalog.labels_for(n)), named[0] if named else catalog.measure)
    period = catalog.period or next((c.name for c in catalog.scopes), None)
    times = catalog.labels_for(period) if period else []
    who = next(iter(catalog.labels_for(entity)), None)
    unit = f" {catalog.unit}" if catalog.unit else ""
    out: list[tuple[str, dict[str, Any]]] = []
    if not times:
        measure = next((c.name for c in catalog.columns if c.is_measure and not c.internal), catalog.measure)
        out.append((f"which {entity} has the highest {measure}?", _query(measure, [], f"{{v1}} comes first by {measure}, with {{v2}}.", entity)))
        if who:
            out.append((f"what is the {measure} of {who}?", _query(measure, _equal([(entity, who)]), f"The {measure} of {who} is {{v1}}.")))
    else:
        now, before = times[-1], times[-2] if len(times) > 1 else None
        third = _third(catalog, {entity, period, catalog.measure})
        rest = [(third.name, third.labels[0])] if third else []
        whole = _equal([*rest, (period, now)])
        own = _equal([(entity, who), *rest, (period, now)])
        if who:
            out.append((f"what was {who} in {now}?", _query(catalog.measure, own, f"{who} was {{v1}}{unit} in {now}.")))
        out.append((f"which {entity} came first in {now}?", _query(catalog.measure, whole, f"In {now} {{v1}} came first with {{v2}}{unit}.", entity)))
        if who and before:
            then = _equal([(entity, who), *rest, (period, before)])
            out.append((f"by how much did {who} move from {before} to {now}?", _derived(catalog.measure, "percent_change", own, then, f"From {before} to {now}, {who} moved by {{v1}}%.")))
            out.append((f"how large a part of the whole was {who} in {now}?", _derived(catalog.measure, "divide", own, whole, f"{who} makes up {{v1}}% of the whole in {now}.")))
    for lacking in catalog.absent[:1]:
        out.append((f"how much {lacking} was there?", {"kind": "abstain", "reason_code": "no_such_column", "detail": lacking}))
    if period:
        out.append(("what was it at a time that the file does not reach?", {"kind": "abstain", "reason_code": "value_not_in_column", "detail": period}))
    return out


def examples_text(catalog: Catalog) -> str:
    """The examples as a prompt shows them; labels with quotes or line ends stay valid JSON."""
    return "\n\n".join(f"Question: {' '.join(q.split())}\n{json.dumps({'plan': p}, ensure_ascii=False)}" for q, p in examples(catalog))
