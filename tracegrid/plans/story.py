"""A survey of a workbook: the findings worth a slide, in a fixed order, each with its cells."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators import findings, lineage
from tracegrid.operators.execute import all_of, formatted, quoted
from tracegrid.plans.catalog import Catalog
from tracegrid.plans.model import Citation
from tracegrid.plans.present import slides
from tracegrid.plans.validate import with_defaults

TOP = 5


def _cells(rows: DataFrame, cell_map: DataFrame, measure: str) -> list[Citation]:
    return lineage.as_citations(lineage.citations(rows, cell_map, measure))


def survey(table: DataFrame, cell_map: DataFrame, catalog: Catalog, entity: str, period: str | None) -> list[dict[str, Any]]:
    """count (without periods), trend, leaderboard, share of the leader, its growth, leaders of other measures."""
    measure = catalog.measure
    base = table.filter(all_of(with_defaults((), catalog), catalog))
    out: list[dict[str, Any]] = []
    if period is None:
        n = findings.entity_count(base, entity).first()["n"]
        out.append({"kind": "count", "text": f"{formatted(n)} rows of {entity}", "value": n, "cells": _cells(base.filter(quoted(entity).isNotNull()), cell_map, entity)})
    else:
        points = findings.trend(base, period, measure).orderBy("period").collect()  # one for each period
        if len(points) >= 3:
            ends = findings.trend_summary(base, period, measure).first()
            verb = "risen" if ends["risen"] else "fallen"
            text = f"{measure} has {verb} from {formatted(ends['first_value'])} in {ends['first']} to {formatted(ends['last_value'])} in {ends['last']}"
            out.append({"kind": "trend", "text": text, "points": [(p["period"], p["value"]) for p in points], "cells": _cells(base, cell_map, measure)})
    latest = max((p for p in catalog.labels_for(period)), default=None) if period else None
    own = base.filter(quoted(period) == latest) if latest else base  # type: ignore[arg-type]
    top = findings.leaderboard(own, entity, measure, TOP).orderBy("rank").collect()
    if top:
        when = f" in {latest}" if latest else ""
        cells = lineage.as_citations(findings.leaderboard_cells(own, cell_map, entity, measure, TOP).orderBy("rank", "sheet", "a1"))
        out.append({"kind": "leaderboard", "text": f"The {len(top)} largest by {measure}{when}", "rows": [(r["entity"], r["value"]) for r in top], "cells": cells})
    if latest:
        lead = findings.leader_share(base, entity, period, measure).first()  # type: ignore[arg-type]
        out.append({"kind": "share", "text": f"{lead['entity']} is {formatted(lead['share'])} % of the whole in {latest}", "value": lead["share"], "cells": _cells(own, cell_map, measure)})
        first = min(catalog.labels_for(period))  # type: ignore[arg-type]
        grown = findings.entity_growth(base, entity, period, measure, first, latest).filter(F.col("entity") == lead["entity"]).first()  # type: ignore[arg-type]
        if grown and grown["pct"] is not None:
            rows = base.filter((quoted(entity) == lead["entity"]) & quoted(period).isin(first, latest))  # type: ignore[arg-type]
            out.append({"kind": "growth", "text": f"{lead['entity']} changed by {formatted(grown['pct'])} % from {first} to {latest}", "value": grown["pct"], "cells": _cells(rows, cell_map, measure)})
    others = [c.name for c in catalog.columns if c.is_measure and c.name != measure]
    if others:
        for r in findings.measure_leaders(base, entity, others).collect():  # one for each measure
            rows = base.filter((quoted(entity) == r["entity"]) & (quoted(r["measure"]) == r["value"]))
            out.append({"kind": "leader", "text": f"{r['entity']} leads by {r['measure']} with {formatted(r['value'])}", "value": r["value"], "cells": _cells(rows, cell_map, r["measure"])})
    return out


def deck(title: str, found: list[dict[str, Any]], order: Callable[[list[str]], list[int]] | None = None) -> list[dict[str, Any]]:
    """Slides of a survey. ``order`` may pick and order findings by their texts; it adds none and changes none."""
    try:
        picked = [found[i] for i in dict.fromkeys(order([f["text"] for f in found]))] if order else found
    except Exception:  # a model that answers nonsense leaves the order as it was
        picked = found
    return slides(title, picked or found)
