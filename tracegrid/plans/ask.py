"""The front door: a question becomes an answer with cells, a question back, or a refusal; never a guess."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame

from tracegrid.operators import execute, lineage
from tracegrid.plans import gates
from tracegrid.plans.catalog import Catalog
from tracegrid.plans.examples import examples_text
from tracegrid.plans.model import Abstain, Answer, Citation, DerivedPlan, Plan, PlanFailure, QueryPlan, Value, VerificationError, plan_from_dict
from tracegrid.plans.sqldag import build
from tracegrid.plans.sqlgate import gated, problems
from tracegrid.plans.validate import check_derived, check_query

ATTEMPTS = 3
OPTIONS = 6
DERIVATION_TEXT = {"divide": "{of} / {by}", "subtract": "{of} - {by}", "percent_change": "({of} - {by}) / {by}"}


class Planner(Protocol):
    """Turns a question into plan JSON. A language model is one; any callable of this shape will do."""

    def plan(self, question: str, prompt: str) -> dict[str, Any]: ...

    def sql(self, question: str, prompt: str) -> dict[str, str] | None: ...


class Fixed:
    """A planner that knows its plans beforehand; for tests and scripted reports."""

    def __init__(self, plans: dict[str, dict[str, Any]], sql: dict[str, dict[str, str]] | None = None):
        self.plans, self.statements = plans, sql or {}

    def plan(self, question: str, prompt: str) -> dict[str, Any]:
        return self.plans.get(question, {"kind": "abstain", "reason_code": "not_a_data_question"})

    def sql(self, question: str, prompt: str) -> dict[str, str] | None:
        return self.statements.get(question)


def refusal(reason: str, detail: str, catalog: Catalog) -> str:
    """The sentence for a refusal, written from the catalog and never by a model."""
    column = catalog.column(detail)
    return {
        "no_such_column": f"it holds no {detail or 'such column'}.",
        "value_not_in_column": f"{detail or 'that value'} is not among its labels.",
        "not_a_data_question": "I found nothing in the question to look up.",
        "empty_result": "no rows match.",
        "unsupported_operation": f"{detail or 'that'} is beyond what I can compute from it.",
        "planner_failed": "no reliable plan could be made for the question.",
        "ambiguous_value": f"which {column.name if column else detail} is meant is unclear.",
    }[reason]


def _abstain(question: str, reason: str, detail: str, catalog: Catalog, plan: Plan | None = None) -> Answer:
    return Answer(question, "abstained", reason=refusal(reason, detail, catalog), plan=plan)


def _clarify(question: str, text: str, options: list[str], plan: Plan | None = None) -> Answer:
    return Answer(question, "clarify", reason=text, options=options, plan=plan)


def prompt_of(catalog: Catalog) -> str:
    """What a planner is told: the catalog, and examples made of it."""
    return f"{catalog.to_prompt()}\n\n{examples_text(catalog)}"


def planned(question: str, catalog: Catalog, planners: list[Planner], previous: Plan | None) -> Plan:
    """The first plan that names all the question names, invents nothing and compiles, cheapest planner first."""
    guessed: str | None = None
    for planner in planners:
        for _ in range(ATTEMPTS):
            try:
                plan = plan_from_dict(planner.plan(question, prompt_of(catalog)))
                if isinstance(plan, Abstain):
                    return plan
                if gates.dropped_filters(question, plan, catalog):
                    break
                if made_up := gates.invented_filters(question, plan, catalog, previous):
                    guessed = made_up[0].split("=")[0]
                    break
                check_query(plan, catalog) if isinstance(plan, QueryPlan) else check_derived(plan, catalog)  # type: ignore[arg-type]
                return plan
            except PlanFailure:
                continue
    return Abstain("ambiguous_value", guessed) if guessed else Abstain("planner_failed")


def echo(plan: Plan, sources: dict[str, str] | None = None) -> str:
    """What was computed, in words, with the source of each filter that was not stated."""
    if isinstance(plan, QueryPlan):
        notes = {k: f" ({v})" for k, v in (sources or {}).items() if v in (gates.INHERITED, gates.DEFAULT)}
        where = ", ".join(f"{f.column} {f.op} {f.value}{notes.get(f.column, '')}" for f in plan.filters)
        return f"{plan.metric.agg} of {plan.metric.column}" + (f" where {where}" if where else "") + (f" by {', '.join(plan.group_by)}" if plan.group_by else "")
    return plan.op.replace("_", " ") if isinstance(plan, DerivedPlan) else type(plan).__name__


class Workbook:
    """A tidy table with its receipts and catalog: what questions are asked of."""

    def __init__(self, table: DataFrame, cell_map: DataFrame, catalog: Catalog):
        self.table, self.cell_map, self.catalog = table, cell_map, catalog

    def _cells(self, rows: DataFrame, column: str) -> list[Citation]:
        return lineage.as_citations(lineage.citations(rows, self.cell_map, column))

    def answer_query(self, question: str, plan: QueryPlan, sources: dict[str, str] | None = None) -> Answer:
        made = execute.compile_query(plan, self.catalog, self.table)
        rows = made.value.limit(OPTIONS + 1).collect()
        if not rows or (len(rows) == 1 and rows[0][-1] is None):
            return _abstain(question, "empty_result", "", self.catalog, plan)
        if plan.group_by and len(rows) > 1:
            return _clarify(question, f"That is a value for each {plan.group_by[0]}; which one?", [str(r[0]) for r in rows[:OPTIONS]], plan)
        row, unit = rows[0], self.catalog.unit if plan.metric.column == self.catalog.measure and plan.metric.agg != "count" else None
        behind = made.provenance(tuple(row[: len(plan.group_by)]))
        slots = {}
        for slot, name, v in zip(plan.slots, plan.group_by, row):
            slots[slot] = Value(v, str(v), citations=lineage.as_citations(lineage.first_citation(behind, self.cell_map, name)))
        slots[plan.slots[-1]] = Value(row[-1], execute.formatted(row[-1]), unit, self._cells(behind, plan.metric.column))
        out = Answer(question, "answered", plan.narration, slots, plan=made.plan, echo=echo(made.plan, sources))
        if plan.metric.agg == "count" and row[-1] == 0:
            out.note = "no rows matched"
        lineage.verify_cells(row[-1], lineage.citations(behind, self.cell_map, plan.metric.column), slots[plan.slots[-1]].citations, plan.metric.agg)
        self._check_digits(out, made.plan)
        return out

    def answer_derived(self, question: str, plan: DerivedPlan) -> Answer:
        made = execute.compile_derived(plan, self.catalog, self.table)
        row = made.value.first()
        if row["of"] is None or row["by"] is None or row["v1"] is None:
            return _abstain(question, "empty_result", "", self.catalog, plan)
        parts = {}
        for p, v in ((plan.of, row["of"]), (plan.by, row["by"])):
            metric = next(x.metric for x in plan.parts if x.name == p)
            unit = self.catalog.unit if metric.column == self.catalog.measure else None
            parts[p] = Value(v, execute.formatted(v), unit, self._cells(made.provenance(p), metric.column))
            lineage.verify_cells(v, lineage.citations(made.provenance(p), self.cell_map, metric.column), parts[p].citations, metric.agg)
        a, b = row["of"], row["by"]
        again = {"divide": lambda: a / b, "subtract": lambda: a - b, "percent_change": lambda: (a - b) / b}[plan.op]() * plan.scale
        if abs(again - row["v1"]) > lineage.TOLERANCE * max(1.0, abs(row["v1"])):
            raise VerificationError(f"{plan.op} of the parts gives {again}, the answer says {row['v1']}")
        text = DERIVATION_TEXT[plan.op].format(of=plan.of, by=plan.by) + (f" x {plan.scale:g}" if plan.scale != 1 else "")
        out = Answer(question, "answered", plan.narration, {"v1": Value(row["v1"], execute.formatted(row["v1"]), None, [], parts, text)}, plan=plan, echo=echo(plan))
        self._check_digits(out, plan)
        return out

    def answer_sql(self, question: str, sql: str, narration: str = "{v1}") -> Answer | None:
        """A gated statement with exactly one row and one number, cited through its operator DAG; else None."""
        if problems(self.table, self.catalog.table, sql):
            return None
        rows = gated(self.table, self.catalog.table, sql).limit(2).collect()
        numbers = [v for v in rows[0] if isinstance(v, (int, float)) and not isinstance(v, bool)] if len(rows) == 1 else []
        if len(numbers) != 1:
            return None
        dag = build(self.table, self.catalog.table, sql)
        cells = lineage.as_citations(dag.citations(self.cell_map))
        if not cells:
            return None
        kind = dag.classify()
        out = Answer(question, "answered", narration, {"v1": Value(numbers[0], execute.formatted(numbers[0]), None, cells)}, echo=sql)
        out.note = "the cells are a superset of those that matter" if kind == "approximate" else None
        self._check_digits(out, None)
        return out

    def _check_digits(self, answer: Answer, plan: Plan | None) -> None:
        backing = [answer.question, *[f.value for f in gates.filters_of(plan)]]
        for v in answer.slots.values():
            backing += [v.formatted, v.unit or ""]
        if loose := lineage.unbacked_numbers(answer.text, backing):
            raise VerificationError(f"numbers from nowhere: {', '.join(loose)}")

    def ask(self, question: str, planners: list[Planner], memory: gates.Memory | None = None) -> Answer:
        c, previous = self.catalog, memory.previous if memory else None
        if term := gates.absent_concept(question, c):
            return _abstain(question, "no_such_column", term, c)
        if what := gates.unsupported_operation(question):
            return self._by_sql(question, planners) or _abstain(question, "unsupported_operation", what, c)
        if gap := gates.unanchored_period(question, c):
            return _clarify(question, f"Relative to which {gap[0]}?", gap[1][-3:][::-1])
        if found := gates.ambiguities(question, c):
            return _clarify(question, found[0].question(), list(found[0].candidates))
        plan = planned(question, c, planners, previous)
        if isinstance(plan, Abstain):
            if plan.reason == "ambiguous_value":
                return _clarify(question, f"Which {plan.detail}?", c.labels_for(plan.detail)[:OPTIONS], plan)
            own = self._by_sql(question, planners) if plan.reason in ("planner_failed", "unsupported_operation") else None
            return own or _abstain(question, plan.reason, plan.detail, c, plan)
        if gap := gates.scope_gap(question, plan, c):
            return _clarify(question, f"For which {gap[0]}?", [f"all {gap[0]}s", *gap[1][-3:][::-1]], plan)
        if measures := gates.measure_gap(question, plan, c):
            return _clarify(question, "Which measure?", measures, plan)
        if text := gates.denominator_gap(plan):
            return _clarify(question, text, [], plan)
        sources = gates.sources_of_filters(question, plan, previous, c)
        out = self.answer_query(question, plan, sources) if isinstance(plan, QueryPlan) else self.answer_derived(question, plan)  # type: ignore[arg-type]
        if memory and out.status == "answered":
            memory.remember(question, plan)
        return out

    def _by_sql(self, question: str, planners: list[Planner]) -> Answer | None:
        for p in planners:
            if made := p.sql(question, self.catalog.to_prompt()):
                if out := self.answer_sql(question, made["sql"], made.get("narration", "{v1}")):
                    return out
        return None


def trace(path: str, answer: Answer, seconds: float, write: Callable[[str, str], None] | None = None) -> str:
    """One JSON line about an answered question, added to a file."""
    line = json.dumps({"t": time.time(), "question": answer.question, "status": answer.status, "text": answer.text, "ms": round(seconds * 1000), "echo": answer.echo, "cells": len(answer.citations())})
    if write:
        write(path, line)
    else:
        with open(path, "a", encoding="utf-8") as f:
            f.write(line + "\n")
    return line
