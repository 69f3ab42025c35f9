"""Plans: what a question asks for, as checked data. No plan holds a number that it would answer with."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Fixed values of the plan format.
AGGREGATES = ("sum", "avg", "min", "max", "count")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=")
DERIVATIONS = ("divide", "subtract", "percent_change")
GROUP_OPERATIONS = ("level", "difference", "ratio", "percent_change")
REASONS = (
    "no_such_column",
    "value_not_in_column",
    "not_a_data_question",
    "empty_result",
    "unsupported_operation",
    "planner_failed",
    "ambiguous_value",
)


class PlanFailure(ValueError):
    """The plan is at fault: a name, an operation or a shape that cannot be answered as asked."""


class VerificationError(AssertionError):
    """A finished answer contradicts its own cells: the engine is at fault, not the data."""


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise PlanFailure(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: str

    def __post_init__(self) -> None:
        _one_of(self.op, OPERATORS, "an operator")


@dataclass(frozen=True)
class Aggregate:
    agg: str
    column: str

    def __post_init__(self) -> None:
        _one_of(self.agg, AGGREGATES, "an aggregate")


@dataclass(frozen=True)
class QueryPlan:
    metric: Aggregate
    filters: tuple[Condition, ...] = ()
    group_by: tuple[str, ...] = ()
    sort: str = "none"
    limit: int = 0
    narration: str = "{v1}"

    def __post_init__(self) -> None:
        _one_of(self.sort, ("asc", "desc", "none"), "a sort order")
        if self.limit < 0:
            raise PlanFailure("a limit is 0 (none) or more")

    @property
    def slots(self) -> list[str]:
        return [f"v{i + 1}" for i in range(len(self.group_by) + 1)]


@dataclass(frozen=True)
class Part:
    """One aggregate with filters of its own; a derived plan has two."""

    name: str
    metric: Aggregate
    filters: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class DerivedPlan:
    parts: tuple[Part, Part]
    op: str
    of: str
    by: str
    scale: float = 1.0
    narration: str = "{v1}"

    def __post_init__(self) -> None:
        _one_of(self.op, DERIVATIONS, "a derivation")
        names = [p.name for p in self.parts]
        if len(self.parts) != 2 or len(set(names)) != 2 or {self.of, self.by} != set(names):
            raise PlanFailure("a derived plan combines exactly two differently named parts")


@dataclass(frozen=True)
class MultiStepPlan:
    """A value for each group, then one aggregate over the groups."""

    measure: str
    group: str
    operation: str
    outer: str
    to: tuple[Condition, ...]
    start: tuple[Condition, ...] = ()
    inner: str = "sum"

    def __post_init__(self) -> None:
        _one_of(self.operation, GROUP_OPERATIONS, "a group operation")
        _one_of(self.outer, AGGREGATES, "an aggregate")
        _one_of(self.inner, AGGREGATES, "an aggregate")
        if self.operation != "level" and not self.start:
            raise PlanFailure(f"{self.operation} needs two sets of filters")


@dataclass(frozen=True)
class Abstain:
    reason: str
    detail: str = ""

    def __post_init__(self) -> None:
        _one_of(self.reason, REASONS, "a reason")


Plan = QueryPlan | DerivedPlan | MultiStepPlan | Abstain


def _conditions(raw: list[dict[str, str]] | None) -> tuple[Condition, ...]:
    return tuple(Condition(f["column"], f["op"], str(f["value"])) for f in raw or [])


def plan_from_dict(raw: dict[str, Any]) -> Plan:
    """The plan that a model or a caller wrote as JSON: ``{"plan": {"kind": ...}}`` or its inner object."""
    p = raw.get("plan", raw)
    try:
        kind = p["kind"]
        if kind == "query":
            return QueryPlan(
                Aggregate(p["metric"]["agg"], p["metric"]["column"]), _conditions(p.get("filters")), tuple(p.get("group_by") or ()),
                p.get("sort", "none"), int(p.get("limit", 0)), p["narration"],
            )
        if kind == "derived":
            parts = tuple(Part(m["name"], Aggregate(m["agg"], m["column"]), _conditions(m.get("filters"))) for m in p["measures"])
            d = p["derive"]
            return DerivedPlan(parts, d["op"], d["of"], d["by"], float(d.get("scale", 1.0)), p["narration"])  # type: ignore[arg-type]
        if kind == "abstain":
            return Abstain(p["reason_code"], p.get("detail", ""))
    except (KeyError, TypeError) as e:
        raise PlanFailure(f"the plan lacks {e}") from e
    raise PlanFailure(f"unknown kind of plan: {kind!r}")


@dataclass
class Citation:
    sheet: str
    a1: str
    raw_value: str | None
    formula: str | None = None


@dataclass
class Value:
    raw: Any
    formatted: str
    unit: str | None = None
    citations: list[Citation] = field(default_factory=list)
    parts: dict[str, "Value"] = field(default_factory=dict)
    derivation: str | None = None


@dataclass
class Answer:
    question: str
    status: str
    narration: str = ""
    slots: dict[str, Value] = field(default_factory=dict)
    reason: str | None = None
    options: list[str] = field(default_factory=list)
    note: str | None = None
    plan: Plan | None = None
    echo: str = ""

    @property
    def text(self) -> str:
        """The sentence a reader sees. Numbers come out of slots only."""
        if self.status != "answered":
            lead = "I can't answer this from the file — " if self.status == "abstained" else ""
            return lead + (self.reason or "")
        out = self.narration
        for name, v in self.slots.items():
            out = out.replace("{" + name + "}", f"{v.formatted} {v.unit}" if v.unit else v.formatted)
        return out

    def citations(self) -> list[Citation]:
        """All cells behind the answer, depth first; a cell used twice is listed twice."""
        out: list[Citation] = []

        def walk(v: Value) -> None:
            out.extend(v.citations)
            for part in v.parts.values():
                walk(part)

        for v in self.slots.values():
            walk(v)
        return out
