"""Lineage of a SQL answer: its operators as a DAG whose nodes know, lazily, the rows they rest on.

The DAG is read off Spark's analysed plan. A filter over the base table alone is re-applied to it to name
rows; common table expressions are shared nodes. A window, and a filter on anything but base columns (a sum, a
subquery), pass on their whole input, which makes the lineage a superset, and so it is called approximate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

from tracegrid.operators import lineage
from tracegrid.plans.sqlgate import _analysed, problems, scala_items


@dataclass
class Node:
    id: int
    kind: str
    inputs: list[int] = field(default_factory=list)
    predicate: str | None = None
    approximate: bool = False


@dataclass
class OperatorDag:
    table: DataFrame
    nodes: list[Node] = field(default_factory=list)
    root: int = 0
    measures: list[str] = field(default_factory=list)

    def add(self, kind: str, inputs: list[int], predicate: str | None = None, approximate: bool = False) -> int:
        self.nodes.append(Node(len(self.nodes), kind, inputs, predicate, approximate))
        return len(self.nodes) - 1

    def scans(self, node: int) -> dict[int, list[str]]:
        """The scans below a node, each with the predicates between it and the node."""
        n = self.nodes[node]
        if n.kind == "scan":
            return {node: []}
        out: dict[int, list[str]] = {}
        for i in n.inputs:
            for scan, predicates in self.scans(i).items():
                out[scan] = predicates + ([n.predicate] if n.predicate else [])
        return out

    def rows(self, node: int) -> DataFrame:
        """``__row_id`` of the base rows that a node rests on: the union over its scans."""
        parts = []
        for predicates in self.scans(node).values():
            own = self.table
            for p in predicates:
                own = own.filter(p)
            parts.append(own.select("__row_id"))
        return reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0] if parts else self.table.select("__row_id").filter(F.lit(False))

    def root_rows(self) -> DataFrame:
        return self.rows(self.root)

    def citations(self, cell_map: DataFrame, node: int | None = None) -> DataFrame:
        """Receipts of every measure that the statement names."""
        rows = self.rows(self.root if node is None else node)
        return reduce(DataFrame.unionByName, [lineage.citations(rows, cell_map, m) for m in self.measures])

    def classify(self) -> str:
        """approximate where a window or a filter passed on more than it used, flat where all is one scan, precise otherwise."""
        if any(n.approximate for n in self.nodes):
            return "approximate"
        return "flat" if sum(n.kind in ("scan", "cte", "scalar") for n in self.nodes) == 1 else "precise"


def _expressions(node) -> list:  # noqa: ANN001
    """An expression and all it is made of."""
    found, todo = [], [node]
    while todo:
        e = todo.pop()
        found.append(e)
        todo += scala_items(e.children())
    return found


def _base_predicate(condition, base: dict[int, str], table: DataFrame) -> str | None:  # noqa: ANN001
    """A condition of the analysed plan as SQL over the base table; None if it rests on anything else.

    Columns are known by their attribute ids, not by their names: an alias of the same name is another
    attribute. Each base attribute, as the plan prints it, becomes its plain column outside of string literals.
    """
    names = {}
    for e in _expressions(condition):
        kind = e.getClass().getSimpleName()
        if "ubquery" in kind or kind in ("Exists", "OuterReference"):
            return None
        if kind == "AttributeReference":
            if e.exprId().id() not in base:
                return None
            names[e.sql()] = "`" + base[e.exprId().id()].replace("`", "``") + "`"
    if not names:
        return None
    printed = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    parts = re.split(r"('(?:[^'\\\\]|\\\\.)*')", condition.sql())
    text = "".join(x if i % 2 else re.sub(rf"(?<![\w`.])(?:{printed})(?![\w`])", lambda m: names[m[0]], x) for i, x in enumerate(parts))
    try:
        table.filter(text).schema  # noqa: B018  what the plan prints need not parse again
    except (AnalysisException, ParseException):
        return None
    return text


def build(table: DataFrame, name: str, sql: str) -> OperatorDag:
    """The operator DAG of a gated statement."""
    if bad := problems(table, name, sql):
        raise ValueError("; ".join(bad))
    dag = OperatorDag(table)
    analysed = _analysed(table, name, sql)._jdf.queryExecution().analyzed()
    numeric = [c for c, t in table.dtypes if t in ("double", "bigint", "int", "float") and not c.startswith("__")]
    dag.measures = [c for c in numeric if re.search(rf"\b{re.escape(c)}\b", sql)] or numeric[:1]
    shared: dict[int, int] = {}
    base: dict[int, str] = {}  # attribute ids of all scans of the table

    def convert(node) -> int:  # noqa: ANN001
        kind = node.getClass().getSimpleName()
        if kind == "SubqueryAlias" and scala_items(node.identifier().qualifier()) == [] and str(node.identifier().name()).lower() == name.lower():
            base.update({a.exprId().id(): a.name() for a in scala_items(node.output())})
            return dag.add("scan", [])
        if kind == "WithCTE":
            for d in scala_items(node.cteDefs()):
                shared[d.id()] = dag.add("cte", [convert(d.child())])
            return convert(node.plan())
        if kind == "CTERelationRef":
            return shared[node.cteId()]
        inputs = [convert(c) for c in scala_items(node.children())]
        scalars = [dag.add("scalar", [convert(s)]) for s in scala_items(node.subqueries())]
        if kind in ("SubqueryAlias", "View"):
            return inputs[0]
        if kind == "Filter":
            predicate = _base_predicate(node.condition(), base, table)
            return dag.add("filter", inputs + scalars, predicate, approximate=predicate is None)
        if kind == "OneRowRelation":
            return dag.add("one", [])
        return dag.add(kind.lower(), inputs + scalars, approximate=kind == "Window")

    dag.root = convert(analysed)
    return dag
