"""SQL over one table, behind an allow-list on Spark's own parsed plan.

Spark has no read-only mode, so what is not known to be harmless is refused: one query, only the given table
and the names it defines itself, only relational nodes, only the functions listed here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException, ParseException

ALLOWED_NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "Union", "Intersect", "Except",
    "UnresolvedInlineTable", "OneRowRelation", "WithWindowDefinition", "Window", "Pivot", "UnresolvedQualify",
}
# What a statement may call, by family; all else is refused, whatever it does.
ALLOWED_FUNCTIONS = set(
    # aggregates
    "count count_if sum avg mean min max any_value first last min_by max_by mode median percentile percentile_cont percentile_disc percentile_approx "
    "approx_count_distinct stddev stddev_samp stddev_pop std variance var_samp var_pop corr covar_samp covar_pop regr_slope regr_intercept regr_r2 regr_count "
    "regr_avgx regr_avgy skewness kurtosis bool_and bool_or every some any grouping grouping_id collect_list collect_set array_agg listagg string_agg "
    # windows
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value "
    # conditions and casts
    "coalesce nullif nvl nvl2 ifnull if iff isnull isnotnull isnan nanvl greatest least cast try_cast try_divide try_add try_subtract try_multiply "
    "double float int bigint string decimal date boolean timestamp to_number try_to_number "
    # mathematics
    "abs sign signum ceil ceiling floor round bround trunc mod pmod div power pow sqrt cbrt exp ln log log2 log10 log1p expm1 pi e sin cos tan degrees radians width_bucket "
    # text
    "upper lower ucase lcase initcap length len char_length character_length octet_length substr substring left right trim ltrim rtrim btrim lpad rpad replace translate "
    "concat concat_ws instr locate position contains startswith endswith like ilike rlike regexp regexp_like regexp_count regexp_extract regexp_replace regexp_substr "
    "split split_part reverse repeat ascii chr char format_number format_string "
    # dates
    "year quarter month day dayofmonth dayofweek dayofyear weekday weekofyear hour minute second extract date_part datepart date_add date_sub date_diff datediff add_months "
    "months_between last_day next_day date_trunc to_date to_timestamp make_date date_format".split()
)
# Names that the parser turns into calls without brackets, as they look once analysed.
OUTSIDE = {"CurrentUser", "CurrentDatabase", "CurrentCatalog", "CurrentTimestamp", "CurrentDate", "Now", "LocalTimestamp", "CurrentTime", "Rand", "Randn", "Uuid", "CallMethodViaReflection"}
# Statements that must be refused, and some that must pass.
CORPUS = [
    "SELECT sum(value) FROM sales",
    "SELECT count(*) FROM sales WHERE period = '1997'",
    "WITH a AS (SELECT entity, sum(value) AS v FROM sales GROUP BY entity) SELECT max(v) FROM a",
    "SELECT 1; DROP TABLE sales",
    "DROP TABLE sales",
    "INSERT INTO sales SELECT * FROM sales",
    "CREATE TABLE t AS SELECT * FROM sales",
    "SELECT * FROM parquet.`/etc/passwd`",
    "SELECT * FROM other",
    "SELECT secret FROM sales",
    "SELECT java_method('java.lang.System', 'exit', 1) FROM sales",
    "SELECT input_file_name() FROM sales",
    "SELECT user() FROM sales",
    "SELECT current_user FROM sales",
    "SELECT sum(value) FROM sales WHERE upper(section) = 'ASIA' AND year(make_date(CAST(period AS INT), 1, 1)) = 1997",
    "SELECT * FROM range(10)",
    "SET spark.sql.ansi.enabled = false",
    "SELECT sum(value FROM sales",
]


def scala_items(seq) -> list:  # noqa: ANN001
    out, it = [], seq.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def tree(node) -> list:  # noqa: ANN001
    """All logical nodes of a plan: children, bodies of WITH, and plans of subqueries."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        found.append(n)
        todo += scala_items(n.children())
        todo += [x for x in scala_items(n.innerChildren()) if hasattr(x, "children") and "plans.logical" in x.getClass().getName() or "analysis.Unresolved" in x.getClass().getName()]
        todo += scala_items(n.subqueries())
    return found


def _parse(spark: SparkSession, sql: str):  # noqa: ANN202
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _functions(node) -> set[str]:  # noqa: ANN001
    names = set()
    todo = scala_items(node.expressions())
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            names.add(scala_items(e.nameParts())[-1].lower())
        todo += scala_items(e.children())
    return names


def _kinds(node) -> set[str]:  # noqa: ANN001
    """The kinds of all expressions of a node."""
    kinds, todo = set(), scala_items(node.expressions())
    while todo:
        e = todo.pop()
        kinds.add(e.getClass().getSimpleName())
        todo += scala_items(e.children())
    return kinds


def problems(table: DataFrame, name: str, sql: str) -> list[str]:
    """Why the statement may not run; an empty list lets it run."""
    spark = table.sparkSession
    try:
        plan = _parse(spark, sql)
    except Exception as e:  # a parse error of any kind refuses the statement
        if not isinstance(e, ParseException) and "ParseException" not in str(e):
            raise
        return ["it is no single query"]
    out: set[str] = set()
    nodes = tree(plan)
    own = {name.lower()}
    for n in nodes:
        if n.getClass().getSimpleName() == "UnresolvedWith":
            own |= {scala_items_of_pair(x) for x in scala_items(n.cteRelations())}
    for n in nodes:
        kind = n.getClass().getSimpleName()
        if kind not in ALLOWED_NODES:
            out.add(f"{kind} is not allowed")
            continue
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in scala_items(n.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in own:
                out.add(f"unknown table {'.'.join(parts)}")
        out |= {f"function {f} is not allowed" for f in _functions(n) - ALLOWED_FUNCTIONS}
    if out:
        return sorted(out)
    try:
        analysed = _analysed(table, name, sql)._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        return [re.sub(r"\s+", " ", str(e)).split(". ")[0][:160]]
    kinds = {k for n in tree(analysed) for k in _kinds(n)}
    return sorted(f"{k} is not allowed" for k in kinds & OUTSIDE)


def scala_items_of_pair(pair) -> str:  # noqa: ANN001
    return str(pair.productElement(0)).lower()


def _analysed(table: DataFrame, name: str, sql: str) -> DataFrame:
    """The statement's DataFrame, analysed in a session of its own that sees the table under its name and no other.

    Statements that run at the same time cannot see each other's table.
    """
    spark = table.sparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, table._jdf.logicalPlan())
    dataset.createOrReplaceTempView(name)
    return own.sql(sql)


def gated(table: DataFrame, name: str, sql: str) -> DataFrame:
    """The result of a statement that passes the gate; ValueError otherwise."""
    if bad := problems(table, name, sql):
        raise ValueError("; ".join(bad))
    return _analysed(table, name, sql)
