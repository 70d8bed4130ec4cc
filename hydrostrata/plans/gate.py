"""Read-only SQL gateway: one statement, an allow-list of plan nodes, a row cap and a timeout.

The text is parsed, not run, and every node of the unresolved plan is checked, subquery expressions and
common table expressions included, before Spark sees it. What the plan does is allowed by name;
anything else is refused with :class:`RefusedSQL`. Errors of a permitted query are values.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes of a query. All others change something or run something.
ALLOWED = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedInlineTable", "OneRowRelation", "LocalRelation", "UnresolvedHaving",
    "With", "WithCTE", "CTERelationDef", "CTERelationRef", "UnionLoop", "UnionLoopRef", "WithWindowDefinition", "Window", "Pivot", "Unpivot", "Generate", "Sample", "UnresolvedTableValuedFunction", "Range",
    "UnresolvedOrderBy", "Aggregation", "GroupingSets", "UnresolvedHint", "ResolvedHint", "Expand",
}
#: Groups of built-in functions that compute from their arguments only; all other functions, users' own included, are refused.
ALLOWED_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs",
    "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "variant_funcs", "window_funcs",
}
ALLOWED_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
#: Leading words of statements that are no queries, where the parser has no node for them.
COMMANDS = re.compile(r"^\s*(pragma|attach|detach|vacuum|grant|revoke|call|begin|commit|declare|execute|copy|load|export|import)\b", re.I)
MAX_ROWS, TIMEOUT_S = 10_000, 10.0


class RefusedSQL(Exception):
    """The statement is not a permitted query."""


@dataclass
class QueryResult:
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    elapsed_s: float = 0.0
    error: str | None = None
    meta: dict = field(default_factory=dict)


def sequence(items: object) -> list:
    """A Scala sequence as a list."""
    return [items.apply(i) for i in range(items.size())]


@dataclass
class Parts:
    """What a statement is made of. ``tables`` leaves out names that a WITH clause defines where they are used."""

    nodes: list[str] = field(default_factory=list)
    functions: set[str] = field(default_factory=set)
    table_functions: set[str] = field(default_factory=set)
    tables: set[str] = field(default_factory=set)
    expressions: list = field(default_factory=list)


def _walk(node: object, plan_class: object, parts: Parts, scope: frozenset[str]) -> None:
    name = node.getClass().getSimpleName()
    parts.nodes.append(name)
    if name == "UnresolvedRelation":
        path = sequence(node.multipartIdentifier())
        if len(path) > 1 or path[0].lower() not in scope:
            parts.tables.add(".".join(path))
    if name == "UnresolvedTableValuedFunction":
        parts.table_functions.add(".".join(sequence(node.name())).lower())
    if name == "UnresolvedWith":
        for pair in sequence(node.cteRelations()):
            defined = pair.productElement(0).lower()
            # its own name stands for itself only where recursion is asked for, else for the table of that name
            _walk(pair.productElement(1), plan_class, parts, scope | {defined} if node.allowRecursion() else scope)
            scope = scope | {defined}
    for expression in sequence(node.expressions()):
        _walk_expression(expression, plan_class, parts, scope)
    for child in sequence(node.children()):
        _walk(child, plan_class, parts, scope)


def _walk_expression(e: object, plan_class: object, parts: Parts, scope: frozenset[str]) -> None:
    parts.expressions.append(e)
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        parts.functions.add(".".join(sequence(e.nameParts())).lower())
    if plan_class.isInstance(e):
        _walk(e.plan(), plan_class, parts, scope)
    for child in sequence(e.children()):
        _walk_expression(child, plan_class, parts, scope)


def inspect(spark: SparkSession, sql: str) -> Parts:
    """The parts of a statement that parses."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    parts = Parts()
    _walk(plan, spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression"), parts, frozenset())
    return parts


def parsed_expressions(spark: SparkSession, sql: str) -> list:
    """All expressions of a statement's unresolved plan, those of subqueries included."""
    return inspect(spark, sql).expressions


def _permitted(spark: SparkSession, function: str) -> bool:
    """Whether a function is a built-in of a permitted group."""
    bare = function.removeprefix("system.").removeprefix("builtin.")
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(bare)
    info = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    return "." not in bare and info.isDefined() and info.get().getGroup() in ALLOWED_GROUPS


def check(spark: SparkSession, sql: str, tables: set[str] | None = None) -> None:
    """Raise :class:`RefusedSQL` unless ``sql`` is one query over ``tables`` (any view when None)."""
    if COMMANDS.match(sql):
        raise RefusedSQL("not a query")
    if ";" in re.sub(r"'(?:[^']|'')*'", "", sql).rstrip().rstrip(";"):
        raise RefusedSQL("more than one statement")
    parts = inspect(spark, sql)
    if bad := [n for n in parts.nodes if n not in ALLOWED]:
        raise RefusedSQL(f"not permitted: {bad[0]}")
    if bad := sorted(f for f in parts.functions if not _permitted(spark, f)) + sorted(parts.table_functions - ALLOWED_TABLE_FUNCTIONS):
        raise RefusedSQL(f"function not permitted: {bad[0]}")
    files = {t for t in parts.tables if "/" in t or t.split(".")[0].lower() in ("parquet", "json", "csv", "orc", "text", "binaryfile", "avro", "delta")}
    allowed = None if tables is None else {t.lower() for t in tables}
    if bad := sorted(files) or ([] if allowed is None else sorted(t for t in parts.tables if t.lower() not in allowed)):
        raise RefusedSQL(f"table not permitted: {bad[0]}")


def execute(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S, tables: set[str] | None = None) -> QueryResult:
    """Run one permitted query. Refusals raise; syntax, analysis and run-time errors and timeouts are values."""
    started = time.perf_counter()
    took = lambda: time.perf_counter() - started
    try:
        check(spark, sql, tables)
    except PySparkException as e:
        return QueryResult(error=f"{type(e).__name__}: {e}", elapsed_s=took())
    group, context = f"gate-{uuid.uuid4()}", spark.sparkContext
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(timeout_s, stop)
    context.setJobGroup(group, "gate", interruptOnCancel=True)
    timer.start()
    try:
        df = spark.sql(sql)
        rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
        return QueryResult(df.columns, rows[:max_rows], len(rows) > max_rows, took())
    except Exception as e:
        return QueryResult(error=f"timeout after {timeout_s} s" if late.is_set() else f"{type(e).__name__}: {str(e)[:500]}", elapsed_s=took())
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def is_ordered(df: DataFrame) -> bool:
    """Whether the outermost result is ordered: a sort at the top, limits and projections aside."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit", "Project", "SubqueryAlias", "Offset"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "Sort"


def problem(result: QueryResult) -> str | None:
    """Why a result calls for another attempt: an error, no row, or one row of nulls only."""
    if result.error:
        return result.error
    if not result.rows:
        return "no rows"
    return "only nulls" if len(result.rows) == 1 and all(v is None for v in result.rows[0]) else None


def repaired(spark: SparkSession, sql: str, propose, attempts: int = 2, **limits: object) -> tuple[QueryResult, list[str]]:
    """Run ``sql``; while there is a problem let ``propose(sql, problem)`` give another, until one repeats."""
    tried = [sql]
    result = execute(spark, sql, **limits)
    while (why := problem(result)) and len(tried) <= attempts:
        another = propose(tried[-1], why)
        if not another or another in tried:
            break
        tried.append(another)
        try:
            result = execute(spark, another, **limits)
        except RefusedSQL as e:
            result = QueryResult(error=f"refused: {e}")
    return result, tried
