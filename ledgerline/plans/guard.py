"""Read-only SQL: statements are judged by the plan that Spark analyses, not by their text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException, ParseException

#: Plan nodes and functions that a query may use, and its caps.
NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Window Union Distinct SubqueryAlias View LogicalRelation LogicalRDD LocalRelation "
    "WithCTE CTERelationDef CTERelationRef UnresolvedWith OneRowRelation Offset HiveTableRelation RelationV2 DataSourceV2Relation Range".split()
)
FUNCTIONS = frozenset("cast count rank row_number lag dense_rank abs round coalesce nullif".split())
HARD_CAP, MAX_LIMIT = 1000, 50


class UnsafeQuery(ValueError):
    """The statement isn't a bounded read of allowed relations."""


def _each(seq):
    return (seq.apply(k) for k in range(seq.length()))


def _walk(plan):
    yield plan
    for child in (*_each(plan.children()), *_each(plan.innerChildren())):
        if hasattr(child, "innerChildren"):
            yield from _walk(child)


def _expressions(node):
    open_ = list(_each(node.expressions()))
    while open_:
        e = open_.pop()
        yield e
        open_ += list(_each(e.children()))


def _relations(plan, ctes: frozenset[str]):
    """Whole names of the relations that aren't common table expressions where they stand. Of those, each sees only the ones
    before it."""
    if plan.nodeName() == "UnresolvedWith":
        for named in _each(plan.cteRelations()):
            yield from _relations(named._2(), ctes)
            ctes = ctes | {named._1().lower()}
    elif plan.nodeName() == "UnresolvedRelation":
        parts = list(_each(plan.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in ctes:
            yield parts
    for child in (*_each(plan.children()), *_each(plan.innerChildren())):
        if hasattr(child, "innerChildren") and not (plan.nodeName() == "UnresolvedWith" and child.nodeName() == "SubqueryAlias"):
            yield from _relations(child, ctes)


def _names(parsed) -> set[str]:
    """The names of all functions called, with their qualifiers."""
    found = (e for node in _walk(parsed) for e in _expressions(node) if e.getClass().getSimpleName() == "UnresolvedFunction")
    return {".".join(_each(e.nameParts())).lower() for e in found}


def years_missing(df: DataFrame, column: str = "report_year") -> list[str]:
    """Tables of the analysed plan with that column which no filter on it stands above: the static check of generated SQL
    asks for a year on each fact table."""

    def visit(node, filtered: bool):
        if node.nodeName().startswith("Filter"):
            filtered = filtered or any(e.nodeName() == "AttributeReference" and e.name() == column for e in _expressions(node))
        if node.nodeName() == "SubqueryAlias":
            child = node.child()
            if not list(_each(child.children())) or child.nodeName().startswith("View"):
                names = [a.name() for a in _each(node.output())]
                if column in names and not filtered:
                    yield node.alias()
                return
        for child in _each(node.children()):
            yield from visit(child, filtered)

    return sorted(set(visit(df._jdf.queryExecution().analyzed(), False)))


def review(spark: SparkSession, sql: str, tables: frozenset[str] | set[str], functions: frozenset[str] = FUNCTIONS, need_limit: bool = True) -> DataFrame:
    """The statement's lazy DataFrame if it only reads the named views, by allowed operators and functions, orders no more
    rows than a limit keeps, and selects named columns; else UnsafeQuery."""
    if ";" in sql.strip().rstrip(";"):
        raise UnsafeQuery("one statement at a time")
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise UnsafeQuery("only SELECT or WITH")
    if re.search(r"(?<![\w)])\*|,\s*\*|\.\*", re.sub(r"'[^']*'", "''", sql).replace("count(*)", "")):
        raise UnsafeQuery("columns must be named")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        views = spark._jsparkSession.sessionState().catalog()
        for parts in _relations(parsed, frozenset()):
            # a whole name must be allowed, and one without a schema must be a temporary view, not whatever the schema holds
            if ".".join(parts) not in tables or (len(parts) == 1 and not views.getRawTempView(parts[0]).isDefined()):
                raise UnsafeQuery(f"relation {'.'.join(parts)} isn't allowed")
        for name in sorted(_names(parsed) - functions):
            raise UnsafeQuery(f"function {name} isn't allowed")
        df = spark.sql(sql)
    except ParseException as e:
        raise UnsafeQuery(f"not parsed: {e.getCondition()}") from e
    except AnalysisException as e:
        raise UnsafeQuery(f"not resolved: {e.getCondition()}") from e
    limits = []
    for node in _walk(df._jdf.queryExecution().analyzed()):
        name = node.nodeName().split(" ")[0]
        if name == "GlobalLimit":
            limits.append(node.maxRows())
        if name not in NODES and not name.startswith(("Subquery", "Relation", "LogicalRelation")):
            raise UnsafeQuery(f"operator {name} isn't allowed")
    rows = df._jdf.queryExecution().analyzed().maxRows()
    if need_limit and (rows.isEmpty() or rows.get() > MAX_LIMIT):
        raise UnsafeQuery(f"a limit of {MAX_LIMIT} rows at most is needed")
    return df


def read_only(spark: SparkSession, sql: str, tables: set[str], limit: int = 200, timeout_s: float | None = None) -> tuple[list[str], list[tuple]]:
    """Columns and at most limit rows, in a job group that is cancelled after timeout_s."""
    import threading
    import uuid

    df = review(spark, sql, tables, need_limit=False).limit(min(limit, HARD_CAP))
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, "read-only query", interruptOnCancel=True)
    timer = threading.Timer(timeout_s, sc.cancelJobGroup, (group,)) if timeout_s else None
    try:
        if timer:
            timer.start()
        return df.columns, [tuple(r) for r in df.collect()]  # bounded by HARD_CAP
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def dry_run(spark: SparkSession, sql: str, tables: set[str], rows: int = 5) -> tuple[list[str], list[tuple]]:
    """What the statement's first few rows look like, read under the same review as a real run."""
    return read_only(spark, sql, tables, limit=rows, timeout_s=10)


def explain(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
