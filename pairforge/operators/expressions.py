"""Users' SQL expressions, checked before they run.

An expression may compute with the columns of its row and nothing else. Refused are calls
into the JVM, subqueries, and functions whose value is not settled by the row (random
numbers, row ids, user-defined functions marked so): rows would change between two
readings, and a retried task would give others than the first one did.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which Spark calls Java methods by reflection.
REFLECTION = {"reflect", "java_method", "try_reflect"}
PLANS = {"ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


def _nodes(expression) -> Iterator:
    """An expression of Catalyst and everything below it."""
    waiting = [expression]
    while waiting:
        node = waiting.pop()
        yield node
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]


def _called(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        parts = node.nameParts()
        return parts.apply(parts.size() - 1).lower()
    return node.prettyName().lower()


def _refuse(name: str, why: str) -> None:
    raise ValueError(f"{name} is not allowed in an expression: {why}")


def checked(df: DataFrame, expression: str) -> Column:
    """The expression as a column of ``df``; raises ``ValueError`` with the name of what is refused."""
    spark = df.sparkSession
    parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)
    for node in _nodes(parsed):
        if node.getClass().getSimpleName() in PLANS:
            _refuse("a subquery", "it reads other tables")
        if node.getClass().getSimpleName().endswith("WindowExpression"):
            _refuse(expression, "it is no expression on one row")
        if _called(node) in REFLECTION:
            _refuse(_called(node), "it calls a method of the JVM")
    column = F.expr(expression)
    # What names stand for is only known once they are resolved against the columns.
    resolved = df.select(column)._jdf.queryExecution().analyzed()
    expressions = resolved.expressions()
    for i in range(expressions.size()):
        for node in _nodes(expressions.apply(i)):
            if node.getClass().getSimpleName() == "CallMethodViaReflection":
                _refuse("reflection", "it calls a method of the JVM")
            children = node.children()
            own = all(children.apply(j).deterministic() for j in range(children.size()))
            if own and not node.deterministic():
                _refuse(_called(node), "its value is not settled by the row")
    # A generator makes rows, an aggregate or window looks at several.
    below = resolved.children().apply(0) if resolved.getClass().getSimpleName() == "Project" else None
    if below is None or not below.sameResult(df._jdf.queryExecution().analyzed()):
        _refuse(expression, "it is no expression on one row")
    return column
