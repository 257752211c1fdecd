"""What a statement would do, read from its parsed plan before anything of it is analysed or run."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
#: Plan nodes that only read and compute. Every other node (commands, writes, scripts, names that
#: are computed) is refused.
READING = frozenset("""
    Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate
    GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project
    Repartition RebalancePartitions RepartitionByExpression Sample Sort SubqueryAlias Tail Union
    UnresolvedDataFrame UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window
    WithWindowDefinition""".split())
#: Table functions that make rows from their arguments alone.
MAKING = frozenset("""
    range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple
    """.split())
#: Functions that call into the machine, and expressions whose name is computed.
OUTSIDE = frozenset(["reflect", "try_reflect", "java_method"])
COMPUTED = frozenset(["ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier",
                      "UnresolvedIdentifier"])


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    walk = seq.iterator()
    while walk.hasNext():
        yield walk.next()


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _registered(spark: SparkSession, parts: list[str]) -> bool:
    try:
        return spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts))
    except PySparkException:
        return False


def refusal(spark: SparkSession, text: str) -> str | None:
    """Why a statement is not a plain query of registered tables, None if it is one.

    Every plan node must be one that reads; relations of several parts (a path behind a format is
    one) must exist in the catalog; functions that call into Java are refused wherever they stand,
    in subqueries and common table expressions too. A statement that does not parse gives the
    parser's message. A relation of one part that does not exist is left to the analysis.
    """
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except PySparkException as failure:
        return str(failure)
    gateway = spark.sparkContext._gateway
    waiting = [root]
    while waiting:
        node = waiting.pop()
        kind = _kind(node)
        if kind in COMPUTED:
            return "Forbidden SQL operation: computed name"
        waiting.extend(_items(node.children()))
        if is_instance_of(gateway, node, _PLAN):
            if kind not in READING:
                return f"Forbidden SQL operation: {kind}"
            if kind == "UnresolvedRelation":
                parts = list(_items(node.multipartIdentifier()))
                if len(parts) > 1 and not _registered(spark, parts):
                    return f"Forbidden SQL operation: unregistered relation {'.'.join(parts)}"
            if kind == "UnresolvedTableValuedFunction":
                name = ".".join(_items(node.name())).lower()
                if name not in MAKING:
                    return f"Forbidden SQL operation: table function {name}"
            waiting.extend(_items(node.innerChildren()))
            waiting.extend(_items(node.expressions()))
        else:
            if kind == "UnresolvedFunction":
                name = list(_items(node.nameParts()))[-1].lower()
                if name in OUTSIDE:
                    return f"Forbidden SQL operation: function {name}"
            if is_instance_of(gateway, node, _SUBQUERY):
                waiting.append(node.plan())
    return None
