"""Read-only SQL for analysts: the query is parsed by Spark, and only what the parsed plan shows decides.

Allowed are plans made of query operators over the given frames, with functions of the query groups of Spark's own
function registry. Commands, other relations (tables, files, streams) and functions outside those groups are refused.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Plan nodes that only compute on their children.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation OneRowRelation Sort GlobalLimit LocalLimit Offset "
    "Distinct Union Except Intersect UnresolvedWith UnresolvedHaving WithWindowDefinition Generate Pivot Unpivot LateralJoin Sample ParameterizedQuery".split()
)
#: Groups of built-in functions that compute on their arguments alone.
FUNCTION_GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs "
    "lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs window_funcs xml_funcs".split()
)


class UnsafeSql(ValueError):
    pass


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Reader:
    """Walks a parsed plan and raises ``UnsafeSql`` at the first thing that is not a plain read."""

    def __init__(self, spark: SparkSession, frames: set[str]):
        self.registry = spark._jsparkSession.sessionState().functionRegistry()
        self.names = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.frames = frames

    def plan(self, node, known: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = list(_each(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.frames | known:
                raise UnsafeSql(f"unknown relation {'.'.join(parts)}")
            return
        if kind not in QUERY_NODES:
            raise UnsafeSql(f"{node.nodeName()} is not a plain read")
        if kind == "UnresolvedWith":
            for cte in _each(node.cteRelations()):
                own = frozenset({cte._1().lower()})
                self.plan(cte._2(), known | own if node.allowRecursion() else known)
                known = known | own
        if kind == "Generate":
            self.expression(node.generator(), known)
        for e in _each(node.expressions()):
            self.expression(e, known)
        for child in _each(node.children()):
            self.plan(child, known)

    def expression(self, e, known: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = ".".join(_each(e.nameParts())) if kind == "UnresolvedFunction" else e.name().unquotedString()
            info = self.registry.lookupFunction(self.names(name.lower()))
            if info.isEmpty() or info.get().getGroup() not in FUNCTION_GROUPS:
                raise UnsafeSql(f"function {name} is not allowed")
        if "Subquery" in kind or kind in ("Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            if hasattr(e, "plan") and kind != "InSubquery":
                self.plan(e.plan(), known)
        for child in _each(e.children()):
            self.expression(child, known)


def check_sql(spark: SparkSession, text: str, frames: set[str] = frozenset()) -> None:
    """Raise ``UnsafeSql`` unless ``text`` is one query over the named frames."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JJavaError) as err:
        raise UnsafeSql("not a single SQL statement") from err
    _Reader(spark, {f.lower() for f in frames}).plan(plan, frozenset())


def safe_sql(spark: SparkSession, text: str, max_rows: int | None = None, **frames: DataFrame) -> DataFrame:
    """The result of a checked query over named frames (``{name}``) and whether rows were left out, in ``truncated``.

    With ``max_rows`` at most that many rows come back; without it all do.
    """
    named = re.compile("|".join(r"\{%s\}" % re.escape(name) for name in frames) or r"(?!)")
    check_sql(spark, named.sub(lambda m: f"`{m[0][1:-1]}`", text), set(frames))
    # braces that name no frame are text
    out = spark.sql("".join(part.replace("{", "{{").replace("}", "}}") if i % 2 == 0 else part for i, part in enumerate(re.split(f"({named.pattern})", text))), **frames)
    if max_rows is None:
        return out.withColumn("truncated", F.lit(False))
    mark, head = f"__row_{uuid.uuid4().hex}", out.limit(max_rows + 1)
    every = W.partitionBy()  # max_rows + 1 rows at most
    numbered = head.withColumn("truncated", F.count(F.lit(1)).over(every) > max_rows).withColumn(mark, F.row_number().over(every.orderBy(F.lit(0))))
    return numbered.filter(F.col(mark) <= max_rows).drop(mark)
