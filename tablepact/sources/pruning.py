"""Partition bounds of a declared read, inferred from its own conditions.

A table partitioned by a derived value (``day(ts)``) holds that value in a column of its
version, which a query over the table's name cannot state. The optimizer moves the
query's conditions down to each scan; a condition on ``ts`` there implies one on
``day(ts)``, as the derived values never fall while the column rises: ``ts < x`` gives
``day(ts) <= day(x)``, and likewise for ``=``, ``<=``, ``>``, ``>=``, ``between``, ``in``
and comparisons of ``cast(ts as date)``. Buckets follow from ``=`` and ``in``. An ``or``
implies what either side does, if both imply something.

The implied condition is put above the scan in the analyzed plan. It holds for every row
that the query keeps, so the rows are the same; the scan lists and reads fewer
partitions. A scan that is met more than once in the plan, or that a subquery expression
holds, stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.operators.layout import Partition
from tablepact.sqltypes import parse_type

# How versions and derived partition columns are named.
VERSION_NAME = re.compile(r"(.+)__v_(?:([0-9]{13})_)?[0-9a-f]{16,32}")
_DERIVED = re.compile(r"pact_(year|month|day|hour|identity|truncate|bucket)(?:_([0-9]+))?_(.+)")
# What is implied where the column stands on the left, and where it stands on the right.
_OPERATORS = {"EqualTo": ("=", "="), "EqualNullSafe": ("=", "="), "LessThan": ("<=", ">="), "LessThanOrEqual": ("<=", ">="),
              "GreaterThan": (">=", "<="), "GreaterThanOrEqual": (">=", "<=")}


def with_partition_bounds(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The same rows, where scans of versions carry the partition bounds their conditions imply."""
    execution = frame._jdf.queryExecution()
    analyzed = execution.analyzed()
    versions = [scan for scan in _nodes(analyzed) if _kind(scan) == "LogicalRelation" and _derived(scan)]
    if not versions:
        return frame
    optimized = list(_nodes(execution.optimizedPlan()))
    shared = _ids_below_shared_tables(analyzed)
    bounds = {}
    for scan in versions:
        own = _first_id(scan)
        places = [n for n in optimized if _kind(n) == "LogicalRelation" and _first_id(n) == own]
        filters = [n for n in optimized if _kind(n) == "Filter" and _kind(n.child()) == "LogicalRelation" and _first_id(n.child()) == own]
        if len(places) == len(filters) == 1 and own not in shared:
            implied = list(_implied(scan, filters[0].condition()))
            if implied:
                bounds[own] = reduce(lambda a, b: a & b, implied)
    if not bounds or max(Counter(map(_first_id, versions)).values()) > 1:
        return frame

    def rebuilt(node: Any) -> Any:
        if _kind(node) == "LogicalRelation" and _first_id(node) in bounds:
            identifier = node.catalogTable().get().identifier()
            name = f"`{identifier.database().get()}`.`{identifier.table()}`"
            above = spark.table(name).where(bounds[_first_id(node)])._jdf.queryExecution().logical()
            return above.withNewChildren(_sequence(spark, [node]))
        old = _items(node.children())
        new = [rebuilt(child) for child in old]
        return node if all(a is b for a, b in zip(old, new)) else node.withNewChildren(_sequence(spark, new))

    plans = spark._jvm.org.apache.spark.sql.classic.Dataset
    return type(frame)(plans.ofRows(spark._jsparkSession, rebuilt(analyzed)), spark)


def _derived(scan: Any) -> list[Partition]:
    """The derived partitions of a version's scan."""
    table = scan.catalogTable()
    if table.isEmpty() or not VERSION_NAME.fullmatch(table.get().identifier().table()):
        return []
    kinds = {a.name(): a.dataType().catalogString() for a in _items(scan.output())}
    found = []
    for name in _items(table.get().partitionColumnNames()):
        parsed = _DERIVED.fullmatch(name)
        if parsed and parsed[3] in kinds:
            text = parse_type("TEXT" if kinds[parsed[3]] == "string" else "BIGINT")
            found.append(Partition(parsed[1], parsed[3], int(parsed[2]) if parsed[2] else None, text))
    return found


def _implied(scan: Any, condition: Any) -> Iterator[Expr]:
    names = {a.exprId().id(): a.name() for a in _items(scan.output())}
    for partition in _derived(scan):
        bound = _bound_of(partition, condition, names)
        if bound is not None:
            yield bound


def _bound_of(partition: Partition, condition: Any, names: dict[int, str]) -> Expr | None:
    """What a condition implies for a partition, if anything; an ``or`` does if both of its sides do."""
    kind = _kind(condition)
    if kind in ("And", "Or"):
        left, right = (_bound_of(partition, side, names) for side in (condition.left(), condition.right()))
        if left is not None and right is not None:
            return left & right if kind == "And" else left | right
        return (right if left is None else left) if kind == "And" else None
    how, operator, values = _comparison(condition, names, partition.column)
    coarse = how == "date" and partition.transform not in ("day", "month", "year")
    if not how or coarse or (operator not in ("=", "in") and partition.transform == "bucket"):
        return None
    return partition.can_hold(operator, values)


def _comparison(condition: Any, names: dict[int, str], column: str) -> tuple[str, str, Expr | None]:
    """How a column is compared, ``""`` if it is not, as it is or as a date; operator, value or array of values."""
    kind = _kind(condition)
    if kind in _OPERATORS:
        left, right, operator = condition.left(), condition.right(), _OPERATORS[kind][0]
        if _kind(left) == "Literal":
            left, right, operator = right, left, _OPERATORS[kind][1]
        how = _compared_as(left, names, column)
        if how and _kind(right) == "Literal" and right.value() is not None and _type(left) == _type(right):
            return how, operator, F.expr(right.sql()).cast(_type(left))
    elif kind in ("In", "InSet"):
        value = condition.value() if kind == "In" else condition.child()
        how = _compared_as(value, names, column)
        if how and (kind == "InSet" or all(_kind(x) == "Literal" and _type(x) == _type(value) for x in _items(condition.list()))):
            listed = condition.sql()[len(f"({value.sql()} IN "):-1]
            return how, "in", F.expr(f"array{listed}").cast(f"array<{_type(value)}>")
    return "", "", None


def _compared_as(side: Any, names: dict[int, str], column: str) -> str:
    if _kind(side) == "AttributeReference":
        return "value" if names.get(side.exprId().id()) == column else ""
    if _kind(side) == "Cast" and _type(side) == "date":
        return "date" if _compared_as(side.child(), names, column) and _type(side.child()) == "timestamp_ntz" else ""
    return ""


def _ids_below_shared_tables(plan: Any) -> set[int]:
    """Scans in common table expressions that are used more than once."""
    uses = Counter(re.findall(r'"class":"[\w.]*CTERelationRef"[^}]*?"cteId":(\d+)', plan.toJSON()))
    found = set()
    for node in _nodes(plan):
        if _kind(node) == "CTERelationDef" and uses[str(node.id())] != 1:
            found.update(_first_id(n) for n in _nodes(node) if _kind(n) == "LogicalRelation")
    return found


def _nodes(plan: Any) -> Iterator[Any]:
    yield plan
    for child in _items(plan.children()):
        yield from _nodes(child)


def _items(sequence: Any) -> list[Any]:
    return [sequence.apply(i) for i in range(sequence.size())]


def _sequence(spark: SparkSession, items: list[Any]) -> Any:
    return spark._jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def _type(expression: Any) -> str:
    return expression.dataType().catalogString()


def _first_id(scan: Any) -> int:
    return scan.output().apply(0).exprId().id()
