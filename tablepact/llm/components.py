"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import materialized


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge ``(a, b)``; the root is its component's least node.

    Alternating star contraction: every node's larger neighbours, then its smaller
    ones, are linked to its least neighbour, until only stars are left. Each round is
    two aggregations and joins on long keys and goes to work tables; no node's
    neighbours are ever gathered, and a hub's rows of a join can be split over tasks.
    """
    a, b = F.col("a"), F.col("b")
    rows = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    rows = materialized(rows, "components")
    before = None
    while True:
        both = rows.union(rows.select("b", "a"))
        # Joined from a work table, not from the aggregation: only then may Spark split a hub's partition of the join.
        least = materialized(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components")
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = materialized(large, "components")
        least = materialized(large.groupBy("a").agg(F.min("b").alias("m")), "components")
        small = large.join(least, "a")
        rows = materialized(
            small.select(b.alias("a"), F.col("m").alias("b")).where(a != b)
            .union(least.select("a", F.col("m").alias("b"))).distinct(),
            "components",
        )
        mark = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return rows.select(a.alias("node"), b.alias("root")).union(rows.select(b.alias("node"), b.alias("root")).distinct())
        before = mark
