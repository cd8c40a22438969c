"""What filters remove under every order in which they could be applied.

A document's failures are a mask, one bit per filter. Under an order of the filters it is
removed at the step of the first filter of its mask. All orders in lexicographic sequence
have their Lehmer rank; the orders that begin with the same ``s`` filters are one
interval of ranks. So a mask is removed at step ``s`` exactly in the intervals whose
prefix is ``s - 1`` filters outside of the mask and then one of it. Documents are counted
by part and mask once; each count is added at the begin of its intervals and taken off at
their ends; a running sum over the ranks gives what every step of every order removes.
No order is ever applied to documents.

The filters here are A (few words), B (few distinct words), C (many capitals), D (odd
signs) and E (a text that a smaller ``doc_id`` has too). E is settled by counts per
digest, part and label, so a text that a third of all documents share is a row per task.

Edge cases: a null text is empty, a null part an empty text. A null ``doc_id`` is neither
smaller nor larger than others, so it never fails E, nor makes others fail, and it has no
labels. Of rows that share text and the least ``doc_id`` none fails E. A document is good
if any of its labels says so, likewise toxic. An empty table gives no rows. Columns that
are not asked for may have any name.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import materialized, text_of, words_of

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def orders(filters: str = FILTERS) -> list[str]:
    """All orders by their Lehmer rank."""
    return ["".join(p) for p in permutations(sorted(filters))]


def intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first rank, rank after the last)``: where a mask is removed at a step.

    A prefix's first rank is the number that its Lehmer digits make: each filter's place
    among those not yet used, in factorial base. Intervals that touch are one.
    """
    size, found = len(filters), []

    def walk(prefix: list[int], first: int) -> None:
        rest = [f for f in range(size) if f not in prefix]
        width = factorial(len(rest) - 1)
        for digit, last in enumerate(rest):
            begin = first + digit * width
            used = sum(1 << f for f in prefix)
            for mask in range(1, 2**size):
                if mask >> last & 1 and not mask & used:
                    found.append((mask, len(prefix) + 1, begin, begin + width))
            if len(rest) > 1:
                walk([*prefix, last], begin)

    walk([], 0)
    joined: list[tuple[int, int, int, int]] = []
    for mask, step, begin, end in sorted(found):
        if joined and joined[-1][:2] == (mask, step) and joined[-1][3] == begin:
            joined[-1] = (mask, step, joined[-1][2], end)
        else:
            joined.append((mask, step, begin, end))
    return joined


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A is 1, B 2, C 4, D 8."""
    words = words_of(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang",
          good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good and toxic ones, by part and failures."""
    body = text_of(text)
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(body).cast("int").alias("mask"),
        F.unhex(F.sha2(body, 256)).alias("digest"))
    # Documents without an id have no label; each is dealt by itself, not all to one task.
    dealt = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("id"))
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(
        F.coalesce(F.bool_or(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col(toxic) == 1), F.lit(False)).alias("toxic"))
    rows = rows.withColumn("deal", dealt).join(
        marked.withColumn("deal_", F.xxhash64("of")), (F.col("deal") == F.col("deal_")) & (F.col("id") == F.col("of")), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    # The first grouping keeps the dealing of the join; repeated rows become a count.
    single = rows.groupBy("deal", "id", "digest", "part", "mask", *flags).agg(F.count(F.lit(1)).alias("n"))
    copies = single.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    # By now a digest has a row per part and label only.
    least = F.min("least").over(Window.partitionBy("digest"))
    first = copies.withColumn("first", F.when(F.col("least") == least, F.col("n_least")).otherwise(0) + F.col("n_null"))
    either = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), F.col("first").alias("c")),
        F.struct((F.col("mask") + 2 ** FILTERS.index("E")).alias("m"), (F.col("n") - F.col("first")).alias("c"))))
    split = first.select("part", "good", "toxic", either.alias("s")).select("part", "good", "toxic", "s.*")
    return split.groupBy("part", F.col("m").alias("mask")).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("good"), F.col("c")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c")).otherwise(0)).alias("toxic"))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step, from counts by part and mask.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``.
    """
    spark, size = counted.sparkSession, len(filters)
    every = orders(filters)
    counted = materialized(counted, "filter-masks")
    parts = counted.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)).alias(f"fails{k}") for k in range(size)],
        *[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)).alias(f"only{k}") for k in range(size)])
    covers = spark.createDataFrame(intervals(filters), "mask int, step int, begin int, after int")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign"))))
    changes = (
        counted.join(covers, "mask").select("part", "step", *COUNTS, ends.alias("e"))
        .groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in COUNTS])
    )
    # Every part has a row for each rank and step, be it of zeros.
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(every) * size - 1)), lambda i: F.struct(
        (i / size).cast("int").alias("rank"), (i % size + 1).cast("int").alias("step"))))
    zeros = parts.select("part", grid.alias("g")).select("part", "g.step", "g.rank", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS])
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        zeros.union(changes.where(F.col("rank") < len(every)).select("part", "step", "rank", *COUNTS))
        .groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
        .select("part", "step", "rank", *[F.sum(c).over(by_rank).alias(c) for c in COUNTS])
    )
    named = F.get(F.array(*map(F.lit, every)), F.col("rank"))
    own = F.instr(F.lit("".join(sorted(filters))), F.substr(named, F.col("step"), F.lit(1)))
    steps = steps.withColumns({"filter_order": named, "own": own})
    by_order = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("gone", F.sum("n").over(by_order)).withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "own")))
    of_own = lambda name: F.get(F.array(*[F.col(f"{name}{k}") for k in range(size)]), F.col("own") - 1)
    return steps.join(parts, "part").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
        (of_own("fails") - F.col("n")).alias("redundant"), of_own("only").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
