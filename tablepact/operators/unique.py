"""Uniqueness of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of ``copies``.

    A key with a null part equals no other key, as in SQL. Counting combines
    before the shuffle, so a key that holds most rows costs one row per task.
    """
    names = ["`" + key.replace("`", "``") + "`" for key in keys]
    rows = df.select(*names).dropna(how="any")
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
