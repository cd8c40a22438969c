"""Conform: hold a dataframe to the declared columns.

Names and types are settled on the driver from the schema alone, before any job
starts. Values are settled by the checks of ``Checked``.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.contract import EXTRA_COLUMN_POLICIES, Column
from tablepact.errors import ConformError, PactError
from tablepact.functions.casts import strict_cast
from tablepact.operators.checks import Checked, Converted

logger = logging.getLogger("tablepact.conform")


def check_names(
    names: Sequence[str], columns: Sequence[Column], extra_columns: str = "raise"
) -> None:
    """Hold names to the declared ones, as multisets; the first kind of difference is raised."""
    if extra_columns not in EXTRA_COLUMN_POLICIES:
        raise ValueError(f"no such extra_columns: {extra_columns!r}; known are {EXTRA_COLUMN_POLICIES}")
    given, declared = Counter(names), Counter(c.name for c in columns)
    differences = {
        "names given more than once": given - Counter(set(given)),
        "names not declared": given - declared,
        "declared names not given": declared - given,
    }
    if extra_columns == "warn" and not differences["names given more than once"]:
        unused = differences.pop("names not declared")
        if unused:
            logger.warning("columns left out, as they are not declared: %s", sorted(unused))
    for what, found in differences.items():
        if found:
            raise ConformError(f"{what}: {sorted(found)} (declared are {list(declared)})")


def plan_conform(
    df: DataFrame,
    columns: Sequence[Column],
    extra_columns: str = "raise",
    error: type[PactError] = ConformError,
) -> Checked:
    """Settle names and types; return the frame whose values remain to be checked."""
    check_names(df.columns, columns, extra_columns)
    fields = {field.name: field for field in df.schema.fields}
    positions = {name: f"__pact_input_{i}" for i, name in enumerate(df.columns)}
    source = df
    if len({name.lower() for name in positions}) < len(positions):
        # Names that differ only in case cannot be told apart by reference.
        renamed = df.toDF(*positions.values())
        source = renamed.select(*[F.col(positions[c.name]).alias(c.name) for c in columns])
    converted = {}
    for column in columns:
        given = source["`" + column.name.replace("`", "``") + "`"]
        value, can_fail = strict_cast(
            given, fields[column.name].dataType, column.sql_type, column.name
        )
        converted[column.name] = Converted(value, can_fail, given)
    return Checked(source, columns, converted, error, value_error=error)


def conform(
    df: DataFrame, columns: Sequence[Column], extra_columns: str = "raise"
) -> DataFrame:
    """The declared table as a lazy frame; the first bad row met fails its job."""
    return plan_conform(df, columns, extra_columns).strict()


def conform_verified(
    df: DataFrame, columns: Sequence[Column], extra_columns: str = "raise"
) -> DataFrame:
    """As ``conform``, but all values are checked now, in one pass, so that the
    error names the first rule broken by any row."""
    plan = plan_conform(df, columns, extra_columns)
    plan.verify()
    return plan.strict()


def violation_report(
    df: DataFrame, columns: Sequence[Column], extra_columns: str = "raise"
) -> DataFrame:
    """Every rule on every column with the number of values that break it."""
    return plan_conform(df, columns, extra_columns).report()


def quarantine(
    df: DataFrame, columns: Sequence[Column], extra_columns: str = "raise", folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows that conform, typed, and those that do not, as given, with reasons.

    The rows are judged in one pass over ``df`` and written by outcome to ``folder``, a new
    one of the shared scratch folder if it is left out; both results are read from it.
    """
    return plan_conform(df, columns, extra_columns).split(folder)
