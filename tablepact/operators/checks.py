"""Value checks of a table, gathered so that one pass settles all of them.

A ``Checked`` frame carries the converted columns next to one flag per check. The
same flags serve four purposes: a report, good and bad rows written apart, a lazy
frame that fails at the first bad row, and metrics observed while a table is
being written.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import Column, struct_of
from tablepact.errors import ConformError, PactError
from tablepact.session import scratch_dir

_VALUE = "__pact_value_"
_FAILED = "__pact_failed_"
_GIVEN = "__pact_given_"
_HERE = "__pact_here"

REPORT_SCHEMA = "column_name string, rule string, violations bigint, max_length int"


@dataclass(frozen=True)
class Check:
    """One rule on one column, as a flag over the checked frame."""

    column: str
    rule: str
    flag: Expr
    error: type[PactError]
    text: str
    length: Expr | None = None

    def failure(self, count: int, longest: int | None) -> PactError:
        return self.error(self.text.format(count=count, longest=longest))


@dataclass(frozen=True)
class Converted:
    """How one declared column is obtained from the source."""

    value: Expr
    can_fail: bool
    given: Expr


class Checked:
    """Source rows with converted columns and the checks on them."""

    def __init__(
        self,
        source: DataFrame,
        columns: Sequence[Column],
        converted: Mapping[str, Converted],
        cast_error: type[PactError] = ConformError,
        cast_text: str = "column {name}: {{count}} value(s) do not convert to {type} without loss",
        record_checks: Sequence[Check] = (),
        value_error: type[PactError] = ConformError,
    ) -> None:
        self.source = source
        self.columns = tuple(columns)
        projected, flags, casts, values = [], [], [], []
        for i, column in enumerate(self.columns):
            how = converted[column.name]
            projected.append(how.value.alias(f"{_VALUE}{i}"))
            value, failed = F.col(f"{_VALUE}{i}"), F.lit(False)
            if how.can_fail:
                projected.append(how.given.isNotNull().alias(f"{_GIVEN}{i}"))
                flags.append((F.col(f"{_GIVEN}{i}") & value.isNull()).alias(f"{_FAILED}{i}"))
                failed = F.col(f"{_FAILED}{i}")
                text = cast_text.format(name=_braced(column.name), type=column.type)
                casts.append(Check(column.name, "cast", failed, cast_error, text))
            values.extend(_value_checks(
                column, value, failed if how.can_fail else None, value_error
            ))
        self.checks = [*record_checks, *casts, *values]
        # A filter is not moved below a projection with a partition id, so a flag
        # used in one reads the column computed here and does not compute it anew.
        here = F.spark_partition_id().alias(_HERE)
        self._frame = source.select("*", *projected).select("*", *flags, here)

    def outputs(self) -> list[Expr]:
        """The declared columns, in declared order."""
        return [
            F.col(f"{_VALUE}{i}").alias(c.name, metadata={"sql_type": c.type})
            for i, c in enumerate(self.columns)
        ]

    def report(self) -> DataFrame:
        """One row per check: how many values break it, and the longest text."""
        if not self.checks:
            return self.source.sparkSession.createDataFrame([], REPORT_SCHEMA)
        totals = self._frame.agg(*metrics(self.checks))
        rows = F.array(*[
            F.struct(
                F.lit(check.column).alias("column_name"),
                F.lit(check.rule).alias("rule"),
                F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("violations"),
                (F.col(f"m{i}") if check.length is not None else F.lit(None))
                .cast("int").alias("max_length"),
            )
            for i, check in enumerate(self.checks)
        ])
        return totals.select(F.inline(rows))

    def verify(self) -> None:
        """Run the checks in one aggregation and raise the first that fails."""
        if self.checks:
            raise_first(self.checks, self._frame.agg(*metrics(self.checks)).first().asDict())

    def strict(self) -> DataFrame:
        """The declared table, lazily: a bad row fails the job that reaches it."""
        frame = self._frame
        if self.checks:
            # The messages stay out of the generated loop, which is compiled to
            # machine code only while it is small.
            messages = F.array_compact(F.array(*[
                F.when(check.flag, F.lit(_inline_message(check))) for check in self.checks
            ]))
            stop = F.raise_error(messages.getItem(0)).cast("boolean")
            broken = _any([check.flag for check in self.checks])
            frame = frame.where((F.col(_HERE) >= 0) & F.when(broken, stop).otherwise(F.lit(True)))
        return frame.select(*[
            _never_null(out, field) for out, field in zip(self.outputs(), struct_of(self.columns))
        ])

    def observed(self, observation: Observation) -> DataFrame:
        """The declared columns, with the checks counted while a job runs over them."""
        wanted = metrics(self.checks) or [F.count(F.lit(1)).alias("rows")]
        return self._frame.observe(observation, *wanted).select(*self.outputs())

    def settle(self, observation: Observation) -> None:
        """Raise the first check that the finished job saw failing."""
        if self.checks:
            raise_first(self.checks, observation.get)

    def split(self, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows that pass every check, typed; and the others, as given, with reasons.

        All rows are read, converted and judged once, and written by their outcome to
        ``folder``, or a new one of the shared scratch folder; both results are read from it.
        """
        spark = self.source.sparkSession
        folder = folder or f"{scratch_dir(spark).rstrip('/')}/quarantine-{uuid.uuid4().hex}"
        reasons = F.array_compact(F.array(*[
            F.when(check.flag, F.lit(f"{check.column}:{check.rule}")) for check in self.checks
        ])) if self.checks else F.array().cast("array<string>")
        outputs, given = self.outputs(), [F.col(_quoted(n)) for n in self.source.columns]
        judged, failed = self._frame.withColumn("__pact_reasons", reasons), F.size("__pact_reasons") > 0
        # Names are given again on the way out: within a file they may not differ in case only.
        sides = {
            "good": (~failed, F.struct(*[out.alias(f"c{i}") for i, out in enumerate(outputs)])),
            "bad": (failed, F.struct(*[value.alias(f"c{i}") for i, value in enumerate(given)])),
        }
        kept = judged.select(*[F.when(holds, values).alias(side) for side, (holds, values) in sides.items()],
                             "__pact_reasons", F.when(failed, "bad").otherwise("good").alias("__pact_outcome"))
        kept.write.partitionBy("__pact_outcome").parquet(folder)
        # A reader with the schema at hand starts no job of its own.
        rows = spark.read.schema(kept.schema).parquet(folder)
        passed = rows.where("__pact_outcome = 'good'").select(*[
            F.col("good")[f"c{i}"].alias(c.name, metadata={"sql_type": c.type}) for i, c in enumerate(self.columns)])
        refused = rows.where("__pact_outcome = 'bad'").select(*[
            F.col("bad")[f"c{i}"].alias(name) for i, name in enumerate(self.source.columns)], F.col("__pact_reasons").alias("reasons"))
        return passed, refused


def metrics(checks: Sequence[Check]) -> list[Expr]:
    """Aggregates that decide the checks."""
    wanted = []
    for i, check in enumerate(checks):
        wanted.append(F.count_if(check.flag).alias(f"n{i}"))
        if check.length is not None:
            wanted.append(F.max(check.length).alias(f"m{i}"))
    return wanted


def raise_first(checks: Sequence[Check], seen: Mapping[str, Any]) -> None:
    for i, check in enumerate(checks):
        if seen.get(f"n{i}"):
            raise check.failure(seen[f"n{i}"], seen.get(f"m{i}"))


def _value_checks(
    column: Column, value: Expr, failed: Expr | None, error: type[PactError]
) -> list[Check]:
    checks, name = [], _braced(column.name)
    if not column.nullable:
        missing = value.isNull() if failed is None else value.isNull() & ~failed
        checks.append(Check(
            column.name, "null", missing, error,
            f"column {name} is declared nullable: false but contains nulls",
        ))
    sql_type = column.sql_type
    if sql_type.length is not None:
        length = F.char_length(value)
        checks.append(Check(
            column.name, "length", F.coalesce(length > sql_type.length, F.lit(False)), error,
            f"column {name}: value length {{longest}} exceeds {sql_type}", length,
        ))
    return checks


def _any(flags: Sequence[Expr]) -> Expr:
    """Whether one of the flags is set, as a tree that stays shallow."""
    if len(flags) == 1:
        return flags[0]
    half = len(flags) // 2
    return _any(flags[:half]) | _any(flags[half:])


def _inline_message(check: Check) -> str:
    text = check.text.format(count="some", longest="of a row")
    return f"{check.error.__name__}: {text}"


def _never_null(value: Expr, field: T.StructField) -> Expr:
    """Give a checked NOT NULL column a schema that says so."""
    if field.nullable:
        return value
    if isinstance(field.dataType, T.StringType):
        filler = F.lit("")
    elif isinstance(field.dataType, T.BooleanType):
        filler = F.lit(False)
    elif isinstance(field.dataType, T.DateType):
        filler = F.expr("DATE '1970-01-01'")
    elif isinstance(field.dataType, T.TimestampNTZType):
        filler = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    elif isinstance(field.dataType, T.DecimalType):
        filler = F.lit(Decimal(0).scaleb(-field.dataType.scale)).cast(field.dataType)
    else:
        filler = F.lit(0).cast(field.dataType)
    return F.coalesce(value, filler).alias(field.name, metadata=field.metadata)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _braced(name: str) -> str:
    return name.replace("{", "{{").replace("}", "}}")
