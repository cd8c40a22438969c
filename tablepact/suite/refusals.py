"""What is refused before any row is read: one record per attempt over a given table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.errors import PactError
from tablepact.operators.conform import conform
from tablepact.sources.reads import ReadContext, check_binds, ensure_single_read, fetch
from tablepact.suite.registry import columns, query

_KEY = columns("o_orderkey BIGINT not null")
_TWICE = "select o_orderkey as k, o_custkey as k from orders"


def _outcome(attempt: Callable[[], Any]) -> str:
    try:
        attempt()
    except (PactError, ValueError) as exc:
        return type(exc).__name__
    return "accepted"


def _records(spark: SparkSession, rows: DataFrame, attempts: dict[str, Callable[[], Any]]) -> DataFrame:
    told = [(name, _outcome(attempt)) for name, attempt in attempts.items()]
    return spark.createDataFrame(told, "attempt string, outcome string").withColumn("n_rows", F.lit(rows.count()))


def _expected(**outcomes: str) -> str:
    return " union all ".join(
        f"select '{name}' as attempt, '{outcome}' as outcome, count(*) as n_rows from orders"
        for name, outcome in outcomes.items()
    )


@query(_expected(
    as_declared="accepted", unknown_policy="ValueError", name_twice="ConformError", not_declared="ConformError",
    not_declared_but_warned="accepted", not_given="ConformError", float_to_decimal="ConformError",
    text_to_boolean="ConformError", moment_to_date="ConformError",
))
def refused_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types that do not fit the declared columns."""
    rows = ReadContext(spark, {"orders": "select * from orders"}).read("orders")
    key = rows.select("o_orderkey")
    return _records(spark, key, {
        "as_declared": lambda: conform(key, _KEY),
        "unknown_policy": lambda: conform(key, _KEY, "ignore"),
        "name_twice": lambda: conform(rows.select("o_orderkey", "o_orderkey"), _KEY),
        "not_declared": lambda: conform(rows, _KEY),
        "not_declared_but_warned": lambda: conform(rows, _KEY, "warn"),
        "not_given": lambda: conform(rows.select("o_custkey"), _KEY, "warn"),
        "float_to_decimal": lambda: conform(rows.select("o_totalprice"), columns("o_totalprice NUMERIC(12,2)")),
        "text_to_boolean": lambda: conform(rows.select("o_orderstatus"), columns("o_orderstatus BOOLEAN")),
        "moment_to_date": lambda: conform(
            rows.select(F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate")), columns("o_orderdate DATE")),
    })


@query(_expected(
    names_twice_at_the_gate="accepted", names_twice_when_fetched="ValueError", java_call="ReadError",
    java_call_after_many_columns="ReadError", java_call_in_quotes="accepted", unknown_column="ReadError",
    two_queries="ValueError", a_write="ValueError",
))
def refused_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that are not one query, do not bind, or would run code."""
    rows = ReadContext(spark, {"orders": "select o_orderkey from orders"}).read("orders")
    call = "reflect('java.util.UUID', 'randomUUID')"
    many = ", ".join(f"o_orderkey + {i} as c{i}" for i in range(40))
    return _records(spark, rows, {
        "names_twice_at_the_gate": lambda: ensure_single_read(spark, _TWICE),
        "names_twice_when_fetched": lambda: fetch(spark, _TWICE),
        "java_call": lambda: check_binds(spark, f"select {call} as u from orders"),
        "java_call_after_many_columns": lambda: check_binds(spark, f"select {many}, {call} as u from orders"),
        "java_call_in_quotes": lambda: check_binds(spark, "select 'reflect(' as u from orders"),
        "unknown_column": lambda: check_binds(spark, "select o_nothing from orders"),
        "two_queries": lambda: check_binds(spark, "select 1 from orders; select 2 from orders"),
        "a_write": lambda: check_binds(spark, "insert into orders select * from orders"),
    })
