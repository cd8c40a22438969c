"""Registration of queries and the helpers they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablepact.contract import Column
from tablepact.operators.tables import drop_schema, ensure_schema
from tablepact.session import configure, scratch_dir

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_FOLDER = "tablepact.suite.folder"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(build: Query) -> Query:
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_tables(spark, sf_dir)
            return build(spark, sf_dir)

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return build

    return register


def use_tables(spark: SparkSession, sf_dir: str) -> None:
    """Name the parquet tables of a folder, so that reads can refer to them."""
    configure(spark)
    named = spark.conf.get(_FOLDER, "")
    if named == sf_dir and all(spark.catalog.tableExists(table) for table in TABLES):
        return
    spark.conf.set(_FOLDER, sf_dir)
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def fresh_schema(spark: SparkSession, name: str) -> str:
    """An empty schema for the tables a query builds."""
    schema = f"pact_{name}"
    drop_schema(spark, schema)
    ensure_schema(spark, schema)
    return schema


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def columns(*declared: str) -> tuple[Column, ...]:
    """Columns from ``"name TYPE"`` or ``"name TYPE not null"``."""
    found = []
    for text in declared:
        name, _, kind = text.partition(" ")
        required = kind.endswith(" not null")
        found.append(Column(name, kind.removesuffix(" not null"), not required))
    return tuple(found)
