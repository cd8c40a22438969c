"""The release check: build a contract's table empty and bind its reads."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from tablepact.contract import Contract
from tablepact.errors import PactError
from tablepact.operators.tables import build_empty_from_columns, ensure_schema
from tablepact.plans.run import result_record
from tablepact.session import configure
from tablepact.sources.csv import check_header, header_line, header_names, warn_extras
from tablepact.sources.reads import check_binds

logger = logging.getLogger("tablepact.gate")


def build_candidate(spark: SparkSession, contract: Contract, schema: str) -> None:
    """Schema, then CSV header, then reads, then the typed empty table.

    The first failure ends it; no data is scanned beyond a header line.
    """
    ensure_schema(spark, schema)
    if contract.kind == "csv":
        location = contract.reads["csv"]
        line = header_line(spark, location)
        if not line:
            raise ValueError(f"csv source has no header line (empty or unreadable): {location}")
        extras = check_header(header_names(line), [c.name for c in contract.output_columns])
        warn_extras(contract.relation, extras)
    else:
        for sql in contract.reads.values():
            check_binds(spark, sql)
    build_empty_from_columns(
        spark, schema, contract.table, contract.output_columns, contract.config
    )


def gate_contract(
    spark: SparkSession, contract: Contract | Mapping[str, Any], schema: str
) -> dict[str, Any]:
    """Run the release check and return its result record."""
    unique_id = ""
    try:
        if not isinstance(contract, Contract):
            contract = Contract.from_dict(contract)
        unique_id = contract.relation
        configure(spark)
        build_candidate(spark, contract, schema)
        return result_record("success", unique_id=unique_id)
    except PactError as exc:
        return result_record("error", exc.result_message(), 1, unique_id)
    except Exception as exc:
        logger.error("release check of %s failed: %s", unique_id, exc)
        return result_record("error", str(exc), 1, unique_id)
