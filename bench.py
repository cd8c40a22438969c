"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; the median counts. A run
includes building the query, loads included, and reading all of its rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tablepact.operators import tables as t  # noqa: E402
from tablepact.operators.conform import conform, violation_report  # noqa: E402
from tablepact.sources.csv import read_csv  # noqa: E402
from tablepact.suite import QUERIES  # noqa: E402
from tablepact.suite.checks import LINEITEM  # noqa: E402
from tablepact.suite.csvs import write_csv  # noqa: E402
from tablepact.suite.registry import fresh_schema, use_tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

SUITE = (
    "model_left_join", "conform_violation_report", "conform_quarantine_good",
    "cast_string_to_int", "cast_string_to_double", "cast_string_to_decimal",
    "cast_string_to_date", "cast_string_to_timestamp", "cast_to_text",
    "csv_load", "csv_multi_line_text", "unique_key_violations",
    "replace_load", "layout_day_partitions", "layout_bucket_sorted",
    "fingerprint_text", "fingerprint_group", "fingerprint_large_groups", "fingerprint_record",
    "snapshot_changes_of_documents", "run_contract_end_to_end", "run_csv_contract",
)


def conform_report_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violation_report(spark.table("lineitem"), LINEITEM)


def conform_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(spark.table("lineitem"), LINEITEM)


def conform_and_replace_one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh_schema(spark, "bench_replace")
    t.ensure_table(spark, db, "lineitem", LINEITEM)
    t.load(spark, db, "lineitem", spark.table("lineitem"))
    return spark.table(f"{db}.lineitem").limit(0)


def report_then_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh_schema(spark, "bench_twice")
    violation_report(spark.table("lineitem"), LINEITEM).collect()
    name = f"{db}.lineitem_{uuid.uuid4().hex}"
    conform(spark.table("lineitem"), LINEITEM).write.saveAsTable(name)
    return spark.table(name).limit(0)


_FOLDERS: dict[str, str] = {}


def _lineitem_csv(spark: SparkSession) -> str:
    if "lineitem" not in _FOLDERS:
        _FOLDERS["lineitem"] = write_csv(spark, spark.table("lineitem"), "bench")
    return _FOLDERS["lineitem"]


def csv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c if c.name != "l_quantity" else type(c)("l_quantity", "DOUBLE PRECISION") for c in LINEITEM]
    return read_csv(spark, _lineitem_csv(spark), columns)


def csv_lineitem_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For comparison: Spark's own reader with a schema, unchecked."""
    return spark.read.schema(spark.table("lineitem").schema).option("header", True).csv(_lineitem_csv(spark))


EXTRA = (
    conform_report_lineitem, conform_lineitem, conform_and_replace_one_job, report_then_write,
    csv_lineitem, csv_lineitem_plain,
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tablepact-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    use_tables(spark, SF_DIR)
    plans = {name: QUERIES[name] for name in SUITE} | {f.__name__: f for f in EXTRA}
    only = sys.argv[1:]
    seconds = {}
    for name, plan in plans.items():
        if only and name not in only:
            continue
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            plan(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: first {taken[0]:.2f} s, then {seconds[name]:.2f} s", file=sys.stderr)
    compared = ("csv_lineitem_plain", "report_then_write")
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(v for k, v in seconds.items() if k not in compared), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
