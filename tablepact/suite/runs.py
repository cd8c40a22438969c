"""Contracts run end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.operators import tables as t
from tablepact.plans.gate import gate_contract
from tablepact.plans.run import run_contract
from tablepact.sources.reads import ReadContext
from tablepact.suite.csvs import write_csv
from tablepact.suite.registry import fresh_schema, query


_SHIPPED = """
select date_trunc('month', l_shipdate)::date as month, l_returnflag as flag, count(*) as n_lines,
       cast(sum(cast(l_quantity as decimal(12,2))) as decimal(22,2)) as quantity, max(l_discount) as best_discount
from lineitem group by 1, 2
"""


def _contract(schema: str, **change) -> dict:
    return {
        "schema": schema,
        "table": "shipped",
        "reads": {"lines": "select l_shipdate, l_returnflag, l_quantity, l_discount from lineitem where l_quantity > 0"},
        "output_columns": [
            {"name": "month", "type": "DATE", "nullable": False},
            {"name": "flag", "type": "CHAR(1)", "nullable": False},
            {"name": "n_lines", "type": "BIGINT", "nullable": False},
            {"name": "quantity", "type": "NUMERIC(22,2)"},
            {"name": "best_discount", "type": "DOUBLE PRECISION"},
        ],
        "config": {"unique": [["month", "flag"]], "partitioning": ["year(month)"], "sorted_by": ["month"]},
        **change,
    }


def _script(ctx: ReadContext) -> DataFrame:
    month = F.trunc("l_shipdate", "month").alias("month")
    return ctx.read("lines").groupBy(month, F.col("l_returnflag").alias("flag")).agg(
        F.max("l_discount").alias("best_discount"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"), F.count("*").alias("n_lines"))


@query(_SHIPPED)
def run_contract_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release check, the run, and the replaced table."""
    db = fresh_schema(spark, "end_to_end")
    contract = _contract(db)
    gate = gate_contract(spark, contract, fresh_schema(spark, "end_to_end_candidate"))
    run = run_contract(spark, contract, _script)
    if (gate["status"], run["status"]) != ("success", "success"):
        raise RuntimeError(f"{gate} {run}")
    return spark.table(f"{db}.shipped")


@query("""
select o_orderkey, o_totalprice, o_orderpriority from orders
""")
def run_csv_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract without a script: a CSV source, checked, loaded, read back."""
    db = fresh_schema(spark, "csv_contract")
    folder = write_csv(spark, spark.table("orders"), "run_csv")
    contract = {
        "schema": db, "table": "drop", "kind": "csv", "reads": {"csv": folder}, "extra_columns": "warn",
        "output_columns": [
            {"name": "o_orderkey", "type": "BIGINT", "nullable": False},
            {"name": "o_totalprice", "type": "DOUBLE PRECISION"},
            {"name": "o_orderpriority", "type": "VARCHAR(15)"},
        ],
    }
    gate = gate_contract(spark, contract, fresh_schema(spark, "csv_contract_candidate"))
    run = run_contract(spark, contract)
    if (gate["status"], run["status"]) != ("success", "success"):
        raise RuntimeError(f"{gate} {run}")
    return spark.table(f"{db}.drop")


@query(f"""
with months as (select count(*) as n from ({_SHIPPED}))
select 1 as schema_version, 'success' as status, 'rows=' || cast(n as varchar) as message,
       0 as failures, 'pact_run_log.shipped' as unique_id, n as rows_after from months
union all
select 1, 'error', 'ConformError: column flag is declared nullable: false but contains nulls', 1, 'pact_run_log.shipped', n from months
union all
select 1, 'error', 'ConformError: declared names not given: [''quantity''] (declared are [''month'', ''flag'', ''n_lines'', ''quantity'', ''best_discount''])',
       1, 'pact_run_log.shipped', n from months
""")
def run_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per run, good or bad; failed runs leave the table as it was."""
    db = fresh_schema(spark, "run_log")
    log = f"{db}.runs_{uuid.uuid4().hex}"
    for script in (
        _script,
        lambda ctx: _script(ctx).withColumn("flag", F.expr("nullif(flag, 'A')")),
        lambda ctx: _script(ctx).drop("quantity"),
    ):
        run_contract(spark, _contract(db), script, run_log=log)
    return spark.sql(f"select *, (select count(*) from {db}.shipped) as rows_after from {log}")


@query("""
select o_orderkey as order_id, o_orderpriority from orders
""")
def gate_then_run_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract reads what another produced, after its reads are bound."""
    db = fresh_schema(spark, "upstream")
    first = _contract(
        db, table="first", reads={"orders": "select o_orderkey as order_id, o_orderpriority from orders"},
        output_columns=[{"name": "order_id", "type": "BIGINT", "nullable": False},
                        {"name": "o_orderpriority", "type": "VARCHAR(15)"}],
        config={"partitioning": ["bucket(order_id, 8)"]},
    )
    second = {**first, "table": "second", "reads": {"orders": f"select * from {db}.first"}, "config": {}}
    before = gate_contract(spark, second, fresh_schema(spark, "upstream_candidate"))
    run_contract(spark, first, lambda ctx: ctx.read("orders"))
    after = gate_contract(spark, second, fresh_schema(spark, "upstream_candidate"))
    run = run_contract(spark, second, lambda ctx: ctx.read("orders"))
    if (before["status"], after["status"], run["status"]) != ("error", "success", "success"):
        raise RuntimeError(f"{before} {after} {run}")
    assert t.describe(spark, db, "first").layout.bucket is not None
    return spark.table(f"{db}.second")
