"""The contract's own rules: one test per refusal."""

import pytest
from pyspark.sql import types as T

from tablepact.contract import Column, Contract, check_csv_location, columns_of, struct_of
from tablepact.errors import ContractError, LoadError
from tablepact.session import scratch_dir
from tablepact.sqltypes import SqlType, parse_type

GOOD = {
    "schema": "sales", "table": "open_orders", "owner": "desk", "schedule": "hourly", "criticality": "CORE",
    "reads": {"orders": "select o_orderkey, o_totalprice from orders"},
    "output_columns": [{"name": "o_orderkey", "type": "BIGINT", "nullable": False}, {"name": "o_totalprice", "type": "NUMERIC(12,2)"}],
}
CSV = {"schema": "sales", "table": "nations", "kind": "csv", "reads": {"csv": "s3://drop/nation.csv"},
       "output_columns": [{"name": "n_nationkey", "type": "INTEGER"}]}


def test_good_contracts():
    contract = Contract.from_dict(GOOD)
    assert contract.relation == "sales.open_orders" and contract.kind == "model" and contract.extra_columns == "raise"
    assert contract.output_columns == (Column("o_orderkey", "BIGINT", False), Column("o_totalprice", "NUMERIC(12,2)", True))
    assert contract.info["owner"] == "desk"
    assert Contract.from_dict({**GOOD, "kind": "python-model", "script": "s.py", "config": None}).config == {}
    assert Contract.from_dict(CSV).kind == "csv"
    assert Contract.from_dict({**CSV, "kind": "python-csv", "extra_columns": "warn"}).extra_columns == "warn"


@pytest.mark.parametrize("change,message", [
    ({"colour": "red"}, "unknown key"), ({"schema": ""}, "schema"), ({"table": None}, "table"),
    ({"kind": "spark"}, "kind"), ({"kind": ["model"]}, "kind"), ({"extra_columns": "drop"}, "extra_columns"),
    ({"extra_columns": ["raise"]}, "extra_columns"), ({"criticality": "LOW"}, "criticality"),
    ({"owner": 3}, "owner"), ({"description": 3}, "description"), ({"content_hash": 3}, "content_hash"),
    ({"config": []}, "config"), ({"reads": {}}, "reads"), ({"reads": ["select 1"]}, "reads"),
    ({"reads": {"": "select 1"}}, "reads"), ({"reads": {"a": " "}}, "reads"), ({"reads": {"a": 1}}, "reads"),
    ({"output_columns": []}, "output_columns"), ({"output_columns": {}}, "output_columns"),
    ({"output_columns": ["id"]}, "mapping"), ({"output_columns": [{"name": "a", "type": "INT", "pk": 1}]}, "unknown key"),
    ({"output_columns": [{"type": "INT"}]}, "name"), ({"output_columns": [{"name": "a", "type": "FLOAT"}]}, "FLOAT"),
    ({"output_columns": [{"name": "a"}]}, "None"), ({"output_columns": [{"name": "a", "type": "INT", "nullable": 1}]}, "nullable"),
    ({"output_columns": [{"name": "a", "type": "INT"}, {"name": "a", "type": "INT"}]}, "more than once"),
])
def test_refused_contracts(change, message):
    with pytest.raises(ContractError, match=message):
        Contract.from_dict({**GOOD, **change})


@pytest.mark.parametrize("change", [
    {"script": "x.py"}, {"reads": {"csv": "s3://bucket/k", "b": "x"}}, {"reads": {"file": "s3://b/k"}},
    {"reads": {"csv": "s3://"}}, {"reads": {"csv": "s3://bucket"}}, {"reads": {"csv": "s3:///key"}},
    {"reads": {"csv": "http://host/a.csv"}}, {"reads": {"csv": 5}}, {"reads": {"csv": ""}}, {"reads": "s3://b/k"},
])
def test_refused_csv_contracts(change):
    with pytest.raises(ContractError):
        Contract.from_dict({**CSV, **change})


def test_csv_locations():
    for good in ("s3://b/k", "s3a://b/dir/k.csv", "/tmp/x.csv", "file:///tmp/x.csv", "hdfs://h/x"):
        assert check_csv_location(good) == good


@pytest.mark.parametrize("text,want", [
    ("bigint", SqlType("BIGINT")), ("INT", SqlType("INTEGER")), ("Integer", SqlType("INTEGER")),
    ("double precision", SqlType("DOUBLE_PRECISION")), ("TEXT", SqlType("TEXT")), ("timestamp", SqlType("TIMESTAMP")),
    ("DATE", SqlType("DATE")), ("boolean", SqlType("BOOLEAN")), ("VARCHAR(64)", SqlType("VARCHAR", length=64)),
    ("char(3)", SqlType("CHAR", length=3)), ("NUMERIC(10,2)", SqlType("NUMERIC", 10, 2)),
    ("decimal(38, 0)", SqlType("NUMERIC", 38, 0)),
])
def test_types(text, want):
    assert parse_type(text) == want


@pytest.mark.parametrize("text", [
    "", "FLOAT", "DOUBLE", "DOUBLE_PRECISION", "VARCHAR", "VARCHAR()", "VARCHAR(-1)", "VARCHAR (3)", "NUMERIC",
    "NUMERIC(10)", "NUMERIC(10 ,2)", "NUMERIC(0,0)", "NUMERIC(39,2)", "NUMERIC(5,6)", "ARRAY<INT>", "JSON",
    "TIMESTAMP WITH TIME ZONE", "INT; DROP TABLE x", "VARCHAR(٣)", "ınt", None, 5,
])
def test_refused_types(text):
    with pytest.raises(ContractError):
        parse_type(text)


def test_schema_of_columns():
    schema = struct_of(columns_of([{"name": "a", "type": "VARCHAR(3)", "nullable": False}, Column("n", "NUMERIC(5,1)")]))
    assert schema["a"] == T.StructField("a", T.StringType(), False, {"sql_type": "VARCHAR(3)"})
    assert schema["n"].dataType == T.DecimalType(5, 1)


def test_errors_carry_their_class():
    assert LoadError("x").result_message() == "LoadError: x"


def test_scratch_folder_is_the_named_one(spark):
    assert scratch_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
