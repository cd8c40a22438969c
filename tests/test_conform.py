"""Conform: names, types, values, the report and the quarantine split."""

import datetime as dt
import logging
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import Column
from tablepact.errors import ConformError
from tablepact.operators.conform import (
    conform, conform_verified, plan_conform, quarantine, violation_report,
)
from tablepact.operators.unique import unique_violations

COLUMNS = (Column("id", "INTEGER", False), Column("amount", "NUMERIC(10,2)"), Column("email", "VARCHAR(5)"))


def frame(spark, rows, schema="id bigint, amount string, email string"):
    return spark.createDataFrame(rows, schema)


def test_reorders_and_casts(spark):
    df = frame(spark, [("a", "1.50", 1)], "email string, amount string, id bigint")
    out = conform(df, COLUMNS)
    assert out.columns == ["id", "amount", "email"]
    assert [f.dataType for f in out.schema] == [T.IntegerType(), T.DecimalType(10, 2), T.StringType()]
    assert [f.nullable for f in out.schema] == [False, True, True]
    assert out.schema["email"].metadata["sql_type"] == "VARCHAR(5)"
    assert [tuple(r) for r in out.collect()] == [(1, D("1.50"), "a")]


@pytest.mark.parametrize("rows,schema,message", [
    ([(3.9, "1", "a")], "id double, amount string, email string", "column id"),
    ([("abc", "1", "a")], "id string, amount string, email string", "column id"),
    ([(1, "123456789.12", "a")], None, "column amount"),
    ([(1, "1.234", "a")], None, "column amount"),
    ([(1, "1", "toolong")], None, r"email.*value length 7 exceeds VARCHAR\(5\)"),
    ([(None, "1", "a")], None, "id.*contains nulls"),
])
def test_bad_values(spark, rows, schema, message):
    df = frame(spark, rows, schema or "id bigint, amount string, email string")
    with pytest.raises(ConformError, match=message):
        conform_verified(df, COLUMNS)
    lazy = conform(df, COLUMNS)
    for action in (lazy.collect, lazy.count):
        with pytest.raises(Exception, match="ConformError"):
            action()


def test_structure(spark, caplog):
    with pytest.raises(ConformError, match="more than once"):
        conform(spark.sql("select 1 as id, 2 as id"), COLUMNS)
    extra = spark.sql("select 1L as id, '1' as amount, 'a' as email, 0 as tmp")
    with pytest.raises(ConformError, match="not declared.*tmp"):
        conform(extra, COLUMNS)
    with caplog.at_level(logging.WARNING):
        assert conform(extra, COLUMNS, "warn").columns == ["id", "amount", "email"]
    assert "columns left out" in caplog.text
    with pytest.raises(ConformError, match="not given.*email"):
        conform(spark.sql("select 1 as id, '1' as amount"), COLUMNS)
    with pytest.raises(ValueError) as refused:
        conform(extra, COLUMNS, "ignore")
    assert not isinstance(refused.value, ConformError)


def test_first_rule_decides(spark):
    # A cast failure of a later column is reported before a null of an earlier one.
    df = frame(spark, [(None, "x", "toolong")])
    with pytest.raises(ConformError, match="amount"):
        conform_verified(df, COLUMNS)
    with pytest.raises(ConformError, match="more than once"):
        conform(spark.sql("select 1 as id, 1 as id, 1 as tmp"), COLUMNS)


def test_names_are_case_sensitive(spark):
    with pytest.raises(ConformError, match="not declared.*ID"):
        conform(spark.sql("select 1 as ID"), (Column("id", "INTEGER"),))
    both = spark.createDataFrame([(1, 2)], "a int, b int").toDF("ID", "id")
    assert conform(both, (Column("id", "INTEGER"),), "warn").collect()[0][0] == 2
    odd = spark.sql("select 1 as `rate%`, 2 as `a.b`, 3 as `t``k`")
    out = conform(odd, (Column("a.b", "INTEGER"), Column("t`k", "BIGINT", False), Column("rate%", "TEXT")))
    assert tuple(out.first()) == (2, 3, "1")


def test_length_counts_code_points(spark):
    df = spark.createDataFrame([("a😀",)], "s string")
    assert conform_verified(df, (Column("s", "VARCHAR(2)"),)).count() == 1
    with pytest.raises(ConformError, match="value length 2 exceeds CHAR"):
        conform_verified(df, (Column("s", "CHAR(1)"),))


def test_not_null_schema_of_each_type(spark):
    types = ["BIGINT", "INTEGER", "DOUBLE PRECISION", "NUMERIC(10,2)", "VARCHAR(9)", "TEXT", "TIMESTAMP",
             "DATE", "BOOLEAN"]
    columns = [Column(f"c{i}", t, False) for i, t in enumerate(types)]
    row = (1, 2, 1.5, D("3.50"), "x", "y", dt.datetime(2020, 1, 2, 3, 4, 5), dt.date(2020, 1, 2), True)
    df = spark.createDataFrame([row], T.StructType([
        T.StructField(c.name, c.sql_type.spark) for c in columns]))
    out = conform(df, columns)
    assert not any(f.nullable for f in out.schema)
    assert tuple(out.first()) == row


def test_report_and_quarantine(spark):
    df = frame(spark, [(1, "1.50", "a"), (None, "2.345", "toolong"), (3, "x", None), (2**40, "4", "bb")])
    seen = {(r.column_name, r.rule): (r.violations, r.max_length)
            for r in violation_report(df, COLUMNS).collect()}
    assert seen == {("id", "cast"): (1, None), ("amount", "cast"): (2, None),
                    ("id", "null"): (1, None), ("email", "length"): (1, 7)}
    good, bad = quarantine(df, COLUMNS)
    assert [tuple(r) for r in good.collect()] == [(1, D("1.50"), "a")]
    assert {tuple(r[:3]): sorted(r.reasons) for r in bad.collect()} == {
        (None, "2.345", "toolong"): ["amount:cast", "email:length", "id:null"],
        (3, "x", None): ["amount:cast"],
        (2**40, "4", "bb"): ["id:cast"],
    }


def test_quarantine_judges_each_row_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id as C0", "id", "if(id % 2 = 0, '1.5', 'x') as amount", "'a' as email").write.parquet(path)
    source = spark.read.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    good, bad = quarantine(source.mapInArrow(counted, source.schema), COLUMNS, "warn", str(tmp_path / "apart"))
    assert good.count() == 50 and bad.count() == 50 and good.agg(F.sum("id")).first()[0] == sum(range(0, 100, 2))
    assert seen.value == 100
    assert good.schema["amount"].dataType == T.DecimalType(10, 2) and good.schema["email"].metadata == {"sql_type": "VARCHAR(5)"}
    assert bad.columns == ["C0", "id", "amount", "email", "reasons"]
    for side in (good, bad):
        assert side._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_checks_are_one_pass_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(100).selectExpr("id", "cast(id as string) amount", "'a' email", "id unused").write.parquet(path)
    plan = plan_conform(spark.read.parquet(path), COLUMNS, "warn")
    text = plan.report()._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "unused" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_wide_tables(spark):
    columns = [Column(f"c{i}", ("INTEGER", "VARCHAR(3)", "NUMERIC(10,2)")[i % 3], False) for i in range(90)]
    df = spark.range(50).select(*[
        (F.col("id") + i if i % 3 == 0 else F.lit("1.5")).cast("string").alias(c.name) for i, c in enumerate(columns)])
    assert conform(df, columns).count() == 50
    assert violation_report(df, columns).where("violations > 0").count() == 0
    bad = df.withColumn("c80", F.lit("1.555")).withColumn("c40", F.lit("long"))
    with pytest.raises(Exception, match="ConformError: column c80"):
        conform(bad, columns).collect()
    assert quarantine(bad, columns)[1].first().reasons == ["c80:cast", "c40:length"]


def test_unique_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, `v w` string")
    assert [tuple(r) for r in unique_violations(df, ["k", "v w"]).collect()] == [(1, "a", 2)]
    assert [tuple(r) for r in unique_violations(df, ["k"]).collect()] == [(1, 3)]
