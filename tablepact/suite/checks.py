"""Conform: the declared shape, the violation report, the quarantine split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.operators.conform import conform, conform_verified, quarantine, violation_report
from tablepact.operators.unique import unique_violations
from tablepact.sources.reads import ReadContext
from tablepact.suite.registry import columns, query

_DIRTY = """
select c_custkey, nullif(c_name, concat('Customer#', lpad(cast(c_custkey - c_custkey % 10 as {text}), 9, '0'))) as c_name,
       c_mktsegment,
       concat(cast(cast(c_acctbal as decimal(12,2)) as {text}), case when c_custkey % 5 = 0 then '1' else '0' end) as balance,
       case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then 'unknown' else cast(c_nationkey as {text}) end as nation
from customer
"""
_DIRTY_COLUMNS = (
    "c_custkey BIGINT not null", "c_name VARCHAR(25) not null", "c_mktsegment VARCHAR(8)",
    "balance NUMERIC(10,2)", "nation INTEGER not null",
)
_BREAKS = {
    "balance:cast": "c_custkey % 5 = 0",
    "nation:cast": "c_custkey % 7 <> 0 and c_custkey % 11 = 0",
    "c_name:null": "c_name is null",
    "c_mktsegment:length": "length(c_mktsegment) > 8",
    "nation:null": "c_custkey % 7 = 0",
}


@query("""
select n_name as nation, cast(sum(s_acctbal) as decimal(22,2)) as balance, count(s_suppkey) as suppliers
from nation left join (select s_suppkey, s_nationkey, cast(s_acctbal as decimal(12,2)) as s_acctbal from supplier where s_acctbal < 0) on s_nationkey = n_nationkey
group by n_name
""")
def model_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with what its indebted suppliers owe: two reads, joined and summed in user code, as declared."""
    ctx = ReadContext(spark, {
        "nation": "select n_nationkey, n_name from nation",
        "owing": "select s_suppkey, s_nationkey, cast(s_acctbal as decimal(12,2)) as owed from supplier where s_acctbal < 0",
    })
    every, owing = ctx.read("nation"), ctx.read("owing")
    found = every.join(owing, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("nation")).agg(
        F.count("s_suppkey").alias("suppliers"), F.sum("owed").alias("balance"))
    return conform(found, columns("nation VARCHAR(25) not null", "balance NUMERIC(22,2)", "suppliers BIGINT not null"))


@query("""
select c_mktsegment, cast(c_custkey as integer) as c_custkey, c_name from customer
""")
def conform_reorder_drop_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared order; undeclared columns dropped."""
    given = ReadContext(spark, {"rows": "select * from customer"}).read("rows")
    return conform(given, columns(
        "c_mktsegment VARCHAR(10)", "c_custkey INTEGER not null", "c_name TEXT"
    ), "warn")


@query("""
select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as integer) as l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate from lineitem
""")
def conform_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the widest table, values checked before use."""
    given = ReadContext(spark, {"rows": "select * from lineitem"}).read("rows")
    return conform_verified(given, LINEITEM)


LINEITEM = columns(
    "l_orderkey BIGINT not null", "l_partkey BIGINT not null", "l_suppkey BIGINT not null",
    "l_linenumber INTEGER not null", "l_quantity INTEGER not null",
    "l_extendedprice DOUBLE PRECISION", "l_discount DOUBLE PRECISION", "l_tax DOUBLE PRECISION",
    "l_returnflag CHAR(1) not null", "l_linestatus CHAR(1) not null", "l_shipdate TIMESTAMP",
)


def _dirty(spark: SparkSession) -> DataFrame:
    return ReadContext(spark, {"rows": _DIRTY.format(text="string")}).read("rows")


def _counted(column: str, rule: str, longest: str = "cast(null as integer)") -> str:
    return (
        f"select '{column}' as column_name, '{rule}' as rule, "
        f"count(*) filter (where {_BREAKS.get(f'{column}:{rule}', 'false')}) as violations, "
        f"{longest} as max_length from given"
    )


@query(
    f"with given as ({_DIRTY.format(text='varchar')}) " + " union all ".join([
        _counted("balance", "cast"), _counted("nation", "cast"), _counted("c_custkey", "null"),
        _counted("c_name", "null"),
        _counted("c_name", "length", "cast(max(length(c_name)) as integer)"),
        _counted("c_mktsegment", "length", "cast(max(length(c_mktsegment)) as integer)"),
        _counted("nation", "null"),
    ])
)
def conform_violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with the number of values that break it, in one pass."""
    return violation_report(_dirty(spark), columns(*_DIRTY_COLUMNS))


@query(f"""
with given as ({_DIRTY.format(text='varchar')})
select c_custkey, c_name, c_mktsegment, cast(balance as decimal(10,2)) as balance,
       cast(nation as integer) as nation
from given where not coalesce({" or ".join(f"({rule})" for rule in _BREAKS.values())}, false)
""")
def conform_quarantine_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that conform, typed."""
    return quarantine(_dirty(spark), columns(*_DIRTY_COLUMNS))[0]


@query(f"""
with given as ({_DIRTY.format(text='varchar')})
select c_custkey, c_name, c_mktsegment, balance, nation, concat_ws(',',
  {", ".join(f"case when {rule} then '{name}' end" for name, rule in _BREAKS.items())}) as reasons
from given where {" or ".join(f"({rule})" for rule in _BREAKS.values())}
""")
def conform_quarantine_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not, as they were given, with the rules they break."""
    bad = quarantine(_dirty(spark), columns(*_DIRTY_COLUMNS))[1]
    return bad.withColumn("reasons", F.array_join("reasons", ","))


@query("""
select l_orderkey, l_linenumber, count(*) as copies from lineitem
group by l_orderkey, l_linenumber having count(*) > 1
""")
def unique_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once."""
    rows = ReadContext(spark, {"rows": "select * from lineitem"}).read("rows")
    return unique_violations(rows, ["l_orderkey", "l_linenumber"])


@query("""
select k, count(*) as copies from
  (select case when user_id % 3 = 0 then 0 else nullif(user_id, 1) end as k from events)
where k is not null group by k having count(*) > 1
""")
def unique_key_violations_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key that holds a third of all rows; null keys are distinct."""
    rows = ReadContext(spark, {
        "rows": "select if(user_id % 3 = 0, 0, nullif(user_id, 1)) as k from events"
    }).read("rows")
    return unique_violations(rows, ["k"])
