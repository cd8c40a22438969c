"""Strict casts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.operators.conform import conform, violation_report
from tablepact.sources.reads import ReadContext
from tablepact.suite.registry import columns, query

_LINE = ("l_orderkey BIGINT not null", "l_linenumber INTEGER not null")


def _cast(name: str, sql: str, declared: tuple[str, ...], oracle: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conform(ReadContext(spark, {"rows": sql}).read("rows"), columns(*declared))

    query(oracle, name)(build)


_cast(
    "cast_string_to_int",
    "select l_orderkey, l_linenumber, concat('00', l_partkey) as part, "
    "concat('0x', lower(hex(l_suppkey))) as supp, concat('-', l_linenumber) as line from lineitem",
    (*_LINE, "part BIGINT", "supp INTEGER", "line INTEGER"),
    "select l_orderkey, l_linenumber, l_partkey as part, cast(l_suppkey as integer) as supp, "
    "-l_linenumber as line from lineitem",
)
_cast(
    "cast_string_to_double",
    "select l_orderkey, l_linenumber, cast(l_extendedprice as string) as price, "
    "concat(cast(l_quantity as string), 'e-2') as hundredth, "
    "if(l_linenumber = 1, '-Infinity', concat('+', l_discount)) as rate from lineitem",
    (*_LINE, "price DOUBLE PRECISION", "hundredth DOUBLE PRECISION", "rate DOUBLE PRECISION"),
    "select l_orderkey, l_linenumber, l_extendedprice as price, "
    "cast(cast(l_quantity as varchar) || 'e-2' as double) as hundredth, "
    "case when l_linenumber = 1 then cast('-inf' as double) else l_discount end as rate from lineitem",
)
_cast(
    "cast_string_to_decimal",
    "select l_orderkey, l_linenumber, concat(cast(l_extendedprice as decimal(12,2)), '000') as price, "
    "concat(cast(l_quantity as bigint), 'e-1') as tenth from lineitem",
    (*_LINE, "price NUMERIC(12,2)", "tenth NUMERIC(6,1)"),
    "select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(12,2)) as price, "
    "cast(cast(l_quantity as decimal(10,0)) / 10 as decimal(6,1)) as tenth from lineitem",
)
_cast(
    "cast_string_to_date",
    "select l_orderkey, l_linenumber, substr(cast(l_shipdate as string), 1, 10) as shipped from lineitem",
    (*_LINE, "shipped DATE not null"),
    "select l_orderkey, l_linenumber, cast(l_shipdate as date) as shipped from lineitem",
)
_cast(
    "cast_string_to_timestamp",
    "select event_id, replace(cast(ts as string), ' ', 'T') as ts, "
    "substr(cast(ts as string), 1, 13) as hour from events",
    ("event_id BIGINT not null", "ts TIMESTAMP", "hour TIMESTAMP"),
    "select event_id, ts, date_trunc('hour', ts) as hour from events",
)
_cast(
    "cast_int_widen",
    "select l_orderkey, l_linenumber, l_linenumber as wide, l_partkey as narrow, l_suppkey as number from lineitem",
    (*_LINE, "wide BIGINT", "narrow INTEGER", "number DOUBLE PRECISION"),
    "select l_orderkey, l_linenumber, cast(l_linenumber as bigint) as wide, cast(l_partkey as integer) as narrow, "
    "cast(l_suppkey as double) as number from lineitem",
)
_cast(
    "cast_int_to_decimal",
    "select l_orderkey, l_linenumber, l_linenumber as line, l_partkey as part from lineitem",
    (*_LINE, "line NUMERIC(12,2)", "part NUMERIC(21,2)"),
    "select l_orderkey, l_linenumber, cast(l_linenumber as decimal(12,2)) as line, "
    "cast(l_partkey as decimal(21,2)) as part from lineitem",
)
_cast(
    "cast_decimal_rescale",
    "select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(18,6)) as price, "
    "cast(l_quantity as decimal(10,3)) as quantity, cast(l_tax as decimal(5,2)) as tax, "
    "cast(l_quantity as decimal(10,3)) as whole from lineitem",
    (*_LINE, "price NUMERIC(10,2)", "quantity NUMERIC(4,0)", "tax DOUBLE PRECISION", "whole INTEGER"),
    "select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(10,2)) as price, "
    "cast(l_quantity as decimal(4,0)) as quantity, l_tax as tax, cast(l_quantity as integer) as whole from lineitem",
)
_cast(
    "cast_double_to_int",
    "select l_orderkey, l_linenumber, l_quantity, l_extendedprice * 0 + l_partkey as part from lineitem",
    (*_LINE, "l_quantity INTEGER not null", "part BIGINT"),
    "select l_orderkey, l_linenumber, cast(l_quantity as integer) as l_quantity, l_partkey as part from lineitem",
)
_cast(
    "cast_date_to_timestamp",
    "select o_orderkey, cast(o_orderdate as date) as ordered, cast(o_orderdate as date) as days from orders",
    ("o_orderkey BIGINT not null", "ordered TIMESTAMP", "days INTEGER"),
    "select o_orderkey, cast(o_orderdate as timestamp) as ordered, "
    "cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as integer) as days from orders",
)
_cast(
    "cast_epochs",
    "select event_id, unix_micros(cast(ts as timestamp_ltz)) as moment, ts as micros, "
    "cast(unix_date(cast(ts as date)) as int) as day from events",
    ("event_id BIGINT not null", "moment TIMESTAMP", "micros BIGINT", "day DATE"),
    "select event_id, ts as moment, epoch_us(ts) as micros, cast(ts as date) as day from events",
)
_cast(
    "cast_zoned_timestamp",
    "select event_id, cast(ts as timestamp_ltz) as wall, cast(ts as timestamp_ltz) as written, "
    "cast(ts as timestamp_ltz) as micros from events",
    ("event_id BIGINT not null", "wall TIMESTAMP", "written TEXT", "micros BIGINT"),
    "select event_id, ts as wall, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || 'Z' as written, "
    "epoch_us(ts) as micros from events",
)
_cast(
    "cast_boolean",
    "select o_orderkey, o_orderstatus = 'F' as kept, o_orderstatus = 'F' as number, "
    "o_orderstatus = 'F' as rate, o_orderstatus = 'F' as word from orders",
    ("o_orderkey BIGINT not null", "kept BOOLEAN not null", "number INTEGER", "rate DOUBLE PRECISION", "word TEXT"),
    "select o_orderkey, o_orderstatus = 'F' as kept, cast(o_orderstatus = 'F' as integer) as number, "
    "cast(cast(o_orderstatus = 'F' as integer) as double) as rate, cast(o_orderstatus = 'F' as varchar) as word from orders",
)
_cast(
    "cast_void",
    "select o_orderkey, null as n, null as t, null as d, null as m from orders",
    ("o_orderkey BIGINT not null", "n INTEGER", "t VARCHAR(3)", "d DATE", "m NUMERIC(9,2)"),
    "select o_orderkey, cast(null as integer) as n, cast(null as varchar) as t, cast(null as date) as d, "
    "cast(null as decimal(9,2)) as m from orders",
)
_cast(
    "cast_to_text",
    "select l_orderkey, l_linenumber, l_partkey as whole, l_extendedprice as price, "
    "l_quantity * 1e10 as large, l_linenumber * 1e-7 as small, cast(l_tax as decimal(5,2)) as tax, "
    "l_shipdate as moment, cast(l_shipdate as date) as day, l_quantity > 10 as many, "
    "cast(l_returnflag as binary) as bytes from lineitem",
    (*_LINE, *(f"{n} TEXT" for n in
               ("whole", "price", "large", "small", "tax", "moment", "day", "many", "bytes"))),
    """
select l_orderkey, l_linenumber, cast(l_partkey as varchar) as whole,
       regexp_replace(cast(cast(l_extendedprice as decimal(18,2)) as varchar), '\\.?0+$', '') as price,
       case when l_quantity < 10 then cast(cast(l_quantity as integer) as varchar) || 'e+10'
            when cast(l_quantity as integer) % 10 = 0
                 then cast(cast(l_quantity as integer) // 10 as varchar) || 'e+11'
            else cast(cast(l_quantity as integer) // 10 as varchar) || '.'
                 || cast(cast(l_quantity as integer) % 10 as varchar) || 'e+11' end as large,
       cast(l_linenumber as varchar) || 'e-7' as small,
       cast(cast(l_tax as decimal(5,2)) as varchar) as tax,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') as moment,
       strftime(l_shipdate, '%Y-%m-%d') as day,
       cast(l_quantity > 10 as varchar) as many, l_returnflag as bytes
from lineitem
""",
)

# The same text in many spellings, most of which some type refuses.
_SPELLINGS = """
case l_linenumber % 7
  when 0 then concat('+', cast(l_partkey as {text}))
  when 1 then concat(' ', cast(l_partkey as {text}))
  when 2 then concat(cast(l_partkey as {text}), '.0')
  when 3 then concat(cast(l_partkey as {text}), 'e2')
  when 4 then concat(cast(l_partkey as {text}), '.125')
  when 5 then cast(l_partkey as {text})
  else concat(cast(l_partkey as {text}), 'd') end
"""


@query(f"""
with given as (select {_SPELLINGS.format(text='varchar')} as t from lineitem)
select 'as_int' as column_name, 'cast' as rule,
       count(*) filter (where not regexp_full_match(t, '-?[0-9]+')) as violations from given
union all
select 'as_double', 'cast',
       count(*) filter (where not regexp_full_match(t, '[+-]?[0-9]+([.][0-9]*)?(e[0-9]+)?')) from given
union all
select 'as_decimal', 'cast',
       count(*) filter (where not regexp_full_match(t, '[+-]?[0-9]+([.][0-9]{{0,2}}0*)?(e[0-9]+)?')) from given
""")
def cast_text_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spellings each numeric type refuses."""
    given = ReadContext(spark, {
        "given": f"select {_SPELLINGS.format(text='string')} as t from lineitem"
    }).read("given")
    spelled = given.select(*[F.col("t").alias(n) for n in ("as_int", "as_double", "as_decimal")])
    return violation_report(spelled, columns(
        "as_int BIGINT", "as_double DOUBLE PRECISION", "as_decimal NUMERIC(20,2)"
    )).select("column_name", "rule", "violations")
