"""Read shapes: every read goes through the gate and the read context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.operators.conform import conform
from tablepact.sources.ingest import to_dataframe
from tablepact.sources.reads import ReadContext, bind_report
from tablepact.suite.registry import columns, query


def _read(sql: str, oracle: str | None = None, name: str = "") -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ReadContext(spark, {"rows": sql}).read("rows")

    query(oracle or sql, name)(build)


_read("select o_orderkey, o_totalprice from orders", name="read_project")
_read("select * from customer", name="read_star")
_read(
    "select o_orderkey, o_totalprice from orders where o_orderpriority <> 'a;b' "
    "order by o_totalprice desc, o_orderkey limit 100",
    name="read_filter_order_limit",
)
_read(
    "with big as (select o_custkey, o_totalprice from orders where o_totalprice > 250000) "
    "select o_custkey, count(*) as n_orders, max(o_totalprice) as top from big group by o_custkey",
    name="read_cte",
)
_read(
    "select c_custkey as key, c_acctbal as balance from customer "
    "union all select s_suppkey, s_acctbal from supplier",
    name="read_union_all",
)
_read(
    "select o_orderpriority, count(*) as n_orders from orders group by o_orderpriority",
    name="read_group_count",
)
_read(
    "select l.l_orderkey, l.l_linenumber, o.o_orderdate from lineitem l "
    "join orders o on l.l_orderkey = o.o_orderkey",
    name="read_join",
)
_read(
    "select o.o_orderkey, c.c_name from orders o left join "
    "(select c_custkey, c_name from customer where c_mktsegment = 'BUILDING') c "
    "on o.o_custkey = c.c_custkey",
    name="read_left_join",
)
_read(
    "select l_orderkey, l_quantity from lineitem where l_quantity > 45;",
    "select l_orderkey, l_quantity from lineitem where l_quantity > 45",
    name="read_trailing_semicolon",
)
_read(
    "select l_returnflag, count(*) as n from lineitem group by l_returnflag -- per flag; done",
    "select l_returnflag, count(*) as n from lineitem group by l_returnflag",
    name="read_trailing_comment",
)
_read("select o_orderkey, o_orderstatus from orders where o_totalprice < 0", name="read_zero_rows")


@query("""
select o_orderkey, o_orderstatus, 1 as is_open from orders where o_orderstatus = 'O'
""")
def read_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FROM-less read beside a read of a table."""
    ctx = ReadContext(spark, {
        "flag": "select 'O' as o_orderstatus, 1 as is_open",
        "orders": "select o_orderkey, o_orderstatus from orders",
    })
    return ctx.read("orders").join(ctx.read("flag"), "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "is_open"
    )


@query("""
select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')
""")
def read_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VALUES read beside a read of a table."""
    ctx = ReadContext(spark, {
        "wanted": "VALUES ('F'), ('P')",
        "orders": "select o_orderkey, o_orderstatus from orders",
    })
    wanted = ctx.read("wanted").toDF("o_orderstatus")
    return ctx.read("orders").join(wanted, "o_orderstatus", "left_semi").select(
        "o_orderkey", "o_orderstatus"
    )


@query("""
select a.o_custkey, a.n_orders, b.n_open
from (select o_custkey, count(*) as n_orders from orders group by o_custkey) a
join (select o_custkey, count(*) as n_open from orders where o_orderstatus = 'O'
      group by o_custkey) b on a.o_custkey = b.o_custkey
""")
def read_memoized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read used twice is resolved once."""
    ctx = ReadContext(spark, {"orders": "select o_custkey, o_orderstatus from orders"})
    first, again = ctx.read("orders"), ctx.read("orders")
    everyone = first.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    is_open = again.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n_open"))
    return everyone.join(is_open, "o_custkey")


@query("""
select 'big_orders' as read_name, true as ok, (select count(*) from orders where o_totalprice > 100000) as n_rows
union all select 'no_column', false, cast(null as bigint)
union all select 'returned', true, (select count(*) from lineitem where l_returnflag = 'R')
union all select 'two_statements', false, cast(null as bigint)
""")
def bind_check_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind report of a set of reads, with the row counts of those that bind."""
    reads = {
        "big_orders": "select o_orderkey from orders where o_totalprice > 100000",
        "returned": "select l_orderkey from lineitem where l_returnflag = 'R'",
        "no_column": "select o_nothing from orders",
        "two_statements": "select 1; select 2",
    }
    report = bind_report(spark, reads).select(F.col("read").alias("read_name"), "ok")
    ctx = ReadContext(spark, reads)
    counts = ctx.read("big_orders").agg(F.count("*").alias("n_rows")).withColumn(
        "read_name", F.lit("big_orders")
    ).unionByName(
        ctx.read("returned").agg(F.count("*").alias("n_rows")).withColumn("read_name", F.lit("returned"))
    )
    return report.join(counts, "read_name", "left").select("read_name", "ok", "n_rows")


@query("""
select cast(n.n_nationkey as integer) as nation_key, count(*) as n_customers,
       cast(sum(cast(c_acctbal as decimal(12,2))) as decimal(14,2)) as balance
from customer c join nation n on c.c_nationkey = n.n_nationkey group by n.n_nationkey
""")
def ingest_small_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that user code holds as pandas: one row per nation."""
    ctx = ReadContext(spark, {
        "customers": "select c_nationkey, cast(c_acctbal as decimal(12,2)) as bal from customer"
    })
    held = ctx.read("customers").groupBy(F.col("c_nationkey").alias("nation_key")).agg(
        F.count("*").alias("n_customers"), F.sum("bal").cast("decimal(14,2)").alias("balance")
    ).toPandas()
    return conform(to_dataframe(spark, held.set_index(held.nation_key)), columns(
        "nation_key INTEGER not null", "n_customers BIGINT not null", "balance NUMERIC(14,2)"
    ))
