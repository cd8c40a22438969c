"""Empty builds, replacement of contents, physical layouts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.errors import LoadError
from tablepact.operators import tables as t
from tablepact.operators.layout import parse_layout, write_table
from tablepact.sources.reads import ReadContext
from tablepact.suite.registry import columns, fresh_schema, query

_ORDERS = columns(
    "o_orderkey BIGINT not null", "o_orderstatus CHAR(1)", "o_totalprice DOUBLE PRECISION"
)
_HALF = "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 2 = {odd}"
_EVENTS = columns(
    "event_id BIGINT not null", "ts TIMESTAMP not null", "user_id BIGINT",
    "event_type VARCHAR(8)", "value DOUBLE PRECISION",
)
_EVENT_ROWS = "select event_id, ts, user_id, event_type, value from events"


@query("""
select l_orderkey, l_partkey * 2 as twice, l_returnflag from lineitem
""")
def empty_from_sql_then_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table shaped by a query, built empty, then filled by the same query."""
    db = fresh_schema(spark, "empty_from_sql")
    sql = "select l_orderkey, l_partkey * 2 as twice, l_returnflag from lineitem;"
    t.build_empty_from_sql(spark, db, "lines", sql)
    t.build_empty_from_sql(spark, db, "lines", sql)
    built = spark.table(f"{db}.lines")
    t.ensure_table(spark, db, "filled", columns("l_orderkey BIGINT", "twice BIGINT", "l_returnflag TEXT"))
    t.load(spark, db, "filled", spark.sql(sql.rstrip(";")))
    return built.unionByName(spark.table(f"{db}.filled"))


@query("""
select cast(o_orderkey as integer) as id, o_orderpriority as email, cast(o_totalprice as decimal(10,2)) as amount
from orders
""")
def empty_from_columns_then_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed empty table with constraints and a layout, then filled."""
    db = fresh_schema(spark, "empty_from_columns")
    t.build_empty_from_columns(
        spark, db, "orders",
        columns("id INTEGER not null", "email VARCHAR(255)", "amount NUMERIC(10,2)"),
        {"unique": [["id"]], "sorted_by": ["id"]},
    )
    t.load(spark, db, "orders", spark.sql(
        "select o_orderkey as id, o_orderpriority as email, cast(o_totalprice as decimal(10,2)) as amount from orders"
    ))
    return spark.table(f"{db}.orders")


@query("""
select event_id, ts, user_id, event_type, value from events
""")
def clone_empty_then_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty copy of a loaded table in a candidate schema, with its rules, then filled."""
    db, candidate = fresh_schema(spark, "clone_prod"), fresh_schema(spark, "clone_candidate")
    t.ensure_table(spark, db, "events", _EVENTS, config={"partitioning": ["event_type"]})
    t.load(spark, db, "events", spark.sql(_EVENT_ROWS))
    t.clone_empty_from_prod(spark, candidate, db, "events")
    empty = spark.table(f"{candidate}.events").count()
    t.load(spark, candidate, "events", spark.table(f"{db}.events"))
    return spark.table(f"{candidate}.events").where(F.lit(empty == 0))


@query("""
select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 1
""")
def replace_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of a table replaced by the other."""
    db = fresh_schema(spark, "replace_load")
    t.ensure_table(spark, db, "orders", _ORDERS)
    for odd in (0, 1):
        t.load(spark, db, "orders", spark.sql(_HALF.format(odd=odd)))
    return spark.table(f"{db}.orders")


@query("""
select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice < 0
""")
def replace_load_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced by nothing: an empty table."""
    db = fresh_schema(spark, "replace_load_empty")
    t.ensure_table(spark, db, "orders", _ORDERS)
    t.load(spark, db, "orders", spark.sql(_HALF.format(odd=0)))
    t.load(spark, db, "orders", spark.sql(_HALF.format(odd=0) + " and o_totalprice < 0"))
    return spark.table(f"{db}.orders")


def _refused(spark: SparkSession, db: str, table: str, sql: str) -> bool:
    try:
        t.load(spark, db, table, spark.sql(sql))
    except LoadError:
        return True
    return False


@query("""
select o_orderkey, o_orderstatus, o_totalprice, 3 as refused from orders where o_orderkey % 2 = 0
""")
def replace_failed_keeps_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null, a text too long and a repeated key: each load fails, the rows stay."""
    db = fresh_schema(spark, "replace_failed")
    t.ensure_table(spark, db, "orders", _ORDERS, config={"unique": [["o_orderkey"]]})
    t.load(spark, db, "orders", spark.sql(_HALF.format(odd=0)))
    refused = sum(_refused(spark, db, "orders", sql) for sql in (
        "select nullif(o_orderkey, 5) as o_orderkey, o_orderstatus, o_totalprice from orders",
        "select o_orderkey, if(o_orderkey = 7, 'OO', o_orderstatus) as o_orderstatus, o_totalprice from orders",
        "select o_custkey as o_orderkey, o_orderstatus, o_totalprice from orders",
    ))
    return spark.table(f"{db}.orders").withColumn("refused", F.lit(refused))


def _laid_out(spark: SparkSession, name: str, config: dict) -> str:
    db = fresh_schema(spark, name)
    t.ensure_table(spark, db, "events", _EVENTS, config=config)
    t.load(spark, db, "events", spark.sql(_EVENT_ROWS))
    return db


@query("""
select cast(ts as date) as day, count(*) as n_events, count(distinct user_id) as n_users from events group by 1
""")
def layout_day_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned by day, sorted by id."""
    db = _laid_out(spark, "layout_day", {"partitioning": ["day(ts)"], "sorted_by": ["event_id"]})
    return spark.table(f"{db}.events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users")
    )


@query("""
select event_id, ts, user_id, event_type, value from events
where ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-09 18:00:00'
""")
def layout_partition_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of time that reads only the days it touches."""
    db = _laid_out(spark, "layout_slice", {"partitioning": ["day(ts)"]})
    return t.read_slice(
        spark, db, "events", "ts",
        F.lit(dt.datetime(2024, 1, 5, 6)), F.lit(dt.datetime(2024, 1, 9, 18)),
    )


@query("""
select a.event_id, a.user_id, b.n_events from events a
join (select user_id, count(*) as n_events from events group by user_id) b on a.user_id = b.user_id
""")
def layout_bucket_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed by user: counting per user and joining back shuffles nothing."""
    db = _laid_out(spark, "layout_bucket", {"partitioning": ["bucket(user_id, 16)"], "sorted_by": ["user_id"]})
    events = spark.table(f"{db}.events")
    counts = events.groupBy("user_id").agg(F.count("*").alias("n_events"))
    return events.join(counts, "user_id").select("event_id", "user_id", "n_events")


@query("""
select event_id, ts, user_id, event_type, value from events
""")
def layout_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as ORC, by type and hour, newest first, looked up by id."""
    db = _laid_out(spark, "layout_orc", {
        "format": "ORC", "partitioning": ["event_type"], "sorted_by": ["ts DESC NULLS LAST"],
        "indexes": [{"columns": ["event_id"], "unique": True}],
    })
    return spark.table(f"{db}.events")


@query("""
select event_type, extract('month' from ts) as month, count(*) as n_events, min(event_id) as first_id
from events group by event_type, extract('month' from ts)
""")
def layout_many_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month, truncated text and a descending sort within a bucket."""
    db = _laid_out(spark, "layout_many", {
        "partitioning": ["month(ts)", "truncate(event_type, 2)", "bucket(user_id, 4)"],
        "sorted_by": ["value desc", "event_id"],
    })
    return spark.table(f"{db}.events").groupBy(
        "event_type", F.month("ts").cast("bigint").alias("month")
    ).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_id"))


@query("""
select event_id, user_id, value, true as pruned from events
where ts >= timestamp '2024-01-10 06:00:00' and ts < timestamp '2024-01-12 00:00:00' and event_type in ('click', 'view')
""")
def read_prunes_derived_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared read whose conditions on the columns become bounds on days and types."""
    db = _laid_out(spark, "read_prunes", {"partitioning": ["day(ts)", "event_type"]})
    found = ReadContext(spark, {"some": f"""
        select event_id, user_id, value from {db}.events where ts >= timestamp'2024-01-10 06:00:00'
        and ts < timestamp'2024-01-12 00:00:00' and event_type in ('click', 'view') -- two days, two types
    """}).read("some")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    bounds = [line for line in plan.splitlines() if "Filter" in line and "pact_day_ts" in line and "pact_identity_event_type" in line]
    return found.withColumn("pruned", F.lit(len(bounds) == 1))


@query("""
select 'held' as rows_of, o_orderkey, o_totalprice, 2 as n_versions, 1 as n_left from orders where o_orderkey % 2 = 0
union all
select 'current', o_orderkey, o_totalprice, 2, 1 from orders where o_orderkey % 2 = 1
""")
def reader_outlives_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader planned before a load reads on; vacuum then leaves the current version alone."""
    db = fresh_schema(spark, "reader_outlives")
    t.ensure_table(spark, db, "orders", _ORDERS)
    at_once = dt.timedelta(0)
    t.load(spark, db, "orders", spark.sql(_HALF.format(odd=0)), at_once)
    held = spark.table(f"{db}.orders")
    t.load(spark, db, "orders", spark.sql(_HALF.format(odd=1)))
    versions = t.history(spark, db, "orders").count()
    # What the reader sees after the load is kept in a table of its own.
    held.select("o_orderkey", "o_totalprice").write.saveAsTable(f"{db}.held")
    t.vacuum(spark, db, "orders", at_once)
    left = t.history(spark, db, "orders").count()
    both = spark.table(f"{db}.held").withColumn("rows_of", F.lit("held")).unionByName(
        spark.table(f"{db}.orders").select("o_orderkey", "o_totalprice", F.lit("current").alias("rows_of")))
    return both.withColumns({"n_versions": F.lit(versions), "n_left": F.lit(left)})


def _made_elsewhere(spark: SparkSession, db: str, table: str, odd: int) -> None:
    spark.sql(f"create table {db}.{table} (o_orderkey bigint not null, o_orderstatus varchar(1), o_totalprice double) using parquet")
    spark.sql(f"insert into {db}.{table} {_HALF.format(odd=odd)}")


_PLAIN_ORDERS = columns("o_orderkey BIGINT not null", "o_orderstatus VARCHAR(1)", "o_totalprice DOUBLE PRECISION")


@query("""
select 'completed' as outcome, o_orderkey, o_totalprice from orders where o_orderkey % 2 = 1
union all
select 'undone', o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0
""")
def interrupted_move_is_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers that stop between the two steps of a first load; the next call settles each move."""
    db, parts = fresh_schema(spark, "interrupted_move"), []
    for table, lost in (("whole", False), ("lost", True)):
        _made_elsewhere(spark, db, table, 0)
        t.declare_rules(spark, db, table, _PLAIN_ORDERS)
        version = t._new_version(table)
        write_table(spark.sql(_HALF.format(odd=1)), f"{db}.{version}", parse_layout(None, _PLAIN_ORDERS))
        statement = f"create or replace view {db}.{table} as select * from {db}.{version}"
        t.announce_move(spark, db, table, version, statement)
        if lost:
            spark.sql(f"drop table {db}.{version}")
        outcome = t.recover(spark, db, table)
        parts.append(spark.table(f"{db}.{table}").select(F.lit(outcome).alias("outcome"), "o_orderkey", "o_totalprice"))
    return parts[0].unionByName(parts[1])


@query("""
select o_orderkey, o_orderstatus, o_totalprice, 4 as refused from orders where o_orderkey % 2 = 1
""")
def rules_of_a_table_made_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT NULL of a plain table: loads and clones are refused until it is stated, and so is a null afterwards."""
    db = fresh_schema(spark, "stated_rules")
    _made_elsewhere(spark, db, "orders", 0)
    with_null = "select nullif(o_orderkey, 5) as o_orderkey, o_orderstatus, o_totalprice from orders"
    refused = _refused(spark, db, "orders", with_null) + _refused(spark, db, "orders", _HALF.format(odd=1))
    try:
        t.clone_empty_from_prod(spark, db, db, "orders")
    except LoadError:
        refused += 1
    t.declare_rules(spark, db, "orders", _PLAIN_ORDERS)
    refused += _refused(spark, db, "orders", with_null)
    t.load(spark, db, "orders", spark.sql(_HALF.format(odd=1)))
    return spark.table(f"{db}.orders").withColumn("refused", F.lit(refused))
