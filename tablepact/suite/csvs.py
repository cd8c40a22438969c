"""CSV files, written from the test tables and read back under a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.sources.csv import plan_csv, read_csv
from tablepact.suite.registry import columns, fresh_folder, query

_ORDERS = (
    "o_orderkey BIGINT not null", "o_custkey INTEGER", "o_orderstatus CHAR(1)",
    "o_totalprice DOUBLE PRECISION", "o_orderdate TIMESTAMP", "o_orderpriority VARCHAR(15)",
)


def write_csv(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Write rows as CSV files with a header, quoted the RFC 4180 way."""
    folder = fresh_folder(spark, name)
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return folder


@query("""
select o_orderkey, cast(o_custkey as integer) as o_custkey, o_orderstatus, o_totalprice,
       o_orderdate, o_orderpriority from orders
""")
def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table through CSV and back."""
    folder = write_csv(spark, spark.table("orders"), "csv_load")
    return read_csv(spark, folder, columns(*_ORDERS))


@query("""
select o_orderkey, o_orderpriority from orders
""")
def csv_extra_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header columns that are not declared are dropped with a warning."""
    folder = write_csv(spark, spark.table("orders"), "csv_extra_warn")
    return read_csv(spark, folder, columns("o_orderkey BIGINT", "o_orderpriority TEXT"), "warn")


@query("""
select o_orderpriority, o_orderkey, cast(o_totalprice as decimal(12,2)) as o_totalprice from orders
""")
def csv_header_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns are matched by name, in whatever order the header has them."""
    rows = spark.table("orders").select(
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), "o_orderkey", "o_orderpriority"
    )
    folder = write_csv(spark, rows, "csv_header_reordered")
    return read_csv(spark, folder, columns(
        "o_orderpriority VARCHAR(15)", "o_orderkey BIGINT", "o_totalprice NUMERIC(12,2)"
    ))


@query("""
select o_orderkey,
       case o_orderkey % 4 when 0 then '' when 1 then 'NULL' when 2 then 'nan'
            else lpad(cast(o_custkey as varchar), 8, '0') end as word,
       case when o_orderkey % 4 = 3 then o_custkey end as number,
       case when o_orderkey % 4 = 3 then o_totalprice end as price,
       o_orderkey % 4 < 2 as early
from orders
""")
def csv_null_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null spellings stay text in a text column and are null in any other."""
    rows = spark.sql("""
        select o_orderkey,
               case o_orderkey % 4 when 0 then '' when 1 then 'NULL' when 2 then 'nan'
                    else lpad(cast(o_custkey as string), 8, '0') end as word,
               case o_orderkey % 4 when 0 then '' when 1 then 'N/A' when 2 then '#NA'
                    else concat(' ', o_custkey) end as number,
               case o_orderkey % 4 when 0 then 'null' when 1 then '-1.#IND' when 2 then 'NaN'
                    else cast(o_totalprice as string) end as price,
               case o_orderkey % 4 when 0 then '1' when 1 then 'TRUE' when 2 then 'False' else '0' end as early
        from orders""")
    folder = write_csv(spark, rows, "csv_null_rules")
    return read_csv(spark, folder, columns(
        "o_orderkey BIGINT", "word TEXT", "number BIGINT", "price DOUBLE PRECISION", "early BOOLEAN"
    ))


@query("""
select doc_id, lang, text from documents
""")
def csv_multi_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes and line breaks."""
    folder = write_csv(spark, spark.table("documents").select("doc_id", "lang", "text"), "csv_multi_line")
    return read_csv(
        spark, folder, columns("doc_id BIGINT", "lang TEXT", "text TEXT"), multi_line=True
    )


@query("""
select page_id, replace(html, chr(10), ' ') as html from pages
""")
def csv_quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, quoted, one per line, read in splits."""
    rows = spark.table("pages").select("page_id", F.replace("html", F.lit("\n"), F.lit(" ")).alias("html"))
    folder = write_csv(spark, rows, "csv_quoted_text")
    return read_csv(spark, folder, columns("page_id BIGINT", "html TEXT"))


@query("""
select '*' as column_name, 'record' as rule, cast(0 as bigint) as violations from orders having count(*) > 0
union all select 'o_orderkey', 'cast', count(*) filter (where o_orderkey % 6 = 1) from orders
union all select 'price', 'cast', count(*) filter (where o_orderkey % 10 = 3) from orders
union all select 'day', 'cast', count(*) filter (where o_orderkey % 9 = 2) from orders
union all select 'o_orderkey', 'null', count(*) filter (where o_orderkey % 6 = 0) from orders
""")
def csv_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that no declared type accepts, counted over all files in one pass."""
    rows = spark.sql("""
        select case o_orderkey % 6 when 0 then 'NA' when 1 then concat('+', o_orderkey)
                    else cast(o_orderkey as string) end as o_orderkey,
               concat(cast(o_totalprice as decimal(12,2)), if(o_orderkey % 10 = 3, '5', '0')) as price,
               if(o_orderkey % 9 = 2, cast(o_orderdate as string),
                  cast(cast(o_orderdate as date) as string)) as day
        from orders""")
    folder = write_csv(spark, rows, "csv_violations")
    return plan_csv(spark, folder, columns(
        "o_orderkey BIGINT not null", "price NUMERIC(12,2)", "day DATE"
    )).report().select("column_name", "rule", "violations")
