"""Fingerprints of values, rows, groups and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.functions.digests import byte_hash, fold, record_hash, text_hash
from tablepact.operators import tables as t
from tablepact.operators.fingerprints import (
    LIMB_DIGITS, LIMBS, Ranges, array_fold, changed_keys, differing_leaves, fold_tree, group_fold,
    partition_width, snapshot_changes,
)
from tablepact.suite.registry import columns, fresh_schema, query

_ALTERED = """
select doc_id, case when doc_id % 10 = 1 then concat(text, ' .') else text end as text, lang, source
from documents where doc_id % 7 <> 0
union all
select doc_id + 1000000000, text, lang, source from documents where doc_id % 5 = 0
"""


@query("""
select doc_id, sha256(text) as digest from documents
""")
def fingerprint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table("documents").select("doc_id", byte_hash(F.col("text")).alias("digest"))


@query(r"""
select doc_id, sha256(trim(regexp_replace(text,
  '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',
  ' ', 'g'))) as digest from documents
""")
def fingerprint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table("documents").select("doc_id", text_hash(F.col("text")).alias("digest"))


def _fold_sql(table: str, key: str, member: str) -> str:
    """The sums of the limbs of all members' digests, hashed with their number."""
    sums = " || ',' || ".join(f"sum(('0x' || substr(d, {1 + i * LIMB_DIGITS}, {LIMB_DIGITS}))::bigint)::varchar" for i in range(LIMBS))
    return f"""
    select {key}, count(d) as members, sha256(count(d)::varchar || ',' || {sums}) as fold
    from (select {key}, sha256({member}) as d from {table}) group by {key}"""


@query("""
select doc_id, sha256(array_to_string(list_sort(list_transform(string_split(text, chr(10)), lambda x: sha256(x))), '')) as fold
from documents
""")
def fingerprint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return spark.table("documents").select("doc_id", array_fold(lines).alias("fold"))


@query(_fold_sql("conversations", "conv_id", "text"))
def fingerprint_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_fold(spark.table("conversations"), ["conv_id"], F.col("text"))


@query(_fold_sql("lineitem", "l_returnflag", "concat(l_orderkey, '/', l_linenumber)"))
def fingerprint_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups that hold all rows, many of them copies."""
    member = F.concat_ws("/", "l_orderkey", "l_linenumber")
    return group_fold(spark.table("lineitem"), ["l_returnflag"], member)


@query("""
select doc_id, 'sha256:' || sha256(sha256(text) || '|' || lang || '|' || source) as fold from documents
""")
def fingerprint_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table("documents").select(
        "doc_id", fold(byte_hash(F.col("text")), F.col("lang"), F.col("source")).alias("fold")
    )


@query("""
select c_custkey, sha256('{"c_acctbal":' || cast(c_acctbal as varchar) || ',"c_custkey":' || cast(c_custkey as varchar)
  || ',"c_mktsegment":' || coalesce('"' || nullif(c_mktsegment, 'BUILDING') || '"', 'null')
  || ',"c_name":"' || c_name || '"}') as digest
from customer
""")
def fingerprint_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(
        "select c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, c_nationkey from customer"
    )
    return rows.select("c_custkey", record_hash(rows.schema, exclude=["c_nationkey"]).alias("digest"))


@query(f"""
with new as ({_ALTERED})
select coalesce(o.doc_id, n.doc_id) as doc_id,
       case when o.doc_id is null then 'added' when n.doc_id is null then 'removed'
            when o.text = n.text and o.lang = n.lang and o.source = n.source then 'unchanged'
            else 'changed' end as status
from documents o full outer join new n on o.doc_id = n.doc_id
""")
def snapshot_changes_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.table("documents").select("doc_id", "text", "lang", "source")
    return snapshot_changes(old, spark.sql(_ALTERED), ["doc_id"])


@query("""
with old as (select user_id, event_type, count(*) as n from events group by user_id, event_type),
new as (select user_id, event_type, count(*) as n from events
        where not (user_id % 5 = 0 and event_type = 'error') group by user_id, event_type),
kept as (select user_id, count(*) as kinds, sum(n) as n from old group by user_id),
left_over as (select user_id, count(*) as kinds, sum(n) as n from new group by user_id)
select k.user_id, case when l.user_id is null then 'removed'
  when k.n = l.n then 'unchanged' else 'changed' end as status
from kept k left join left_over l on k.user_id = l.user_id
""")
def snapshot_changes_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with many rows each: compared as multisets."""
    old = spark.sql("select user_id, event_type from events")
    new = old.where("not (user_id % 5 = 0 and event_type = 'error')")
    return snapshot_changes(old, new, ["user_id"])


_RESTATED = """
select o_orderkey, o_totalprice + case when o_orderkey between 1200 and 1300 and o_orderkey % 3 = 0 then 1 else 0 end as o_totalprice, o_orderstatus
from orders where o_orderkey not between 1310 and 1320
"""


@query(f"""
with new as ({_RESTATED})
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when n.o_orderkey is null then 'removed' else 'changed' end as status,
       1 as n_leaves, 1 as n_partitions_read
from orders o left join new n on o.o_orderkey = n.o_orderkey where n.o_orderkey is null or n.o_totalprice <> o.o_totalprice
""")
def snapshot_changes_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table that differ in one range of keys: only that range's partition is read again."""
    db, ranges = fresh_schema(spark, "changes_by_ranges"), Ranges("o_orderkey", 1000)
    declared = columns("o_orderkey BIGINT not null", "o_totalprice DOUBLE PRECISION", "o_orderstatus CHAR(1)")
    width = partition_width(spark.table("orders"), ranges)
    t.ensure_table(spark, db, "orders", declared, config={"partitioning": [f"truncate(o_orderkey, {width})"]})
    snapshots, trees = [], []
    for k, sql in enumerate(("select o_orderkey, o_totalprice, o_orderstatus from orders", _RESTATED)):
        t.load(spark, db, "orders", spark.sql(sql))
        snapshots.append(t.read_version(spark, db, "orders", t.describe(spark, db, "orders").version))
        fold_tree(snapshots[-1], ranges).write.saveAsTable(f"{db}.orders_tree_{k}")
        trees.append(spark.table(f"{db}.orders_tree_{k}"))
    leaves = differing_leaves(*trees, ranges).count()
    found = changed_keys(*snapshots, ["o_orderkey"], ranges, *trees)
    read = {file.rsplit("/", 2)[1] for file in found.inputFiles() if "pact_truncate" in file}
    return found.select("o_orderkey", "status", F.lit(leaves).alias("n_leaves"), F.lit(len(read)).alias("n_partitions_read"))
