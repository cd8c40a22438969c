"""The single-read gate, the bind check, and the read context."""

import re
from unittest import mock

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tablepact.contract import Column
from tablepact.errors import ReadError, ScriptError
from tablepact.operators import tables as t
from tablepact.sources.ingest import to_dataframe
from tablepact.sources.reads import ReadContext, bind_report, check_binds, ensure_single_read, fetch

ACCEPTED = [
    "select a, b from up", "select * from up", "select a from up where b = 'x;y' order by a limit 10",
    "with c as (select a from up) select a from c", "select a from up union all select a from up2",
    "select a, count(*) from up group by a", "select l.a from up l join up2 r on l.a = r.a", "select 1",
    "VALUES (1), (2)", "select a as x, b as x from up", "select a from up;", "select a from up -- trailing comment",
    "(select a from up)", "select a from up ; ; ", "select a from up except select a from up2",
    "select a, sum(a) over (partition by b) from up", "select a from up left join up2 using (a)",
    "select a from up; -- one comment", "select a from up ; /* two */ ; -- three\n", "-- first\nselect ';' as s from up; -- last",
    "select a from up -- x; y", "select a from up where b = '; -- no comment'",
]
REFUSED = [
    "select 1) AS x; DELETE FROM target; SELECT * FROM (SELECT 1",
    "select 1) AS x; DROP TABLE target; SELECT * FROM (SELECT 1",
    "select 1) AS x JOIN (SELECT 2", "select 1), b AS (select 2",
    "select a from up; delete from up", "delete from up", "insert into up values (1)", "update up set a = 1",
    "drop table up", "create table x (a int)", "truncate table up", "select a from (", "   ", "", ";",
    "select a from up /* open", "up", "show tables", "clear cache", "from up insert into x select a insert into y select a",
    "select 'open", "set spark.x=1", "describe up", "explain select 1", "use db",
    "select a from up; select 1 -- two", "-- nothing\n", "; -- nothing", "select a from up; -- one\n; select 2", "cache table up", "select a from up where b = 'x'; -- more\nselect 1",
]


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    spark.createDataFrame([(1, "x;y"), (2, "z")], "a int, b string").createOrReplaceTempView("up")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("up2")


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, sql):
    ensure_single_read(spark, sql)
    check_binds(spark, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(ValueError, match="read query"):
        ensure_single_read(spark, sql)


def test_shape_is_judged_without_the_catalog(spark):
    ensure_single_read(spark, "select nope from nowhere")
    for sql in ("select nope from nowhere", "select nope from up", "select a + array(1) from up"):
        with pytest.raises(ReadError, match="does not bind"):
            check_binds(spark, sql)


@pytest.mark.parametrize("sql", ["delete from up where a in (" + ", ".join(map(str, range(500))) + ")",
                                 "select a from ( where " + ", ".join(map(str, range(500))), "select a from up; " * 200])
def test_messages_are_bounded_and_quote_the_read(spark, sql):
    with pytest.raises(ValueError) as refused:
        ensure_single_read(spark, sql)
    assert len(str(refused.value)) < 600 and sql[:15] in str(refused.value)


def test_code_outside_the_engine_is_refused(spark):
    with pytest.raises(ReadError, match="command"):
        check_binds(spark, "select transform(a) using 'cat' as (x string) from up")
    with pytest.raises(ReadError, match="Java"):
        check_binds(spark, "select reflect('java.lang.Math', 'abs', a) from up")
    check_binds(spark, "select 'reflects (light)' as t, b as reflect from up")


def test_bind_check_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for _ in range(100):
        check_binds(spark, "select b, count(*) from up group by b")
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_bind_report(spark):
    report = bind_report(spark, {"good": "select a from up", "bad": "select nope from up", "two": "select 1; select 2"})
    assert {r.read: r.ok for r in report.collect()} == {"good": True, "bad": False, "two": False}


def test_fetch(spark):
    assert [r.a for r in fetch(spark, "select a from up where b = 'x;y' order by a limit 10;").collect()] == [1]
    with pytest.raises(ValueError, match=r"duplicate.*\['x'\]"):
        fetch(spark, "select a as x, b as x from up")
    empty = fetch(spark, "select a, b from up where false")
    assert empty.count() == 0 and empty.dtypes == [("a", "int"), ("b", "string")]


def test_context(spark):
    reads = {"one": "select a from up", "bad": "select nope from up", "dup": "select 1 x, 2 x"}
    ctx = ReadContext(spark, reads)
    first = ctx.read("one")
    reads["one"] = "select 'changed' as a"
    reads["late"] = "select 1"
    assert ctx.read("one") is first
    for name in ("late", "other"):
        with pytest.raises(ReadError, match=r"not among the reads.*\['bad', 'dup', 'one'\]"):
            ctx.read(name)
    for name in ("bad", "dup"):
        with pytest.raises(ReadError, match=f"read '{name}' cannot be used"):
            ctx.read(name)


def test_ingest(spark):
    df = spark.range(1)
    assert to_dataframe(spark, df) is df
    table = pa.table({"n": [1, 2], "t": pa.array([0, 1], pa.timestamp("us"))})
    assert to_dataframe(spark, table).schema["t"].dataType == T.TimestampNTZType()
    frame = pd.DataFrame({"n": [1, 2], "t": pd.to_datetime(["2020-01-01", None])}, index=["p", "q"])
    out = to_dataframe(spark, frame)
    assert out.columns == ["n", "t"] and out.schema["t"].dataType == T.TimestampNTZType()

    class Stream:
        def __arrow_c_stream__(self, requested_schema=None):
            return table.__arrow_c_stream__(requested_schema)

    assert to_dataframe(spark, Stream()).count() == 2
    for thing in (object(), [1], {"a": 1}, np.zeros(2), None):
        with pytest.raises(ScriptError, match="expected a dataframe"):
            to_dataframe(spark, thing)


def test_calls_of_java_are_found_in_the_plan(spark):
    call = "('java.util.UUID', 'randomUUID')"
    wide = ", ".join(f"{i} as c{i}" for i in range(40))
    spark.sql(f"create or replace temp view calls_java as select reflect{call} as u")
    refused = [f"select `reflect`{call}", f"select reflect/**/{call}", f"select {wide}, reflect{call} as u", f"select try_reflect{call}",
               "select u from calls_java", f"select 1 where 1 in (select length(java_method{call}))"]
    for query in refused:
        with pytest.raises(ReadError):
            check_binds(spark, query)
    check_binds(spark, "select 'reflect(' as t, '\"class\":\"a.TryReflect\"' as u")


def test_a_read_is_analyzed_once(spark):
    real, texts = spark.sql, []

    def counted(text, *args, **kwargs):
        texts.append(text)
        return real(text, *args, **kwargs)

    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    with mock.patch.object(spark, "sql", counted):
        fetch(spark, "select a from up; -- as written")
        check_binds(spark, "select b from up")
    assert texts == ["select a from up", "select b from up"]
    assert set(tracker.getJobIdsForGroup(None)) == before


EVENTS = (Column("id", "BIGINT", False), Column("ts", "TIMESTAMP"), Column("kind", "VARCHAR(10)"), Column("n", "INTEGER"))
AT = "timestamp'2024-01-0{} 05:00:00'"


@pytest.fixture(scope="module")
def events(spark):
    db = "pruned_db"
    t.drop_schema(spark, db)
    t.ensure_table(spark, db, "e", EVENTS, config={"partitioning": [
        "day(ts)", "month(ts)", "hour(ts)", "kind", "truncate(id, 100)", "truncate(kind, 2)", "bucket(n, 3)", "bucket(id, 2)"], "sorted_by": ["id desc"]})
    t.load(spark, db, "e", spark.range(400).selectExpr(
        "id", "if(id % 50 = 0, null, timestampadd(HOUR, cast(id % 9 * 13 as int), timestamp_ntz'2023-12-30 00:00:00')) as ts",
        "if(id % 7 = 0, '', concat('k', id % 12)) as kind", "cast(nullif(id % 9, 4) as int) as n"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield f"{db}.e"
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    t.drop_schema(spark, db)


def partition_filters(frame):
    return re.findall(r"PartitionFilters: \[(.*?)\], Pushed", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("where,columns", [
    (f"ts < {AT.format(2)}", {"day_ts", "month_ts", "hour_ts"}), (f"{AT.format(2)} <= ts", {"day_ts", "month_ts", "hour_ts"}),
    (f"ts = {AT.format(1)}", {"day_ts", "hour_ts"}), (f"ts between {AT.format(1)} and {AT.format(3)}", {"day_ts"}),
    (f"ts in ({AT.format(1)}, {AT.format(2)})", {"day_ts", "month_ts"}), ("cast(ts as date) = date'2024-01-02'", {"day_ts", "month_ts"}),
    ("cast(ts as date) > date'2024-01-02' and id < 150", {"day_ts", "truncate_100_id"}),
    ("id in (3, 5, 7, 250, 251, 252, 253, 254, 255, 256, 257, 258, 259)", {"truncate_100_id", "bucket_2_id"}),
    ("id = 250", {"truncate_100_id", "bucket_2_id"}), ("kind = ''", {"identity_kind", "truncate_2_kind"}), ("kind >= 'k5'", {"identity_kind", "truncate_2_kind"}),
    ("kind in ('k1', 'k10', '\\'')", {"identity_kind"}), ("n = 5", {"bucket_3_n"}), ("n > 5", set()), ("ts < null", set()), ("ts is null", set()),
    ("id < 10 or ts is null", set()), ("id < 10 or id between 250 and 260", {"truncate_100_id"}), (f"(id < 10 and kind = 'k1') or (ts = {AT.format(1)} and id > 290)", {"truncate_100_id"}), ("id + 1 < 10", set()), ("n <=> 3", {"bucket_3_n"}), ("ts <> timestamp'2024-01-01 00:00:00'", set()), ("id < 7.5", {"truncate_100_id"}),
])
def test_plain_reads_of_partitioned_tables_prune(spark, events, where, columns):
    query = f"select id, ts, kind, n from {events} where {where}"
    frame = fetch(spark, query)
    assert sorted(map(str, frame.collect())) == sorted(map(str, spark.sql(query).collect()))
    told = "".join(partition_filters(frame))
    assert all(f"pact_{c}#" in told for c in columns) and ("pact_" in told) == bool(columns)


def test_bounds_reach_the_scans_they_belong_to(spark, events):
    late, early = f"ts >= {AT.format(3)}", f"ts < {AT.format(1)}"
    for query, pruned in [
        (f"with x as (select * from {events}) select id from x where {late}", 1),
        (f"with x as (select * from {events}) select a.id from x a join x b on a.id = b.id where a.{late}", 0),
        (f"select a.id from {events} a join {events} b on a.id = b.id where a.{late} and b.id < 300", 2),
        (f"select id from {events} where {late} union all select id from {events} where {early}", 2),
        (f"select o.a, e.id from up2 o left join {events} e on o.a = e.id and e.{late}", 1),
        (f"select id from {events} where id in (select id from {events} where {late})", 0),
        (f"select kind, count(*) as n from (select ts as z, kind from {events}) where z >= {AT.format(3)} group by kind having count(*) > 1", 1),
    ]:
        frame = fetch(spark, query)
        assert sum("pact_" in f for f in partition_filters(frame)) == pruned, query
        assert sorted(map(str, frame.collect())) == sorted(map(str, spark.sql(query).collect()))


def test_pruned_reads_follow_the_table(spark, events):
    db, name = events.split(".")
    query = f"select id from {events} where ts < {AT.format(2)} and id < 120"
    held = fetch(spark, query)
    before = sorted(map(tuple, held.collect()))
    t.load(spark, db, name, spark.table(events).where("id >= 100"))
    assert sorted(map(tuple, held.collect())) == before
    assert sorted(map(tuple, fetch(spark, query).collect())) == [r for r in before if r[0] >= 100]
