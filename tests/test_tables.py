"""Empty builds, atomic replacement, layouts, and their failures."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D
from unittest import mock

import pytest
from pyspark.sql import functions as F

from tablepact.contract import Column
from tablepact.errors import ContractError, LoadError, ReadError
from tablepact.operators import tables as t
from tablepact.operators.layout import parse_layout

PLAIN = (Column("id", "INTEGER"), Column("name", "TEXT"))
AT_ONCE = dt.timedelta(0)


@pytest.fixture
def db(spark, request):
    name = "db_" + request.node.name.replace("[", "_").replace("]", "_").replace("-", "_").lower()[:40]
    t.drop_schema(spark, name)
    t.ensure_schema(spark, name)
    yield name
    t.drop_schema(spark, name)


def rows(spark, db, table):
    return sorted(tuple(r) for r in spark.table(f"{db}.{table}").collect())


def names(spark, db):
    return sorted(x.name for x in spark.catalog.listTables(db) if not x.isTemporary)


def test_replace(spark, db):
    t.ensure_table(spark, db, "t", PLAIN)
    assert rows(spark, db, "t") == []
    t.load(spark, db, "t", spark.range(40, 43).selectExpr("cast(id as int) as id", "hex(id) as name"))
    assert t.load(spark, db, "t", spark.range(60, 62).selectExpr("concat('n', id) as name", "cast(id as int) as id"), AT_ONCE) == 2
    assert rows(spark, db, "t") == [(60, "n60"), (61, "n61")]
    assert len(names(spark, db)) == 2  # the table and its one version
    # From itself, and by nothing.
    assert t.load(spark, db, "t", spark.table(f"{db}.t").where("id = 60")) == 1
    assert rows(spark, db, "t") == [(60, "n60")]
    assert t.load(spark, db, "t", spark.table(f"{db}.t").where("id = 100")) == 0
    assert t.load(spark, db, "t", spark.createDataFrame([], "id int, name string")) == 0
    assert t.load(spark, db, "t", spark.range(5).where("false").selectExpr("cast(id as int) id", "'a' name")) == 0
    assert rows(spark, db, "t") == []


@pytest.mark.parametrize("bad,message", [
    ([(None, "DE")], "contains nulls"), ([(1, "Deutschland")], "value length 11 exceeds"),
    ([(2, "DE"), (2, "FR")], "duplicate key"),
])
def test_failed_replace_keeps_the_old_rows(spark, db, bad, message):
    columns = (Column("nation", "INTEGER", False), Column("code", "VARCHAR(3)"))
    t.ensure_table(spark, db, "t", columns, config={"unique": [["nation"]]})
    t.load(spark, db, "t", spark.createDataFrame([(1, "ES"), (5, None)], "nation int, code string"))
    before = names(spark, db)
    with pytest.raises(LoadError, match=message):
        t.load(spark, db, "t", spark.createDataFrame(bad, "nation int, code string"))
    assert rows(spark, db, "t") == [(1, "ES"), (5, None)]
    assert names(spark, db) == before


def test_failure_while_running_or_publishing(spark, db):
    t.ensure_table(spark, db, "t", PLAIN)
    t.load(spark, db, "t", spark.createDataFrame([(1, "a")], "id int, name string"))
    before = names(spark, db)
    boom = spark.range(3).select(F.col("id").cast("int").alias("id"), F.raise_error(F.lit("boom")).cast("string").alias("name"))
    with pytest.raises(LoadError, match="boom"):
        t.load(spark, db, "t", boom)
    real = spark.sql
    def refuse_view(text, *a, **k):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("catalog down")
        return real(text, *a, **k)
    with mock.patch.object(spark, "sql", refuse_view), pytest.raises(LoadError, match="catalog down"):
        t.load(spark, db, "t", spark.createDataFrame([(2, "b")], "id int, name string"))
    assert rows(spark, db, "t") == [(1, "a")]
    assert names(spark, db) == before


def test_plain_table_is_taken_over_or_recovered(spark, db):
    spark.createDataFrame([(1, "a")], "id int, name string").write.saveAsTable(f"{db}.t")
    t.declare_rules(spark, db, "t", PLAIN)
    real = spark.sql
    def refuse_view(text, *a, **k):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("catalog down")
        return real(text, *a, **k)
    with mock.patch.object(spark, "sql", refuse_view), pytest.raises(LoadError, match="catalog down"):
        t.load(spark, db, "t", spark.createDataFrame([(2, "b")], "id int, name string"))
    assert rows(spark, db, "t") == [(1, "a")] and names(spark, db) == ["t"]
    t.load(spark, db, "t", spark.createDataFrame([(2, "b")], "id int, name string"))
    assert rows(spark, db, "t") == [(2, "b")]
    assert len(t.vacuum(spark, db, keep_for=AT_ONCE)) == 1  # the table that was moved aside
    assert len(names(spark, db)) == 2


def test_neighbours_are_untouched(spark, db):
    for name, value in (("orders__stage", 777), ("orders__old", 888), ("orders__v", 999)):
        spark.createDataFrame([(value,)], "id int").write.saveAsTable(f"{db}.{name}")
    t.ensure_table(spark, db, "orders", (Column("id", "INTEGER"),))
    t.load(spark, db, "orders", spark.createDataFrame([(1,)], "id int"))
    assert [rows(spark, db, n)[0][0] for n in ("orders", "orders__stage", "orders__old", "orders__v")] == [1, 777, 888, 999]


def test_ensure_table_is_idempotent_and_checks_first(spark, db):
    columns = (Column("id", "BIGINT", False), Column("label", "VARCHAR(10)"), Column("amount", "NUMERIC(10,2)", False))
    t.ensure_table(spark, db, "t", columns)
    t.load(spark, db, "t", spark.sql("select 1L id, 'a' label, cast(1.5 as decimal(10,2)) amount"))
    t.ensure_table(spark, db, "t", (Column("other", "TEXT"),), config={"format": "orc"})
    assert rows(spark, db, "t") == [(1, "a", D("1.50"))]
    assert t.describe(spark, db, "t").columns == columns
    before = names(spark, db)
    with pytest.raises(ContractError):
        t.ensure_table(spark, db, "u", (Column("id", "FLOAT"),))
    with pytest.raises(ValueError, match="index"):
        t.ensure_table(spark, db, "u", columns, config={"index": []})
    assert names(spark, db) == before


def test_empty_builds(spark, db):
    columns = (Column("id", "INTEGER", False), Column("email", "VARCHAR(255)"), Column("amount", "NUMERIC(10,2)"))
    t.build_empty_from_columns(spark, db, "t", columns, {"unique": [["id"]]})
    t.load(spark, db, "t", spark.createDataFrame([(1, "a", D("1.00"))], "id int, email string, amount decimal(10,2)"))
    t.ensure_schema(spark, db + "_c")
    t.clone_empty_from_prod(spark, db + "_c", db, "t")
    state = t.describe(spark, db + "_c", "t")
    assert state.columns == columns and state.config == {"unique": [["id"]]}
    assert rows(spark, db + "_c", "t") == []
    with pytest.raises(ValueError):
        t.build_empty_from_columns(spark, db, "t", columns, {"partitioning": ["nope"]})
    assert len(rows(spark, db, "t")) == 1
    t.build_empty_from_columns(spark, db, "t", columns, None)
    assert rows(spark, db, "t") == []
    t.build_empty_from_sql(spark, db, "s", f"select id, array(email) as e from {db}.t;")
    t.build_empty_from_sql(spark, db, "s", f"select id, array(email) as e from {db}.t; ")
    assert spark.table(f"{db}.s").dtypes == [("id", "int"), ("e", "array<string>")]
    t.clone_empty_from_prod(spark, db + "_c", db, "s")
    assert spark.table(f"{db}_c.s").dtypes == [("id", "int"), ("e", "array<string>")]
    with pytest.raises(ReadError):
        t.build_empty_from_sql(spark, db, "s", "select nope from nowhere")
    assert spark.table(f"{db}.s").columns == ["id", "e"]
    with pytest.raises(LoadError, match="does not exist"):
        t.clone_empty_from_prod(spark, db, db, "absent")
    t.drop_schema(spark, db + "_c")


def test_schemas(spark):
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: t.ensure_schema(spark, "conc"), range(16)))
    assert spark.catalog.databaseExists("conc")
    t.drop_schema(spark, "conc")
    t.drop_schema(spark, "conc")
    for name in ("a-b", "", "a.b", "a`b"):
        with pytest.raises(LoadError, match="letters"):
            t.ensure_schema(spark, name)


EVENTS = (Column("id", "BIGINT", False), Column("ts", "TIMESTAMP"), Column("kind", "VARCHAR(10)"))


def events(spark, n=2000):
    # A third of all rows fall on one day.
    return spark.range(n).selectExpr(
        "id", "timestampadd(HOUR, cast(if(id % 3 = 0, 5, id % 200) as int), timestamp_ntz'2024-01-01 00:00:00') as ts",
        "if(id % 7 = 0, '', concat('k', id % 3)) as kind")


@pytest.mark.parametrize("config", [
    {"partitioning": ["day(ts)"], "sorted_by": ["id"], "format": "orc"},
    {"partitioning": ["month(ts)", "kind"]},
    {"partitioning": ["year(ts)", "hour(ts)"], "format": "Parquet"},
    {"partitioning": ["bucket(id, 4)"], "sorted_by": ["id DESC NULLS LAST"]},
    {"partitioning": ["day(ts)", "bucket(id, 4)", "bucket(kind, 2)", "truncate(kind, 1)", "truncate(id, 100)"], "sorted_by": ["ts", "id"]},
    {"sorted_by": ["kind asc", "id desc nulls first"], "indexes": [{"columns": ["id"]}, {"columns": ["ts"], "type": "brin"}]},
    {"format": "orc", "indexes": [{"columns": ["id"], "type": "hash", "name": "h"}, {"columns": ["id"], "unique": True}]},
])
def test_layouts_keep_the_rows(spark, db, config):
    t.ensure_table(spark, db, "e", EVENTS, config=config)
    data = events(spark)
    assert t.load(spark, db, "e", data) == 2000
    assert spark.table(f"{db}.e").columns == ["id", "ts", "kind"]
    assert rows(spark, db, "e") == sorted(tuple(r) for r in data.collect())
    part = t.read_slice(spark, db, "e", "ts", F.lit(dt.datetime(2024, 1, 2, 3)), F.lit(dt.datetime(2024, 1, 3, 4)))
    want = data.where("ts between timestamp_ntz'2024-01-02 03:00:00' and timestamp_ntz'2024-01-03 04:00:00'")
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, want.collect()))


def test_a_slice_of_texts_holds_the_empty_one(spark, db):
    t.ensure_table(spark, db, "e", EVENTS, config={"partitioning": ["kind", "truncate(kind, 1)"]})
    t.load(spark, db, "e", events(spark))
    for lower, upper in (("", "k0"), ("", ""), ("a", "z")):
        part = t.read_slice(spark, db, "e", "kind", F.lit(lower), F.lit(upper))
        assert part.count() == events(spark).where(F.col("kind").between(lower, upper)).count()


def test_day_partitions_prune(spark, db):
    t.ensure_table(spark, db, "e", EVENTS, config={"partitioning": ["day(ts)"]})
    t.load(spark, db, "e", events(spark))
    part = t.read_slice(spark, db, "e", "ts", F.lit(dt.datetime(2024, 1, 2)), F.lit(dt.datetime(2024, 1, 2, 23)))
    assert "PartitionFilters: [isnotnull(pact_day_ts" in part._jdf.queryExecution().toString()
    version = t.describe(spark, db, "e").version
    assert spark.sql(f"show partitions {db}.{version}").count() == 9


def test_sort_order_holds_within_files(spark, db):
    for config in ({"partitioning": ["bucket(id, 2)"], "sorted_by": ["ts DESC", "id DESC"]},
                   {"partitioning": ["day(ts)"], "sorted_by": ["id desc"]},
                   {"partitioning": ["bucket(id, 1)"], "sorted_by": ["kind", "id"]},
                   {"sorted_by": ["kind", "id"]}):
        t.drop_schema(spark, db)
        t.ensure_table(spark, db, "e", EVENTS, config=config)
        t.load(spark, db, "e", events(spark))
        version = t.describe(spark, db, "e").version
        files = {}
        stored = spark.table(f"{db}.{version}").select("*", F.col("_metadata.file_path").alias("f"),
                                                       F.monotonically_increasing_id().alias("o"))
        for r in sorted(stored.collect(), key=lambda r: r.o):
            files.setdefault(r.f, []).append(r)
        key = {"ts DESC": lambda r: (r.ts, r.id), "id desc": lambda r: r.id}.get(config["sorted_by"][0])
        for got in files.values():
            if key:
                assert [key(r) for r in got] == sorted((key(r) for r in got), reverse=True)
            else:
                assert [(r.kind, r.id) for r in got] == sorted((r.kind, r.id) for r in got)


def test_buckets_join_without_a_shuffle(spark, db):
    for name in ("a", "b"):
        t.ensure_table(spark, db, name, EVENTS, config={"partitioning": ["bucket(id, 4)"]})
        t.load(spark, db, name, events(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(f"{db}.a").join(spark.table(f"{db}.b"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("config", [
    [], {"index": []}, {"partitioned_by": ["ts"]}, {"partitioning": []}, {"partitioning": "ts"},
    {"partitioning": [""]}, {"partitioning": ["nope"]}, {"partitioning": ["day(nope)"]},
    {"partitioning": ["week(ts)"]}, {"partitioning": ["bucket(id)"]}, {"partitioning": ["day(ts, 3)"]},
    {"partitioning": ["day(kind)"]}, {"partitioning": ["truncate(ts, 3)"]}, {"partitioning": ["bucket(id, 0)"]},
    {"partitioning": ["kind", "kind"]}, {"sorted_by": ["nope desc"]}, {"sorted_by": []}, {"format": "CSV"},
    {"format": 1}, {"format_version": 2}, {"unique": "id"}, {"unique": [["nope"]]}, {"unique": [[]]},
    {"indexes": {}}, {"indexes": [1]}, {"indexes": [{"columns": []}]}, {"indexes": [{"columns": ["nope"]}]},
    {"indexes": [{"columns": ["id"], "cols": 1}]}, {"indexes": [{"columns": ["id"], "unique": 1}]},
    {"indexes": [{"columns": ["id"], "type": "gin"}]}, {"indexes": [{"columns": ["id"], "unique": True, "type": "hash"}]},
    {"indexes": [{"columns": ["id", "ts"], "type": "hash"}]}, {"indexes": [{"columns": ["id"], "name": ""}]},
    {"indexes": [{"columns": ["id"]}, {"columns": ["id"], "unique": True}]},
])
def test_refused_layouts(config):
    with pytest.raises(ValueError):
        parse_layout(config, EVENTS)


def test_wide_tables_are_remembered_in_pieces(spark, db):
    columns = [Column(f"a_rather_long_column_name_{i}'\\_%", "VARCHAR(100)", i % 2 == 0) for i in range(300)]
    t.ensure_table(spark, db, "w", columns)
    assert t.describe(spark, db, "w").columns == tuple(columns)
    kept = spark.sql(f"show tblproperties {db}.w").collect()
    assert max(len(r.value) for r in kept if r.key.startswith("pact")) <= 3500


def test_avro_needs_its_package(spark, db):
    with pytest.raises(LoadError, match="(?i)avro"):
        t.ensure_table(spark, db, "a", PLAIN, config={"format": "avro"})
    assert names(spark, db) == []


def test_a_load_keeps_rules_and_layout_of_a_plain_table(spark, db):
    spark.sql(f"create table {db}.f (id int, v varchar(3), p int) using orc "
              "partitioned by (p) tblproperties ('team' = 'blue')")
    spark.sql(f"insert into {db}.f values (1, 'a', 1)")
    t.declare_rules(spark, db, "f", [Column("id", "INTEGER", False), Column("v", "VARCHAR(3)"), Column("p", "INTEGER")])
    with pytest.raises(LoadError):
        t.load(spark, db, "f", spark.createDataFrame([(2, "four", 1)], "id int, v string, p int"))
    assert rows(spark, db, "f") == [(1, "a", 1)]
    for turn in (2, 3):
        assert t.load(spark, db, "f", spark.createDataFrame([(turn, "abc", 7)], "id int, v string, p int")) == 1
        assert rows(spark, db, "f") == [(turn, "abc", 7)]
        state = t.describe(spark, db, "f")
        assert state.columns[1].type == "VARCHAR(3)" and state.properties == {"team": "blue"}
        version = f"{db}.{state.version}"
        assert [c.name for c in spark.catalog.listColumns(version) if c.isPartition] == ["p"]
        told = {r.col_name: r.data_type for r in spark.sql(f"describe extended {version}").collect()}
        assert told["Provider"] == "orc"
    t.clone_empty_from_prod(spark, db, db, "f")
    assert [c.type for c in t.describe(spark, db, "f").columns] == ["INTEGER", "VARCHAR(3)", "INTEGER"]


def test_a_plain_table_of_another_format_is_refused(spark, db):
    spark.sql(f"create table {db}.c (id int) using csv")
    with pytest.raises(ValueError, match="format"):
        t.declare_rules(spark, db, "c", [Column("id", "INTEGER")])
    with pytest.raises(LoadError, match="made elsewhere"):
        t.load(spark, db, "c", spark.createDataFrame([(1,)], "id int"))
    assert rows(spark, db, "c") == []


def test_bucketed_plain_table_stays_bucketed(spark, db):
    spark.sql(f"create table {db}.b (id int, s string) using parquet clustered by (id) sorted by (s) into 4 buckets")
    t.declare_rules(spark, db, "b", [Column("id", "INTEGER"), Column("s", "TEXT")])
    t.load(spark, db, "b", spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string"))
    layout = t.describe(spark, db, "b").layout
    assert (layout.bucket.column, layout.bucket.width, layout.sorted_by[0].column) == ("id", 4, "s")


def test_a_reader_outlives_loads_until_its_version_is_vacuumed(spark, db):
    t.ensure_table(spark, db, "t", PLAIN)
    t.load(spark, db, "t", spark.createDataFrame([(1, "a")], "id int, name string"))
    held = spark.table(f"{db}.t")
    for k in (2, 3):
        t.load(spark, db, "t", spark.createDataFrame([(k, "b")], "id int, name string"))
    assert [tuple(r) for r in held.collect()] == [(1, "a")] and rows(spark, db, "t") == [(3, "b")]
    told = t.history(spark, db, "t").collect()
    assert [r.is_current for r in told] == [True, False, False, False] and told[0].replaced_at is None
    assert all(a.current_since == b.replaced_at for a, b in zip(told, told[1:]))
    assert [tuple(r) for r in t.read_version(spark, db, "t", told[1].version).collect()] == [(2, "b")]
    with pytest.raises(LoadError, match="no version"):
        t.read_version(spark, db, "t", "other")
    assert t.vacuum(spark, db) == []
    assert t.vacuum(spark, db, "t", AT_ONCE) == sorted(r.version for r in told[1:])
    assert t.history(spark, db, "t").count() == 1 and rows(spark, db, "t") == [(3, "b")]


def test_vacuum_drops_what_dead_writers_left_and_nothing_else(spark, db):
    t.ensure_table(spark, db, "t", PLAIN)
    now = t._now()
    left = {"dead": f"t__v_{now - 10 * 86_400_000:013d}_{'a' * 16}", "running": f"t__v_{now:013d}_{'b' * 16}", "gone": f"u__v_{now - 10 * 86_400_000:013d}_{'c' * 16}",
            "mine": "t__v_2024", "also": f"t__old_{1:013d}_{'d' * 16}"}
    for name in left.values():
        spark.range(1).write.saveAsTable(f"{db}.{name}")
    assert t.vacuum(spark, db, "u") == [left["gone"]]
    assert t.vacuum(spark, db) == [left["dead"]]
    assert {left["running"], left["mine"], left["also"], "t"} <= set(names(spark, db))


def test_a_crash_between_the_two_steps_of_a_move(spark, db):
    columns = (Column("id", "INTEGER", False), Column("name", "TEXT"))

    def made(name):
        spark.createDataFrame([(1, "a")], "id int, name string").write.saveAsTable(f"{db}.{name}")
        t.declare_rules(spark, db, name, columns)
        version = t._new_version(name)
        spark.createDataFrame([(2, "b")], "id int, name string").write.saveAsTable(f"{db}.{version}")
        kept = t._in_pieces(t.KEPT_KEY, {"version": version, "columns": [c.as_dict() for c in columns], "config": None, "log": [[version, 5]]})
        return version, f"create or replace view {db}.{name} tblproperties ({t._property_list(kept)}) as select id, name from {db}.{version}"

    version, statement = made("whole")
    t.announce_move(spark, db, "whole", version, statement)
    assert not spark.catalog.tableExists(f"{db}.whole")
    assert t.recover(spark, db, "whole") == "completed" and rows(spark, db, "whole") == [(2, "b")]
    assert t.describe(spark, db, "whole").columns == columns and t.recover(spark, db, "whole") == ""

    version, statement = made("lost")
    t.announce_move(spark, db, "lost", version, statement)
    spark.sql(f"drop table {db}.{version}")
    with pytest.raises(LoadError, match="contains nulls"):  # the load settles the move before it starts
        t.load(spark, db, "lost", spark.createDataFrame([(None, "x")], "id int, name string"))
    assert rows(spark, db, "lost") == [(1, "a")] and t.describe(spark, db, "lost").columns == columns

    version, statement = made("early")
    plan = t._in_pieces(t.MOVE_KEY, {"version": version, "statement": statement})
    spark.sql(f"alter table {db}.early set tblproperties ({t._property_list(plan)})")
    assert t.recover(spark, db, "early") == "undone" and rows(spark, db, "early") == [(1, "a")]
    assert t.load(spark, db, "early", spark.createDataFrame([(3, "c")], "id int, name string")) == 1


def test_rules_of_tables_made_elsewhere(spark, db):
    spark.sql(f"create table {db}.p (id int not null, v varchar(2)) using parquet")
    nulls = spark.createDataFrame([(None, "a")], "id int, v string")
    with pytest.raises(LoadError, match="made elsewhere"):
        t.load(spark, db, "p", nulls)
    with pytest.raises(LoadError, match="made elsewhere"):
        t.clone_empty_from_prod(spark, db, db, "p")
    rules = [Column("id", "INTEGER", False), Column("v", "VARCHAR(2)")]
    for wrong in ([rules[0]], [Column("id", "BIGINT"), rules[1]], rules[::-1]):
        with pytest.raises(LoadError, match="other columns"):
            t.declare_rules(spark, db, "p", wrong)
    t.declare_rules(spark, db, "p", rules)
    with pytest.raises(LoadError, match="contains nulls"):
        t.load(spark, db, "p", nulls)
    t.ensure_schema(spark, db + "_c")
    t.clone_empty_from_prod(spark, db + "_c", db, "p")
    with pytest.raises(LoadError, match="contains nulls"):
        t.load(spark, db + "_c", "p", nulls)
    t.drop_schema(spark, db + "_c")
    assert t.load(spark, db, "p", spark.createDataFrame([(1, "a")], "id int, v string")) == 1
    with pytest.raises(LoadError, match="created with"):
        t.declare_rules(spark, db, "p", rules)
    with pytest.raises(LoadError, match="contains nulls"):
        t.load(spark, db, "p", nulls)
