"""Tables: typed empty builds and atomic replacement of contents.

The name of a table is a view over the current version of its data. A load writes
a new version next to it, checks it, and points the view at it: one catalog
operation. Nothing is copied or renamed (on an object store a rename copies every
byte), there is no moment without a table, and a failure at any point before leaves
the old contents in place. One writer per table is assumed.

The view's properties hold a log of versions with the times they became current. A
version that was replaced stays for ``KEEP_FOR``, so a query that was planned before a
load finishes on the rows it was planned for; later loads and ``vacuum`` drop it, as
they drop what a writer left behind that died before it published.

A table made elsewhere, by plain SQL, is moved aside when its first load is published.
What is to be done is recorded on the table before it is moved, so whoever comes next
after a crash completes the move, or undoes it where the new version is gone. Spark's
catalog does not keep NOT NULL of such a table: its rules must be stated once, by
``declare_rules`` or by the contract that is run into it, else loads are refused.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import re
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from tablepact.contract import Column, columns_of, struct_of
from tablepact.errors import ConformError, LoadError, PactError, ReadError, ScriptError
from tablepact.operators.checks import Checked
from tablepact.operators.conform import plan_conform
from tablepact.operators.layout import Layout, parse_layout, slice_filter, write_table
from tablepact.operators.unique import unique_violations
from tablepact.sources.pruning import VERSION_NAME
from tablepact.sources.reads import check_binds, fetch

logger = logging.getLogger("tablepact.tables")

_NAME = re.compile(r"[A-Za-z0-9_]+", re.ASCII)
_RAISED = re.compile(r"\b(ConformError|LoadError|ReadError|ScriptError): ([^\n]*)")
_RAISED_CLASSES = {c.__name__: c for c in (ConformError, LoadError, ReadError, ScriptError)}

# What is remembered with a table, in pieces that any metastore takes,
# and the declared type of a Spark type.
KEPT_KEY, RULES_KEY, MOVE_KEY, KEPT_PIECE = "pact.table", "pact.rules", "pact.move", 3500
ASIDE_NAME = re.compile(r"(.+)__old_([0-9]{13})_[0-9a-f]{16}")
#: How long a version stays after it was replaced.
KEEP_FOR = dt.timedelta(hours=24)
_DECLARED = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE PRECISION",
    T.StringType: "TEXT", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
    T.BooleanType: "BOOLEAN",
}
# Where Spark keeps the length of a text, and beginnings of properties
# that a catalog or this package sets itself.
_LENGTH_KEY = "__CHAR_VARCHAR_TYPE_STRING"
_NOT_THE_USERS = (KEPT_KEY + ".", RULES_KEY + ".", MOVE_KEY + ".", "view.", "spark.sql.", "transient_lastDdlTime")


@dataclass(frozen=True)
class Table:
    """What the catalog knows about a table."""

    schema: str
    table: str
    version: str | None = None
    columns: tuple[Column, ...] | None = None
    config: Mapping[str, Any] | None = None
    exists: bool = True
    properties: Mapping[str, str] = field(default_factory=dict)
    #: Versions and the milliseconds at which they became current, the newest first.
    log: tuple[tuple[str, int], ...] = ()
    #: Whether NOT NULL of the columns is known.
    stated: bool = True

    @property
    def layout(self) -> Layout:
        return parse_layout(self.config, self.columns or ())


# -- schemas ------------------------------------------------------------------


def ensure_schema(spark: SparkSession, schema: str) -> None:
    """Create a schema if it is absent; concurrent callers all succeed."""
    try:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_identifier(schema)}")
    except PySparkException:
        if not spark.catalog.databaseExists(schema):
            raise


def drop_schema(spark: SparkSession, schema: str) -> None:
    """Drop a schema and everything in it; nothing happens if it is absent."""
    spark.sql(f"DROP DATABASE IF EXISTS {_identifier(schema)} CASCADE")


# -- what is there ------------------------------------------------------------


def describe(spark: SparkSession, schema: str, table: str) -> Table:
    """Current version, declared columns and layout of a table."""
    name = _qualified(schema, table)
    if not spark.catalog.tableExists(f"{schema}.{table}"):
        return Table(schema, table, exists=False)
    properties = _properties(spark, name)
    own = {k: v for k, v in properties.items() if not k.startswith(_NOT_THE_USERS)}
    kept = _remembered(properties, KEPT_KEY)
    if kept is None:
        rules = _remembered(properties, RULES_KEY)
        if rules is not None:
            return Table(schema, table, columns=columns_of(rules["columns"]), config=rules["config"], properties=own)
        columns = _columns_of_schema(spark.table(name).schema)
        return Table(schema, table, columns=columns, config=_plain_config(spark, name), properties=own, stated=False)
    columns = columns_of(kept["columns"]) if kept["columns"] else None
    log = tuple((v, at) for v, at in kept.get("log", [[kept["version"], 0]]))
    return Table(schema, table, kept["version"], columns, kept["config"], properties=own, log=log)


def declare_rules(
    spark: SparkSession, schema: str, table: str, columns: Sequence[Column], config: Mapping[str, Any] | None = None
) -> None:
    """State the rules of a table made by plain SQL, once: they are kept with it and hold for every load.

    Names and types must be those of the table; ``config`` is the layout of the loads to
    come, which is the table's own if it is left out.
    """
    declared = columns_of(list(columns))
    state = _current(spark, schema, table)
    name = _qualified(schema, table)
    if not state.exists or state.version is not None:
        raise LoadError(f"{name} is not a table made elsewhere; its rules are those it was created with")
    layout = dict(config) if config is not None else dict(_plain_config(spark, name))
    parse_layout(layout, declared)
    actual = [(f.name, f.dataType) for f in spark.table(name).schema]
    wanted = [(c.name, c.sql_type.spark) for c in declared]
    if actual != wanted:
        raise LoadError(f"the rules of {name} are for other columns: {wanted}, where the table has {actual}")
    rules = {"columns": [c.as_dict() for c in declared], "config": layout}
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({_property_list(_in_pieces(RULES_KEY, rules))})")


def _current(spark: SparkSession, schema: str, table: str) -> Table:
    """As ``describe``, after a move that was interrupted has been settled."""
    recover(spark, schema, table)
    return describe(spark, schema, table)


def _plain_config(spark: SparkSession, name: str) -> dict[str, Any]:
    """The layout of a table made elsewhere, as a contract would state it."""
    rows = [(r.col_name, r.data_type) for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()]
    told = dict(rows[rows.index(("# Detailed Table Information", "")) + 1:])
    partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if "Num Buckets" in told:
        partitions.append(f"bucket({told['Bucket Columns'].strip('[]`')}, {told['Num Buckets']})")
    config: dict[str, Any] = {"format": told.get("Provider", "view").upper()}
    if partitions:
        config["partitioning"] = partitions
    if told.get("Sort Columns", "[]") != "[]":
        config["sorted_by"] = [c.strip(" `") for c in told["Sort Columns"].strip("[]").split(",")]
    return config


def read_slice(
    spark: SparkSession, schema: str, table: str, column: str, lower: Expr, upper: Expr
) -> DataFrame:
    """Rows with ``lower <= column <= upper``, scanning only the partitions that
    can hold them, also where the table is partitioned by a derived value."""
    state = describe(spark, schema, table)
    if state.version is None:
        return spark.table(_qualified(schema, table)).where(
            slice_filter(Layout(), column, lower, upper)
        )
    rows = spark.table(_qualified(schema, state.version))
    kept = rows.where(slice_filter(state.layout, column, lower, upper))
    names = [c.name for c in state.columns] if state.columns else rows.columns
    return kept.select(*["`" + name.replace("`", "``") + "`" for name in names])


# -- empty builds -------------------------------------------------------------


def build_empty_from_columns(
    spark: SparkSession,
    schema: str,
    table: str,
    columns: Sequence[Column],
    config: Mapping[str, Any] | None = None,
) -> None:
    """(Re)build an empty table of declared columns; a failure keeps the old one."""
    declared = columns_of(list(columns))
    layout = parse_layout(config, declared)
    empty = spark.createDataFrame([], struct_of(declared))
    _publish_new(spark, schema, table, empty, layout, declared, config)


def build_empty_from_sql(spark: SparkSession, schema: str, table: str, sql: str) -> None:
    """(Re)build an empty table shaped like a query; the query does not run."""
    check_binds(spark, sql)
    shaped = fetch(spark, sql).limit(0)
    _publish_new(spark, schema, table, shaped, Layout(), None, None)


def clone_empty_from_prod(
    spark: SparkSession, candidate_schema: str, prod_schema: str, table: str
) -> None:
    """(Re)build an empty copy of a table's shape in another schema."""
    state = _current(spark, prod_schema, table)
    if not state.exists:
        raise LoadError(f"table {prod_schema}.{table} does not exist")
    if not state.stated:
        raise _unstated(state)
    if state.columns:
        try:
            build_empty_from_columns(spark, candidate_schema, table, state.columns, state.config)
        except ValueError as exc:
            raise LoadError(f"cannot copy the layout of {prod_schema}.{table}: {exc}") from exc
    else:
        shaped = spark.table(_qualified(prod_schema, table)).limit(0)
        _publish_new(spark, candidate_schema, table, shaped, Layout(), None, None)


def ensure_table(
    spark: SparkSession,
    schema: str,
    table: str,
    columns: Sequence[Column],
    *,
    config: Mapping[str, Any] | None = None,
) -> None:
    """Create an empty table unless there is one; an existing table is not altered."""
    declared = columns_of(list(columns))
    parse_layout(config, declared)
    ensure_schema(spark, schema)
    if not _current(spark, schema, table).exists:
        build_empty_from_columns(spark, schema, table, declared, config)


# -- load ---------------------------------------------------------------------


def load(spark: SparkSession, schema: str, table: str, data: DataFrame, keep_for: dt.timedelta = KEEP_FOR) -> int:
    """Replace the contents of an existing table; return the number of rows.

    The declared NOT NULL, length and uniqueness rules of the table hold for the
    new contents, or the old ones stay. Versions replaced longer than ``keep_for`` ago go.
    """
    state = _current(spark, schema, table)
    if not state.exists:
        raise LoadError(f"table {schema}.{table} does not exist")
    if not state.stated:
        raise _unstated(state)
    if state.columns is None:
        raise LoadError(f"table {schema}.{table} has columns of undeclared types")
    try:
        checked = plan_conform(data, state.columns, error=LoadError)
    except ConformError as exc:
        raise LoadError(f"failed to write {schema}.{table}: {exc}") from exc
    return _replace(spark, state, checked, keep_for)


def replace_contents(
    spark: SparkSession,
    schema: str,
    table: str,
    checked: Checked,
    config: Mapping[str, Any] | None = None,
    keep_for: dt.timedelta = KEEP_FOR,
) -> int:
    """Check rows while they are written, and make them the table's contents.

    The table is created if it is absent. If it was created with other columns,
    its own rules hold for the new rows as well. A table made elsewhere without stated
    rules, but with the same columns, takes those of the contract.
    """
    state = _current(spark, schema, table)
    if not state.exists:
        ensure_schema(spark, schema)
        state = Table(schema, table, columns=checked.columns, config=config)
    elif not state.stated and _types(state.columns) == _types(checked.columns):
        state = replace(state, columns=checked.columns, stated=True)
    elif _shape(state.columns) != _shape(checked.columns):
        return load(spark, schema, table, checked.strict(), keep_for)
    return _replace(spark, state, checked, keep_for)


def _unstated(state: Table) -> LoadError:
    return LoadError(
        f"table {state.schema}.{state.table} was made elsewhere, and the catalog does not keep its NOT NULL rules: "
        "state them once with declare_rules, or load it by a contract with the same columns"
    )


def _replace(spark: SparkSession, state: Table, checked: Checked, keep_for: dt.timedelta) -> int:
    try:
        layout = parse_layout(state.config, state.columns)
    except ValueError as exc:
        raise LoadError(f"cannot keep the layout of {state.schema}.{state.table}: {exc}") from exc
    version = _new_version(state.table)
    name = _qualified(state.schema, version)
    observation = Observation()
    try:
        write_table(checked.observed(observation), name, layout)
        checked.settle(observation)
        for keys in layout.unique:
            repeated = unique_violations(spark.table(name), keys).limit(1).collect()
            if repeated:
                raise LoadError(
                    f"failed to write {state.schema}.{state.table}: duplicate key for unique "
                    f"columns {list(keys)}: {repeated[0].asDict()}"
                )
        # From the files just written: a repeated task does not count twice.
        rows = spark.table(name).count()
        _publish(spark, state.schema, state.table, version, state.columns, state.config, keep_for)
    except Exception as exc:
        _drop_quietly(spark, name)
        if isinstance(exc, PactError):
            raise
        raise as_pact_error(exc, f"failed to write {state.schema}.{state.table}") from exc
    return rows


def _publish_new(
    spark: SparkSession,
    schema: str,
    table: str,
    contents: DataFrame,
    layout: Layout,
    columns: Sequence[Column] | None,
    config: Mapping[str, Any] | None,
) -> None:
    version = _new_version(table)
    try:
        write_table(contents, _qualified(schema, version), layout)
        _publish(spark, schema, table, version, columns, config, KEEP_FOR)
    except Exception as exc:
        _drop_quietly(spark, _qualified(schema, version))
        if isinstance(exc, PactError):
            raise
        raise as_pact_error(exc, f"failed to build {schema}.{table}") from exc


def _publish(
    spark: SparkSession,
    schema: str,
    table: str,
    version: str,
    columns: Sequence[Column] | None,
    config: Mapping[str, Any] | None,
    keep_for: dt.timedelta,
) -> None:
    """Point the table's name at a finished version, and drop those replaced long ago."""
    before, now = describe(spark, schema, table), _now()
    replaced = _replaced_at(((version, now), *before.log))
    expired = {v for v, at in replaced.items() if at <= now - _milliseconds(keep_for)}
    log = ((version, now), *[(v, at) for v, at in before.log if v not in expired])
    names = [c.name for c in columns] if columns else spark.table(_qualified(schema, version)).columns
    listed = ", ".join("`" + n.replace("`", "``") + "`" for n in names)
    told = dict(before.properties) | _in_pieces(KEPT_KEY, {
        "version": version,
        "columns": [c.as_dict() for c in columns] if columns else None,
        "config": dict(config) if config else None,
        "log": log,
    })
    statement = (
        f"CREATE OR REPLACE VIEW {_qualified(schema, table)} TBLPROPERTIES ({_property_list(told)}) "
        f"AS SELECT {listed} FROM {_qualified(schema, version)}"
    )
    if before.exists and before.version is None:
        announce_move(spark, schema, table, version, statement)
        try:
            spark.sql(statement)
        except Exception:
            recover(spark, schema, table, complete=False)
            raise
        return
    spark.sql(statement)
    for old in expired:
        _drop_quietly(spark, _qualified(schema, old))


# -- moves of tables made elsewhere ---------------------------------------------


def announce_move(spark: SparkSession, schema: str, table: str, version: str, statement: str) -> None:
    """Record on a table made elsewhere what will take its place, and move it aside."""
    name, aside = _qualified(schema, table), f"{table}__old_{_now():013d}_{uuid.uuid4().hex[:16]}"
    plan = _in_pieces(MOVE_KEY, {"version": version, "statement": statement})
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({_property_list(plan)})")
    spark.sql(f"ALTER TABLE {name} RENAME TO {_qualified(schema, aside)}")


def recover(spark: SparkSession, schema: str, table: str, complete: bool = True) -> str:
    """Settle a move that was interrupted: ``completed``, ``undone``, or ``""`` if there was none.

    Where the name is gone, the recorded statement puts the finished version in its
    place; without the version, or if ``complete`` is false, the table gets its name
    back. Where the table was recorded but not moved yet, the record is taken off.
    """
    name = _qualified(schema, table)
    if spark.catalog.tableExists(f"{schema}.{table}"):
        properties = _properties(spark, name)
        if _remembered(properties, MOVE_KEY) is None:
            return ""
        _forget_move(spark, name, properties)
        return "undone"
    for aside in _tables(spark, schema):
        found = ASIDE_NAME.fullmatch(aside)
        if not found or found[1] != table:
            continue
        moved = _qualified(schema, aside)
        properties = _properties(spark, moved)
        plan = _remembered(properties, MOVE_KEY)
        if plan is None:
            continue
        if complete and spark.catalog.tableExists(f"{schema}.{plan['version']}"):
            spark.sql(plan["statement"])
            logger.warning("the move of %s was interrupted and is now complete", name)
            return "completed"
        spark.sql(f"ALTER TABLE {moved} RENAME TO {name}")
        _forget_move(spark, name, properties)
        logger.warning("the move of %s was interrupted and is undone", name)
        return "undone"
    return ""


def _forget_move(spark: SparkSession, name: str, properties: Mapping[str, str]) -> None:
    keys = ", ".join(_literal(k) for k in properties if k.startswith(MOVE_KEY + "."))
    spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ({keys})")


# -- versions -------------------------------------------------------------------

HISTORY_SCHEMA = "version string, current_since timestamp_ntz, replaced_at timestamp_ntz, is_current boolean"


def history(spark: SparkSession, schema: str, table: str) -> DataFrame:
    """The versions of a table that can still be read, the newest first."""
    state = describe(spark, schema, table)
    replaced, present = _replaced_at(state.log), set(_tables(spark, schema))
    rows = [(v, _moment(at), _moment(replaced.get(v)), v == state.version) for v, at in state.log if v in present]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def read_version(spark: SparkSession, schema: str, table: str, version: str) -> DataFrame:
    """The rows of a version that is in the table's history."""
    state = describe(spark, schema, table)
    if version not in dict(state.log):
        raise LoadError(f"{schema}.{table} has no version {version!r}")
    rows = spark.table(_qualified(schema, version))
    names = [c.name for c in state.columns or () if c.name in rows.columns]
    return rows.select(*["`" + n.replace("`", "``") + "`" for n in names]) if names else rows


def vacuum(spark: SparkSession, schema: str, table: str | None = None, keep_for: dt.timedelta = KEEP_FOR) -> list[str]:
    """Drop what no table needs any more, of one table or of all in a schema; return the names.

    These are versions replaced longer than ``keep_for`` ago, versions as old that no
    table's log has, which writers left that died, and tables moved aside as long ago.
    Current versions and tables with any other name stay.
    """
    now, dropped = _now(), []
    horizon = now - _milliseconds(keep_for)
    owners: dict[str, list[tuple[str, int, bool]]] = {}
    for name in _tables(spark, schema):
        found, aside = VERSION_NAME.fullmatch(name), ASIDE_NAME.fullmatch(name)
        part = found or aside
        if part and table in (None, part[1]):
            owners.setdefault(part[1], []).append((name, int(part[2] or 0), bool(aside and not found)))
    for owner, parts in owners.items():
        state = _current(spark, schema, owner)
        replaced, current = _replaced_at(state.log), state.version
        for name, made, aside in parts:
            if name == current or not spark.catalog.tableExists(f"{schema}.{name}"):
                continue
            if aside and _remembered(_properties(spark, _qualified(schema, name)), MOVE_KEY) is None:
                continue  # somebody's own table that is called like that
            if replaced.get(name, made) <= horizon:
                spark.sql(f"DROP TABLE IF EXISTS {_qualified(schema, name)}")
                dropped.append(name)
    return sorted(dropped)


def _replaced_at(log: Sequence[tuple[str, int]]) -> dict[str, int]:
    """When the version after each came, which is in the log before it."""
    return {version: newer[1] for newer, (version, _) in zip(log, log[1:])}


def _tables(spark: SparkSession, schema: str) -> list[str]:
    if not spark.catalog.databaseExists(schema):
        return []
    return [r.tableName for r in spark.sql(f"SHOW TABLES IN {_identifier(schema)}").collect() if not r.isTemporary]


def _now() -> int:
    return time.time_ns() // 1_000_000


def _milliseconds(length: dt.timedelta) -> int:
    return length // dt.timedelta(milliseconds=1)


def _moment(milliseconds: int | None) -> dt.datetime | None:
    return None if milliseconds is None else dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=milliseconds)


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def _in_pieces(key: str, value: Any) -> dict[str, str]:
    text = json.dumps(value)
    return {f"{key}.{i}": text[at:at + KEPT_PIECE] for i, at in enumerate(range(0, len(text), KEPT_PIECE))}


def _remembered(properties: Mapping[str, str], key: str) -> Any:
    pieces = sorted((int(k.rpartition(".")[2]), v) for k, v in properties.items() if k.startswith(key + "."))
    return json.loads("".join(v for _, v in pieces)) if pieces else None


def _property_list(properties: Mapping[str, str]) -> str:
    return ", ".join(f"{_literal(key)} = {_literal(value)}" for key, value in properties.items())


def as_pact_error(exc: Exception, what: str) -> PactError:
    """The failure a job ended with: a check that raised in it, or the write itself."""
    raised = _RAISED.search(str(exc))
    if raised:
        return _RAISED_CLASSES[raised[1]](raised[2].split(" SQLSTATE:")[0].strip())
    return LoadError(f"{what}: {exc}")


def _shape(columns: Sequence[Column] | None) -> list[tuple[str, str, bool]]:
    return [(c.name, str(c.sql_type), c.nullable) for c in columns or ()]


def _types(columns: Sequence[Column] | None) -> list[tuple[str, str]]:
    return [(c.name, str(c.sql_type)) for c in columns or ()]


def _columns_of_schema(schema: T.StructType) -> tuple[Column, ...] | None:
    columns = []
    for part in schema:
        length = re.fullmatch(r"varchar\((\d+)\)", part.metadata.get(_LENGTH_KEY, ""))
        if isinstance(part.dataType, T.DecimalType):
            declared = f"NUMERIC({part.dataType.precision},{part.dataType.scale})"
        elif length:
            declared = f"VARCHAR({length[1]})"
        elif _LENGTH_KEY in part.metadata:
            declared = None  # A padded text is not a type of contracts.
        else:
            declared = _DECLARED.get(type(part.dataType))
        if declared is None:
            return None
        columns.append(Column(part.name, declared, part.nullable))
    return tuple(columns)


def _new_version(table: str) -> str:
    return f"{table}__v_{_now():013d}_{uuid.uuid4().hex[:16]}"


def _drop_quietly(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except PySparkException:
        logger.warning("could not drop %s", name, exc_info=True)


def _identifier(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise LoadError(
            f"{name!r} cannot name a schema or table here: letters, digits and _ only"
        )
    return f"`{name}`"


def _qualified(schema: str, table: str) -> str:
    return f"{_identifier(schema)}.{_identifier(table)}"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
