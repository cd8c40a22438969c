"""Physical layout of a table: partitions, buckets, sort order, format, keys."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.contract import Column, Rules, faults, is_text, one_of
from tablepact.sqltypes import SqlType

# The layout vocabulary.
INDEX_TYPES = ("btree", "hash", "brin")
FORMATS = ("PARQUET", "ORC", "AVRO")
TIME_TRANSFORMS = ("year", "month", "day", "hour")

_CALL = re.compile(r"\s*(\w+)\s*\(\s*(.+?)\s*(?:,\s*([0-9]+)\s*)?\)\s*")
_SORT = re.compile(
    r"\s*(.+?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?\s*", re.IGNORECASE
)


@dataclass(frozen=True)
class Partition:
    """One partition key: a column, or a value derived from it."""

    transform: str
    column: str
    width: int | None = None
    sql_type: SqlType | None = None

    @property
    def derived(self) -> bool:
        # Spark stores an empty text partition value as null, so text is
        # partitioned by a copy and read from the data files.
        return self.transform != "identity" or self.sql_type.is_text

    @property
    def name(self) -> str:
        if not self.derived:
            return self.column
        width = "" if self.width is None else f"_{self.width}"
        return f"pact_{self.transform}{width}_{self.column}"

    def value(self, column: Expr) -> Expr:
        if self.transform == "day":
            return column.cast("date")
        if self.transform in ("year", "month"):
            return F.trunc(column.cast("date"), self.transform)
        if self.transform == "hour":
            return F.substring(column.cast("string"), 1, 13)
        if self.transform == "truncate":
            if self.sql_type.is_text:
                return F.substring(column, 1, self.width)
            return column - F.pmod(column, F.lit(self.width))
        if self.transform == "bucket":
            return bucket_id(column, self.width)
        return column

    def can_hold(self, operator: str, value: Expr) -> Expr:
        """Whether a partition can hold rows whose column is ``=``, ``<=`` or ``>=`` a value, or ``in`` an array.

        Derived values never fall while the column rises, but for buckets, which know
        only ``=`` and ``in``. An empty text is stored as null.
        """
        column = F.col(_quoted(self.name))
        if operator == "in":
            found, empty = F.array_contains(F.transform(value, self.value), column), F.array_contains(value, F.lit(""))
        else:
            own = self.value(value)
            found = column == own if operator == "=" else column <= own if operator == "<=" else column >= own
            empty = F.lit(True) if operator == "<=" else own == ""
        return found | (column.isNull() & empty) if self.sql_type.is_text and self.transform != "bucket" else found


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls_last: bool = False

    def order(self) -> Expr:
        column = F.col(_quoted(self.column))
        if self.descending:
            return column.desc_nulls_last() if self.nulls_last else column.desc_nulls_first()
        return column.asc_nulls_last() if self.nulls_last else column.asc_nulls_first()


@dataclass(frozen=True)
class Layout:
    format: str = "parquet"
    partitions: tuple[Partition, ...] = ()
    bucket: Partition | None = None
    sorted_by: tuple[SortKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    lookup: tuple[str, ...] = ()


def _are_texts(value: Any) -> bool:
    return isinstance(value, list) and len(value) > 0 and all(map(is_text, value))


_TEXTS = ("a list of texts", _are_texts)
_LAYOUT_RULES: Rules = {
    "partitioning": _TEXTS,
    "sorted_by": _TEXTS,
    "format": (f"one of {FORMATS}", lambda value: isinstance(value, str) and value.upper() in FORMATS),
    "unique": ("a list of lists of columns", lambda value: isinstance(value, list) and all(map(_are_texts, value))),
    "indexes": ("a list", lambda value: isinstance(value, list)),
}
_INDEX_RULES: Rules = {
    "columns": _TEXTS,
    "unique": ("true or false", lambda value: isinstance(value, bool)),
    "type": one_of(INDEX_TYPES),
    "name": ("a name", is_text),
}


def _refuse(found: Sequence[str], where: str) -> None:
    if found:
        raise ValueError(f"{where}: {'; '.join(found)}")


def parse_layout(config: Mapping[str, Any] | None, columns: Sequence[Column]) -> Layout:
    """Check a layout against the declared columns, before anything is created."""
    if config is None:
        return Layout()
    _refuse(faults(config, _LAYOUT_RULES), "config")
    declared = {c.name: c.sql_type for c in columns}
    sorted_by = tuple(_sort_key(text, declared) for text in config.get("sorted_by", ()))
    # Spark keeps buckets sorted in plain ascending order only; with another order
    # the bucket becomes a partition.
    bucketed = all(key == SortKey(key.column) for key in sorted_by)
    partitions, bucket = [], None
    for text in config.get("partitioning", ()):
        partition = _partition(text, declared)
        if partition.transform == "bucket" and bucketed and bucket is None:
            bucket = partition
        else:
            partitions.append(partition)
    clash = {p.name for p in partitions if p.derived} & set(declared)
    if clash:
        raise ValueError(f"config 'partitioning' needs column name(s) {sorted(clash)} for itself")
    if len({p.name for p in partitions}) < len(partitions):
        raise ValueError("config 'partitioning' names the same partition twice")
    if partitions and {p.name for p in partitions} >= set(declared):
        raise ValueError("config 'partitioning' leaves no column to store")

    unique, lookup = _keys(config, declared)
    return Layout(
        format=config.get("format", "PARQUET").lower(),
        partitions=tuple(partitions),
        bucket=bucket,
        sorted_by=sorted_by,
        unique=unique,
        lookup=lookup,
    )


def bucket_id(column: Expr, buckets: int) -> Expr:
    """The bucket Spark's own bucketed tables put a value in."""
    return F.pmod(F.hash(column), F.lit(buckets))


def write_table(df: DataFrame, name: str, layout: Layout) -> None:
    """Write a new table in its layout.

    Rows of one partition or bucket are brought together so that a task does not
    write a file into each of them; the exchange is a rebalance, which splits a
    partition that holds too many rows over several tasks.
    """
    frame = df
    for partition in layout.partitions:
        if partition.derived:
            frame = frame.withColumn(
                partition.name, partition.value(F.col(_quoted(partition.column)))
            )
    together = [p.name for p in layout.partitions]
    if layout.bucket:
        frame = frame.withColumn("pact_bucket", layout.bucket.value(
            F.col(_quoted(layout.bucket.column))
        ))
        together = [*together, "pact_bucket"]
    if together:
        frame = frame.hint("rebalance", *[F.col(_quoted(n)) for n in together])
    if layout.bucket:
        frame = frame.drop("pact_bucket")
    elif layout.sorted_by:
        # The order the writer asks for comes first, so it need not sort again.
        order = [F.col(_quoted(p.name)).asc() for p in layout.partitions]
        frame = frame.sortWithinPartitions(*order, *[key.order() for key in layout.sorted_by])

    writer = frame.write.format(layout.format)
    if layout.partitions:
        writer = writer.partitionBy(*[p.name for p in layout.partitions])
    if layout.bucket:
        writer = writer.bucketBy(layout.bucket.width, layout.bucket.column)
        if layout.sorted_by:
            writer = writer.sortBy(*[key.column for key in layout.sorted_by])
    for column in layout.lookup:
        if layout.format == "parquet":
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if layout.lookup and layout.format == "orc":
        writer = writer.option("orc.bloom.filter.columns", ",".join(layout.lookup))
    writer.saveAsTable(name)


def slice_filter(layout: Layout, column: str, lower: Expr, upper: Expr) -> Expr:
    """Rows with ``lower <= column <= upper``, and the partitions that can hold them."""
    kept = F.col(_quoted(column)).between(lower, upper)
    for partition in layout.partitions:
        if partition.column == column and partition.derived and partition.transform != "bucket":
            kept = kept & partition.can_hold(">=", lower) & partition.can_hold("<=", upper)
    return kept


def _partition(text: str, declared: Mapping[str, SqlType]) -> Partition:
    if text in declared:
        return Partition("identity", text, sql_type=declared[text])
    call = _CALL.fullmatch(text)
    transform, column, width = (call[1].lower(), call[2], call[3]) if call else ("", text, None)
    sized = transform in ("bucket", "truncate")
    if not sized and transform not in TIME_TRANSFORMS or sized != (width is not None):
        raise ValueError(f"config 'partitioning': cannot read {text!r}")
    if column not in declared:
        raise ValueError(
            f"config 'partitioning': undeclared column {column!r}; declared: {sorted(declared)}"
        )
    sql_type = declared[column]
    if sized and int(width) < 1:
        raise ValueError(f"config 'partitioning': {text!r} needs a positive number")
    if transform in TIME_TRANSFORMS and sql_type.base not in (
        ("TIMESTAMP",) if transform == "hour" else ("TIMESTAMP", "DATE")
    ):
        raise ValueError(f"config 'partitioning': {transform} does not apply to {sql_type}")
    if transform == "truncate" and not (
        sql_type.is_text or sql_type.base in ("INTEGER", "BIGINT")
    ):
        raise ValueError(f"config 'partitioning': truncate does not apply to {sql_type}")
    return Partition(transform, column, int(width) if sized else None, sql_type)


def _sort_key(text: str, declared: Mapping[str, SqlType]) -> SortKey:
    if text in declared:
        return SortKey(text)
    found = _SORT.fullmatch(text)
    column = found[1] if found else text
    if column not in declared:
        raise ValueError(
            f"config 'sorted_by': undeclared column {column!r}; declared: {sorted(declared)}"
        )
    return SortKey(
        column,
        (found[2] or "").upper() == "DESC",
        # Ascending order puts nulls first and descending order last, unless said.
        (found[3].upper() == "LAST") if found[3] else (found[2] or "").upper() == "DESC",
    )


def _keys(
    config: Mapping[str, Any], declared: Mapping[str, SqlType]
) -> tuple[tuple[tuple[str, ...], ...], tuple[str, ...]]:
    """Unique keys, and columns that rows are looked up by."""
    indexes = []
    for place, entry in enumerate(config.get("indexes", ()), 1):
        _refuse(faults(entry, _INDEX_RULES, ("columns",)), f"config, index {place}")
        indexes.append({"unique": False, "type": "btree", "name": "ix_" + "_".join(entry["columns"])} | entry)
    unique = [*config.get("unique", ()), *(i["columns"] for i in indexes if i["unique"])]
    # Minimum and maximum, all that a brin index needs, are kept for every column anyway.
    lookup = dict.fromkeys(c for i in indexes if i["type"] != "brin" for c in i["columns"])
    used = {c for key in (*unique, *(i["columns"] for i in indexes)) for c in key}
    _refuse([f"no column {c!r} is declared" for c in sorted(used - set(declared))], "config, keys")
    _refuse([f"index {i['name']!r} cannot be a unique one of type {i['type']}"
             for i in indexes if i["unique"] and i["type"] != "btree"], "config")
    _refuse([f"index {i['name']!r} hashes more than one column"
             for i in indexes if i["type"] == "hash" and len(i["columns"]) > 1], "config")
    names = Counter(i["name"] for i in indexes)
    _refuse([f"{times} indexes are called {name!r}" for name, times in names.items() if times > 1], "config")
    return tuple(map(tuple, unique)), tuple(lookup)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
