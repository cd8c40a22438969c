"""Declared reads: the single-query gate, the bind check and the read context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from functools import cache, partial
from textwrap import shorten

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablepact.errors import ReadError
from tablepact.sources.pruning import with_partition_bounds

# Fixed value: how much of a refused query is quoted.
MAX_EXCERPT = 200

# Parts of a plan that run code outside of the query engine, and how a
# plan's JSON names the class of each of its nodes and expressions. A quote within a text
# is escaped there, so no literal looks like one.
_CLASS = re.compile(r'"class":"[\w.$]*\.(\w+)"')
_RUNS_A_COMMAND = {"ScriptTransformation"}
_CALLS_JAVA = {"CallMethodViaReflection", "TryReflect"}

BIND_REPORT_SCHEMA = "read string, ok boolean, message string"


def read_text(spark: SparkSession, sql: str) -> str:
    """The query without terminators and without comments that follow one."""
    query = re.sub(r"[\s;]+\Z", "", sql) if isinstance(sql, str) else ""
    at = query.find(";")
    while at >= 0:
        # A semicolon within a text has no query before it.
        if _parses(spark, _as_subquery(query[:at])) and _says_nothing(spark, query[at:].replace(";", " ")):
            query = query[:at]
        at = query.find(";", at + 1)
    if not query.strip():
        raise ValueError("a read must be exactly one read query, and this one is empty")
    return query.strip()


def _says_nothing(spark: SparkSession, text: str) -> bool:
    """Whether there are only blanks and comments: two commands that nothing else may precede still parse after it."""
    return all(_parses(spark, f"{text}\n{command}") for command in ("explain select 1", "use a"))


def _parses(spark: SparkSession, text: str) -> bool:
    try:
        _parsed(spark, text)
    except ParseException:
        return False
    return True


def _parsed(spark: SparkSession, text: str) -> None:
    """Parse only: no names are looked up."""
    spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def ensure_single_read(spark: SparkSession, sql: str) -> str:
    """Raise ValueError unless the text is exactly one query; return its text.

    Spark's own parser decides. The text is placed where only a query may stand,
    in two ways that cannot both be escaped by closing the parenthesis early.
    """
    query = read_text(spark, sql)
    for wrapped in (_as_cte(query), _as_subquery(query)):
        try:
            _parsed(spark, wrapped)
        except ParseException as exc:
            raise ValueError(
                f"only a single read query is accepted, exactly one statement: "
                f"{_excerpt(sql)} [{_excerpt(exc.getMessage() or str(exc))}]"
            ) from exc
    return query


def check_binds(spark: SparkSession, sql: str) -> None:
    """Raise unless the query resolves against the catalog; no data is scanned."""
    _bound(spark, ensure_single_read(spark, sql))


def bind_report(spark: SparkSession, reads: Mapping[str, str]) -> DataFrame:
    """Outcome of the bind check of every read."""
    rows = []
    for name, sql in reads.items():
        try:
            check_binds(spark, sql)
            rows.append((name, True, ""))
        except (ValueError, ReadError) as exc:
            rows.append((name, False, str(exc)))
    return spark.createDataFrame(rows, BIND_REPORT_SCHEMA)


def fetch(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of one read query, lazily; result columns must have distinct names.

    Scans of partitioned tables read only the partitions that the query's conditions leave.
    """
    result = _bound(spark, ensure_single_read(spark, sql))
    repeated = sorted(n for n, times in Counter(result.columns).items() if times > 1)
    if repeated:
        raise ValueError(f"duplicate column name(s) in SELECT result: {repeated}")
    return with_partition_bounds(spark, result)


class ReadContext:
    """What user code sees: the declared reads, each resolved once."""

    def __init__(self, spark: SparkSession, reads: Mapping[str, str]) -> None:
        self._frames = {name: cache(partial(_named, spark, name, sql)) for name, sql in reads.items()}

    def read(self, name: str) -> DataFrame:
        """The rows of a declared read.

        The frame is lazy: a query that resolves but fails while running does so
        when the table is written.
        """
        frame = self._frames.get(name)
        if frame is None:
            raise ReadError(f"{name!r} is not among the reads of this contract: {sorted(self._frames)}")
        return frame()


def _named(spark: SparkSession, name: str, sql: str) -> DataFrame:
    try:
        return fetch(spark, sql)
    except (ValueError, ReadError, PySparkException) as exc:
        raise ReadError(f"read {name!r} cannot be used: {exc}") from exc


def _as_subquery(query: str) -> str:
    return f"SELECT * FROM (\n{query}\n) AS pact_read"


def _as_cte(query: str) -> str:
    return f"WITH pact_read AS (\n{query}\n) SELECT 1"


def _bound(spark: SparkSession, query: str) -> DataFrame:
    """The query's frame, analyzed once; its plan may not leave the engine."""
    try:
        frame = spark.sql(query)
    except AnalysisException as exc:
        raise ReadError(f"read does not bind: {exc}") from exc
    used = set(_CLASS.findall(frame._jdf.queryExecution().analyzed().toJSON()))
    if used & _RUNS_A_COMMAND:
        raise ReadError(f"a read may not run a command: {_excerpt(query)}")
    if used & _CALLS_JAVA:
        raise ReadError(f"a read may not call Java methods: {_excerpt(query)}")
    return frame


def _excerpt(text: str) -> str:
    return shorten(text, MAX_EXCERPT, placeholder=" [...]")
