"""CSV files, read without losing what was written.

Every field is read as text and then cast to its declared type by the strict
rules, so ``00123`` stays text in a text column and ``10.505`` is refused by
``NUMERIC(10,2)``.
"""

from __future__ import annotations

import csv
import logging
from collections import Counter
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import Column, check_csv_location
from tablepact.errors import ConformError, LoadError
from tablepact.functions.casts import strict_cast
from tablepact.operators.checks import Check, Checked, Converted
from tablepact.operators.conform import check_names

logger = logging.getLogger("tablepact.csv")

# The header bound, and the spellings with a meaning of their own.
MAX_HEADER_BYTES = 1_048_576
NULL_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
TRUE_SPELLINGS = ("1", "true", "True", "TRUE")
FALSE_SPELLINGS = ("0", "false", "False", "FALSE")
BLANKS = " \t"

_CORRUPT = "__pact_corrupt"
_RECORD = "__pact_record"
# Never part of a line of text: keeps the line whole while Spark skips headers.
_NO_SEPARATOR = "\x01\x02\x01"
_PARSING = {
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _CORRUPT,
    "nullValue": "",
}


def header_line(spark: SparkSession, location: str, skip_blank: bool = False) -> str:
    """First line of the file, or of one file of the folder; ``""`` if there is none."""
    lines = spark.read.text(check_csv_location(location)).where("_metadata.file_block_start = 0")
    if skip_blank:
        lines = lines.where(F.btrim("value") != "")
    # Cut where it is read: a file without line ends does not come here whole.
    found = lines.select(F.substring("value", 1, MAX_HEADER_BYTES + 1).alias("value")).limit(1).collect()
    line = found[0].value if found else ""
    if len(line.encode()) > MAX_HEADER_BYTES:
        raise ValueError(f"csv header line exceeds {MAX_HEADER_BYTES} bytes: {location}")
    return line


def header_names(line: str) -> list[str]:
    """Column names in a header line."""
    return next(csv.reader([line]), [])


def check_header(header: Sequence[str], declared: Sequence[str]) -> list[str]:
    """The names in only one of the two; declared ones among them are refused, others returned."""
    single = set(header).symmetric_difference(declared)
    absent = single.intersection(declared)
    if absent:
        raise ValueError(f"the csv header lacks {sorted(absent)}")
    return sorted(single)


def warn_extras(relation: str, extras: Sequence[str]) -> None:
    """The one structured warning about columns the contract does not declare."""
    if extras:
        logger.warning(
            "csv_header_extra_columns node=%s columns=%s (fields of these names are skipped)",
            relation, sorted(extras),
        )


def plan_csv(
    spark: SparkSession,
    location: str,
    columns: Sequence[Column],
    extra_columns: str = "raise",
    multi_line: bool = False,
    relation: str = "",
) -> Checked:
    """Rows of a CSV file, or of a folder of files with one header, as declared.

    Files are read in splits, line by line. A record that continues on the next
    line is found by its open quote and fails the load; pass ``multi_line=True`` to accept such records, at the price of one task per file.
    """
    try:
        line = header_line(spark, location, skip_blank=True)
    except (PySparkException, ValueError) as exc:
        raise LoadError(f"csv read failed for {relation or location}: {exc}") from exc
    header = header_names(line)
    if not header:
        raise LoadError(f"csv source has no header line: {location}")
    extras = sorted(set(header) - {c.name for c in columns})
    warn_extras(relation or location, extras)
    repeated = sorted(name for name, times in Counter(header).items() if times > 1)
    if repeated:
        raise ConformError(f"csv header has duplicate column(s): {repeated}")
    check_names(header, columns, extra_columns)

    fields = _whole_records(spark, location, header) if multi_line else _lines(
        spark, location, line, len(header)
    )
    at = {name: F.col(f"f{i}") for i, name in enumerate(header)}
    converted = {c.name: _converted(c, at[c.name]) for c in columns}
    broken = Check(
        "*", "record", F.col("broken"), LoadError,
        f"csv read failed for {_plain(relation or location)}: {{count}} record(s) have a wrong "
        "number of fields or a quoted line break (multi_line=True accepts line breaks)",
    )
    return Checked(
        fields, columns, converted, LoadError,
        "csv read failed: column {name}: {{count}} value(s) are not valid {type}", [broken],
    )


def read_csv(
    spark: SparkSession,
    location: str,
    columns: Sequence[Column],
    extra_columns: str = "raise",
    multi_line: bool = False,
) -> DataFrame:
    """The declared table from a CSV file; the first bad record fails its job."""
    return plan_csv(spark, location, columns, extra_columns, multi_line).strict()


def _lines(spark: SparkSession, location: str, line: str, width: int) -> DataFrame:
    """Fields ``f0..`` and a ``broken`` flag, one record per line."""
    # One text column named like the whole header line: Spark skips the header of
    # every file and refuses a file whose header differs.
    whole = T.StructType([
        T.StructField(line, T.StringType()), T.StructField(_CORRUPT, T.StringType())
    ])
    lines = (
        spark.read.schema(whole)
        .options(**{**_PARSING, "quote": "", "escape": ""})
        .option("header", True).option("enforceSchema", False).option("sep", _NO_SEPARATOR)
        .csv(location)
        .toDF("line", _CORRUPT)
        .select(F.coalesce(_CORRUPT, "line").alias("line"))
    )
    names = ", ".join(f"f{i} string" for i in range(width))
    parsed = F.from_csv("line", f"{names}, {_CORRUPT} string", _PARSING)
    return lines.select(parsed.alias(_RECORD), _open_ended(F.col("line")).alias("open")).select(
        *[F.col(f"{_RECORD}.f{i}") for i in range(width)],
        (F.col(f"{_RECORD}.{_CORRUPT}").isNotNull() | F.col("open")).alias("broken"),
    )


def _open_ended(line: Expr) -> Expr:
    """Whether a quoted field is still open at the end of the line.

    Goes from quote to quote: one opens at the start of a field or right after a
    closing one (an escaped quote), and is plain text elsewhere.
    """
    parts = F.split(line, '"')
    before_quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)
    still_open = F.aggregate(
        before_quotes,
        F.lit(False),
        lambda inside, before: ~inside & ((before == "") | before.endswith(",")),
    )
    return F.contains(line, F.lit('"')) & still_open


def _whole_records(spark: SparkSession, location: str, header: Sequence[str]) -> DataFrame:
    """As ``_lines``, for records that may span lines; a file is one task."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, _CORRUPT]])
    rows = (
        spark.read.schema(schema).options(**_PARSING)
        .option("header", True).option("enforceSchema", False).option("multiLine", True)
        .csv(location)
    )
    rows = rows.toDF(*[f"f{i}" for i in range(len(header))], _CORRUPT)
    return rows.select(
        *[f"f{i}" for i in range(len(header))], F.col(_CORRUPT).isNotNull().alias("broken")
    )


def _converted(column: Column, field: Expr) -> Converted:
    """A field as its declared type."""
    want = column.sql_type
    if want.is_text:
        text = F.coalesce(field, F.lit(""))
        # Bytes that are not UTF-8 arrive as the replacement character.
        return Converted(F.when(~F.contains(text, F.lit("�")), text), True, text)
    given = F.when(~field.isin(*NULL_SPELLINGS), field)
    if want.base == "BOOLEAN":
        value = F.when(given.isin(*TRUE_SPELLINGS), F.lit(True)).when(
            given.isin(*FALSE_SPELLINGS), F.lit(False)
        )
        return Converted(value, True, given)
    text = given if want.base == "TIMESTAMP" else F.btrim(given, F.lit(BLANKS))
    value, _ = strict_cast(text, T.StringType(), want, column.name)
    if want.base == "NUMERIC":
        value = F.when(_written_digits(text) <= want.precision, value)
    return Converted(value, True, given)


def _written_digits(text: Expr) -> Expr:
    """Digits a number is written with, which in a file may not exceed the precision."""
    mantissa = F.regexp_extract(text, "^[^eE]*", 0)
    decimals = F.when(F.contains(mantissa, F.lit(".")),
                      F.length(mantissa) - F.instr(mantissa, ".")).otherwise(F.lit(0))
    power = F.coalesce(F.regexp_extract(text, r"[eE](.*)\z", 1).try_cast("int"), F.lit(0))
    digits = F.length(F.replace(F.ltrim(mantissa, F.lit("+-0")), F.lit("."), F.lit("")))
    return digits + F.greatest(power - decimals, F.lit(0))


def _plain(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")
