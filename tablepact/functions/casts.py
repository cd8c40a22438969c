"""Strict, lossless casts as native expressions.

``strict_cast`` refuses a pair of types at plan time when no value of the one can
stand for a value of the other, and otherwise returns an expression that is NULL
for every value that would be changed by the conversion. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.errors import ConformError
from tablepact.functions.rendering import decimal_text, float_text, named, timestamp_text
from tablepact.sqltypes import SqlType

# Accepted spellings of text on its way into a typed column.
INTEGER_TEXT = r"^-?[0-9]+\z"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
NAN_TEXT = r"^[+-]?(?i:nan)\z"
INFINITY_TEXT = r"^[+-]?(?i:inf|infinity)\z"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
TIMESTAMP_TEXT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([ T]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9](\.[0-9]{1,6})?)?)?)?\z"
)

# Limits of the representable ranges.
EXACT_DOUBLE_LIMIT = 2**53
LONG_LIMIT = float(2**63)
MIN_DAY, MAX_DAY = -719162, 2932896  # 0001-01-01 .. 9999-12-31
MIN_MICROS, MAX_MICROS = MIN_DAY * 86_400_000_000, (MAX_DAY + 1) * 86_400_000_000 - 1
MAX_DECIMAL_DIGITS = 38
INTEGER_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def strict_cast(
    value: Column, have: T.DataType, want: SqlType, name: str = "value"
) -> tuple[Column, bool]:
    """Return ``(converted, can_fail)``; raise ConformError for a refused pair.

    ``converted`` is NULL where ``value`` is NULL and where the conversion would
    not be lossless; when ``can_fail`` is false the second never happens.
    """
    convert = _converter(have, want)
    if convert is None:
        raise ConformError(
            f"column {name}: cannot cast {have.simpleString()} to {want} without loss"
        )
    return convert(value, have, want)


_Convert = Callable[[Column, T.DataType, SqlType], tuple[Column, bool]]


def _converter(have: T.DataType, want: SqlType) -> _Convert | None:
    if isinstance(have, (T.StringType, T.CharType, T.VarcharType)):
        source = "text"
    elif type(have) in INTEGER_DIGITS:
        source = "integer"
        if want.base == "NUMERIC" and want.precision - want.scale < INTEGER_DIGITS[type(have)]:
            return None
        if want.base == "TIMESTAMP" and not isinstance(have, T.LongType):
            return None
        if want.base == "DATE" and not isinstance(have, T.IntegerType):
            return None
    elif isinstance(have, (T.FloatType, T.DoubleType)):
        source = "float"
    elif isinstance(have, T.DecimalType):
        source = "decimal"
    elif isinstance(have, (T.TimestampType, T.TimestampNTZType)):
        source = "timestamp"
    elif isinstance(have, T.DateType):
        source = "date"
    elif isinstance(have, T.BooleanType):
        source = "boolean"
    elif isinstance(have, T.BinaryType):
        source = "binary"
    elif isinstance(have, T.NullType):
        source = "void"
    else:
        return None
    target = "text" if want.is_text else want.base
    return _CONVERSIONS.get((source, target))


def _plain(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return (value if have == want.spark else value.cast(want.spark)), False


def _text_to_integer(text: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    parsed = text.try_cast(want.spark)
    # Comparing with the printed form settles ordinary values without a regex.
    spelled = (parsed.cast("string") == text) | text.rlike(INTEGER_TEXT)
    width = 16 if want.base == "BIGINT" else 8
    bits = F.conv(F.substr(text, F.lit(3)), 16, -10).try_cast("bigint")
    if width == 8:
        bits = F.when(bits >= 2**31, bits - F.lit(2**32)).otherwise(bits).try_cast("int")
    # Hex is told apart first: a failing parse is expensive.
    return (
        F.when(
            F.lower(F.substring(text, 1, 2)) == "0x",
            F.when(text.rlike(rf"^0[xX][0-9a-fA-F]{{1,{width}}}\z"), bits),
        ).when(parsed.isNotNull() & spelled, parsed),
        True,
    )


def _text_to_double(text: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    infinity = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
        .when(text.rlike(NAN_TEXT), F.lit(float("nan")))
        .when(text.rlike(INFINITY_TEXT), infinity),
        True,
    )


def _text_to_decimal(text: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    scale = want.scale
    # Written without exponent and with no more than `scale` decimals before zeros,
    # nothing can be rounded; this is the path ordinary data takes.
    short = text.rlike(rf"^[+-]?(?=\.?[0-9])[0-9]*\.?[0-9]{{0,{scale}}}0*\z") & (
        F.length(text) <= MAX_DECIMAL_DIGITS
    )
    parts = F.struct(
        F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1).alias("mantissa"),
        # Without exponent 0, and null for one that no number has.
        F.when(F.contains(F.lower(text), F.lit("e")),
               F.regexp_extract(text, r"[eE]([+-]?[0-9]+)\z", 1).try_cast("int"))
        .otherwise(F.lit(0)).alias("power"),
    )
    exact = text.rlike(NUMBER_TEXT) & named(parts, lambda p: _fits_scale(p, scale))
    return F.when(short | exact, text.try_cast(want.spark)), True


def _fits_scale(parts: Column, scale: int) -> Column:
    """Whether digits times a power of ten are whole at a scale."""
    mantissa = parts["mantissa"]
    decimals = F.when(F.contains(mantissa, F.lit(".")),
                      F.length(mantissa) - F.instr(mantissa, ".")).otherwise(F.lit(0))
    digits = F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
    significant = F.rtrim(digits, F.lit("0"))
    written_scale = decimals - parts["power"]
    needed_scale = written_scale - (F.length(digits) - F.length(significant))
    return (written_scale >= -MAX_DECIMAL_DIGITS) & (
        (significant == "")
        | ((F.length(digits) <= MAX_DECIMAL_DIGITS) & (needed_scale <= scale))
    )


def _text_to_timestamp(text: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return (
        F.when(text.rlike(TIMESTAMP_TEXT) & ~text.startswith("0000"),
               text.try_cast(want.spark)),
        True,
    )


def _text_to_date(text: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return (
        F.when(text.rlike(DATE_TEXT) & ~text.startswith("0000"), text.try_cast("date")),
        True,
    )


def _integer_to_integer(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    narrower = isinstance(have, T.LongType) and want.base == "INTEGER"
    return (value.try_cast("int"), True) if narrower else _plain(value, have, want)


def _integer_to_double(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    if not isinstance(have, T.LongType):
        return _plain(value, have, want)
    limit = EXACT_DOUBLE_LIMIT
    return F.when(value.between(-limit, limit), value.cast("double")), True


def _integer_to_timestamp(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return F.when(value.between(MIN_MICROS, MAX_MICROS), _from_micros(value)), True


def _integer_to_date(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return F.when(value.between(MIN_DAY, MAX_DAY), F.date_from_unix_date(value)), True


def _float_to_integer(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    number = value.cast("double")
    whole = (F.rint(number) == number) & (number >= -LONG_LIMIT) & (number < LONG_LIMIT)
    return F.when(whole, number.try_cast(want.spark)), True


def _float_to_text(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return float_text(value, isinstance(have, T.FloatType)), False


def _decimal_to_integer(value: Column, have: T.DecimalType, want: SqlType) -> tuple[Column, bool]:
    converted = value.try_cast(want.spark)
    if have.scale == 0:
        return converted, True
    return F.when(F.floor(value) == value, converted), True


def _decimal_to_decimal(value: Column, have: T.DecimalType, want: SqlType) -> tuple[Column, bool]:
    if have == want.spark:
        return value, False
    converted = value.try_cast(want.spark)
    if want.scale >= have.scale:
        return converted, want.precision - want.scale < have.precision - have.scale
    # Back in the source type, a rounded value differs from the original.
    return F.when(converted.try_cast(have) == value, converted), True


def _decimal_to_text(value: Column, have: T.DecimalType, want: SqlType) -> tuple[Column, bool]:
    return decimal_text(value, have.scale), False


def _timestamp_to_integer(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    if isinstance(have, T.TimestampType):
        return F.unix_micros(value), False
    # From the calendar parts: timestamp_diff would pass through the session zone.
    minutes = (F.unix_date(value.cast("date")).cast("bigint") * 24 + F.hour(value)) * 60 + F.minute(value)
    seconds = F.extract(F.lit("SECOND"), value)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint"), False


def _timestamp_to_timestamp(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return _wall_clock(value, have), False


def _timestamp_to_text(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    text = timestamp_text(_wall_clock(value, have))
    if isinstance(have, T.TimestampType):
        text = F.concat(text, F.lit("Z"))
    return text, False


def _date_to_integer(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    return F.unix_date(value), False


def _binary_to_text(value: Column, have: T.DataType, want: SqlType) -> tuple[Column, bool]:
    text = value.cast("string")
    return F.when(F.is_valid_utf8(text), text), True


def _from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def _wall_clock(value: Column, have: T.DataType) -> Column:
    """A timestamp as its UTC wall clock, whatever the session's time zone."""
    return _from_micros(F.unix_micros(value)) if isinstance(have, T.TimestampType) else value


# The accepted pairs. A pair that is absent is refused by type.
_CONVERSIONS: dict[tuple[str, str], _Convert] = {
    ("text", "INTEGER"): _text_to_integer,
    ("text", "BIGINT"): _text_to_integer,
    ("text", "DOUBLE_PRECISION"): _text_to_double,
    ("text", "NUMERIC"): _text_to_decimal,
    ("text", "text"): _plain,
    ("text", "TIMESTAMP"): _text_to_timestamp,
    ("text", "DATE"): _text_to_date,
    ("integer", "INTEGER"): _integer_to_integer,
    ("integer", "BIGINT"): _integer_to_integer,
    ("integer", "DOUBLE_PRECISION"): _integer_to_double,
    ("integer", "NUMERIC"): _plain,
    ("integer", "text"): _plain,
    ("integer", "TIMESTAMP"): _integer_to_timestamp,
    ("integer", "DATE"): _integer_to_date,
    ("float", "INTEGER"): _float_to_integer,
    ("float", "BIGINT"): _float_to_integer,
    ("float", "DOUBLE_PRECISION"): _plain,
    ("float", "text"): _float_to_text,
    ("decimal", "INTEGER"): _decimal_to_integer,
    ("decimal", "BIGINT"): _decimal_to_integer,
    ("decimal", "DOUBLE_PRECISION"): _plain,
    ("decimal", "NUMERIC"): _decimal_to_decimal,
    ("decimal", "text"): _decimal_to_text,
    ("timestamp", "BIGINT"): _timestamp_to_integer,
    ("timestamp", "text"): _timestamp_to_text,
    ("timestamp", "TIMESTAMP"): _timestamp_to_timestamp,
    ("date", "INTEGER"): _date_to_integer,
    ("date", "text"): _plain,
    ("date", "TIMESTAMP"): _plain,
    ("date", "DATE"): _plain,
    ("boolean", "INTEGER"): _plain,
    ("boolean", "BIGINT"): _plain,
    ("boolean", "DOUBLE_PRECISION"): _plain,
    ("boolean", "text"): _plain,
    ("boolean", "BOOLEAN"): _plain,
    ("binary", "text"): _binary_to_text,
    **{("void", target): _plain for target in (
        "INTEGER", "BIGINT", "DOUBLE_PRECISION", "NUMERIC", "text", "TIMESTAMP", "DATE")},
}
