"""Text forms of numbers and times, built from native expressions.

Spark prints floating-point numbers the Java way (``1.0E10``). The declared text
form is plain inside a window of exponents and ``1e+10`` outside of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exponents for which a floating-point number is written plainly.
TEXT_PLAIN_FROM = -6
TEXT_PLAIN_BELOW = 10
JSON_PLAIN_FROM = -4
JSON_PLAIN_BELOW = 16


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that it may use many times but that is computed once.

    Without this, an expression repeats its inputs wherever it uses them, and a
    deep one outgrows what the compiler of generated code accepts.
    """
    return F.transform(F.array(value), body).getItem(0)


def float_text(number: Column, single: bool = False) -> Column:
    """Shortest text of a float or double: ``1``, ``0.00001``, ``1e+10``, ``nan``."""
    return _render(
        number, single, TEXT_PLAIN_FROM, TEXT_PLAIN_BELOW, exponent_digits=1, whole="",
    )


def float_json(number: Column) -> Column:
    """JSON text of a double: ``1.0``, ``1e-05``, ``1e+16``."""
    return _render(
        number, False, JSON_PLAIN_FROM, JSON_PLAIN_BELOW, exponent_digits=2, whole=".0",
        special=("NaN", "Infinity"),
    )


def _render(
    number: Column,
    single: bool,
    plain_from: int,
    plain_below: int,
    exponent_digits: int,
    whole: str,
    special: tuple[str, str] = ("nan", "inf"),
) -> Column:
    not_a_number, infinite = special
    printed = number.cast("string")
    size, few = F.abs(number), F.length(F.substring_index(printed, "E", 1)) <= (8 if single else 16)
    # Java writes the first plainly and the second with an exponent, as wanted here,
    # and so few digits are the fewest. Numbers in between go digit by digit.
    def limit(value: float) -> Column:
        return F.lit(value).cast("float" if single else "double")

    ordinary = few & (size >= limit(1e-3)) & (size < limit(1e7))
    extreme = few & (
        (size >= limit(float(f"1e{plain_below}"))) | (size < limit(float(f"1e{plain_from}")))
    ) & (size >= limit(1.2e-38 if single else 2.3e-308))
    usual = printed if whole else _without_zero(printed)
    power = F.substring_index(printed, "E", -1)
    shifted = F.concat(
        _without_zero(F.substring_index(printed, "E", 1)),
        F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        _padded(F.ltrim(power, F.lit("-")), exponent_digits),
    )
    sign = F.when(printed.startswith("-"), F.lit("-")).otherwise(F.lit(""))

    def body(parts: Column) -> Column:
        digits, exponent = parts["digits"], parts["exponent"]
        return (
            F.when(digits == "", F.lit("0" + whole))
            .when((exponent >= plain_from) & (exponent < plain_below), _plain(digits, exponent, whole))
            .otherwise(_scientific(digits, exponent, exponent_digits))
        )

    written = named(
        F.abs(number),
        lambda size: named(_shortest(size, single), lambda text: named(_split(text), body)),
    )
    return (
        F.when(F.isnan(number), F.lit(not_a_number))
        .when(size == float("inf"), F.concat(sign, F.lit(infinite)))
        .when(ordinary, usual)
        .when(extreme, shifted)
        .otherwise(F.concat(sign, written))
    )


def _shortest(size: Column, single: bool) -> Column:
    """Java's text of a number, cut to the fewest digits that still read back as it.

    Java before 19 prints a digit too many for some numbers; only long texts, and
    those of the smallest numbers, are tried again.
    """
    printed = size.cast("string")
    longest, width, tiny = (9, "float", 1.2e-38) if single else (17, "double", 2.3e-308)
    written = F.length(F.replace(F.substring_index(printed, "E", 1), F.lit("."), F.lit("")))
    tries = F.when((written < longest - 1) & ((size > tiny) | (size == 0)), printed)
    for digits in (1, longest - 2, longest - 1):
        attempt = F.upper(F.format_string(f"%.{digits - 1}e", size))
        tries = tries.when(attempt.try_cast(width) == size, attempt)
    return tries.otherwise(printed)


def _split(printed: Column) -> Column:
    """Significant digits, and the power of ten of the first of them."""
    mantissa = F.substring_index(printed, "E", 1)
    shift = F.when(
        F.contains(printed, F.lit("E")), F.substring_index(printed, "E", -1).try_cast("int")
    ).otherwise(F.lit(0))
    run = F.replace(mantissa, F.lit("."), F.lit(""))
    significant = F.ltrim(run, F.lit("0"))
    exponent = (
        F.length(F.substring_index(mantissa, ".", 1)) - 1
        - (F.length(run) - F.length(significant)) + shift
    )
    return F.struct(F.rtrim(significant, F.lit("0")).alias("digits"), exponent.alias("exponent"))


def _plain(digits: Column, exponent: Column, whole: str) -> Column:
    return (
        F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .when(
            exponent >= F.length(digits) - 1,
            F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(whole)),
        )
        .otherwise(F.concat(
            F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)
        ))
    )


def _scientific(digits: Column, exponent: Column, exponent_digits: int) -> Column:
    return F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2))))
        .otherwise(F.lit("")),
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        _padded(F.abs(exponent).cast("string"), exponent_digits),
    )


def _without_zero(text: Column) -> Column:
    """``12`` for ``12.0``."""
    return F.when(text.endswith(".0"), F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(text)


def _padded(power: Column, digits: int) -> Column:
    if digits == 1:
        return power
    return F.when(F.length(power) < digits, F.lpad(power, digits, "0")).otherwise(power)


def decimal_text(number: Column, scale: int) -> Column:
    """Text of a decimal; tiny values of a deep scale take exponent form."""
    printed = number.cast("string")
    if scale <= 6:
        return printed
    sign = F.when(printed.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    stripped = F.ltrim(F.replace(F.ltrim(printed, F.lit("-")), F.lit("."), F.lit("")), F.lit("0"))
    digits = F.when(stripped == "", F.lit("0")).otherwise(stripped)
    exponent = F.length(digits) - 1 - scale
    scientific = F.concat(
        sign,
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")),
        F.lit("E"),
        exponent.cast("string"),
    )
    return F.when(exponent < -6, scientific).otherwise(printed)


def timestamp_text(moment: Column) -> Column:
    """``2020-01-02 03:04:05.000000`` for a timestamp without zone."""
    printed = moment.cast("string")
    dotted = F.when(F.length(printed) > 19, printed).otherwise(F.concat(printed, F.lit(".")))
    return F.rpad(dotted, 26, "0")
