"""Fingerprints of values and rows as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.rendering import decimal_text, float_json, timestamp_text

# What counts as a blank between words, and the form of a fold.
PLAIN_BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ")
WIDE_BLANKS = "\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
ALL_BLANKS = "[\\x09-\\x0D\\x1C-\\x20" + WIDE_BLANKS + "]+"
# How the wide blanks begin in UTF-8.
WIDE_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
FOLD_PREFIX = "sha256:"
FOLD_SEPARATOR = "|"


def byte_hash(value: Expr) -> Expr:
    """Hex SHA-256 of the bytes."""
    return F.sha2(value, 256)


def text_hash(text: Expr) -> Expr:
    """Hex SHA-256 of the text with every run of blanks made one space."""
    return byte_hash(F.btrim(_single_spaced(text)))


def _single_spaced(text: Expr) -> Expr:
    """Every run of blanks as one space.

    Almost all texts take the first way, which searches bytes and is several times
    faster than a regular expression over every character.
    """
    spaced = text
    for blank in PLAIN_BLANKS[:-1]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    # Each space becomes an opening and a closing mark; where a closing mark meets
    # an opening one, both go; what is left of a run is one pair.
    opening, closing = "\x02", "\x03"
    paired = F.replace(spaced, F.lit(" "), F.lit(opening + closing))
    joined = F.replace(paired, F.lit(closing + opening), F.lit(""))
    single = F.replace(joined, F.lit(opening + closing), F.lit(" "))
    raw = text.cast("binary")
    special = F.contains(text, F.lit(opening)) | F.contains(text, F.lit(closing))
    wide = F.lit(False)
    for start in WIDE_BYTES:
        wide = wide | F.contains(raw, F.lit(start))
    special = special | ((F.octet_length(text) != F.char_length(text)) & wide)
    return F.when(special, F.regexp_replace(text, ALL_BLANKS, " ")).otherwise(single)


def fold(first: Expr, second: Expr, third: Expr) -> Expr:
    """One fingerprint out of three; a missing part counts as empty."""
    parts = [F.coalesce(part, F.lit("")) for part in (first, second, third)]
    return F.concat(F.lit(FOLD_PREFIX), byte_hash(F.concat_ws(FOLD_SEPARATOR, *parts)))


def record_json(schema: T.StructType, exclude: Sequence[str] = ()) -> Expr:
    """Canonical JSON of a row: sorted keys, no blanks, ASCII only, nulls kept."""
    fields = sorted((f for f in schema.fields if f.name not in exclude), key=lambda f: f.name)
    pairs = [
        F.concat(
            F.lit(json.dumps(field.name) + ":"),
            F.coalesce(
                json_value(F.col("`" + field.name.replace("`", "``") + "`"), field.dataType),
                F.lit("null"),
            ),
        )
        for field in fields
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def record_hash(schema: T.StructType, exclude: Sequence[str] = ()) -> Expr:
    """Hex SHA-256 of the canonical JSON of a row."""
    return byte_hash(record_json(schema, exclude))


def json_value(value: Expr, kind: T.DataType) -> Expr:
    """A value as canonical JSON; null for null."""
    if isinstance(kind, T.StringType):
        return _json_text(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float_json(value.cast("double"))
    if isinstance(kind, T.DecimalType):
        return decimal_text(value, kind.scale)
    if isinstance(kind, T.TimestampNTZType):
        return F.concat(F.lit('"'), timestamp_text(value), F.lit('"'))
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit('"'), F.lower(F.hex(value)), F.lit('"'))
    return value.cast("string")


def _json_text(text: Expr) -> Expr:
    """A quoted JSON string in which everything but printable ASCII is escaped."""
    options = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
    written = F.to_json(F.struct(text.alias("s")), options)
    quoted = F.replace(
        F.substr(written, F.lit(6), F.length(written) - 6), F.lit("\x7f"), F.lit("\\u007f")
    )
    # Escapes are written with capital digits; keep doubled backslashes apart, so
    # that text which looks like an escape stays as it is.
    pieces = F.split(F.replace(quoted, F.lit("\\\\"), F.lit("\x01")), "\\\\u", -1)
    lowered = F.transform(
        pieces,
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(F.lower(F.substring(piece, 1, 4)), F.substr(piece, F.lit(5)))
        ),
    )
    escaped = F.replace(F.array_join(lowered, "\\u"), F.lit("\x01"), F.lit("\\\\"))
    return F.when(text.isNotNull(), F.when(F.contains(quoted, F.lit("\\u")), escaped).otherwise(quoted))
