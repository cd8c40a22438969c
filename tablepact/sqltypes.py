"""Declared column types: the accepted grammar and its Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from tablepact.errors import ContractError

# The type names a contract may declare, with the canonical name.
PLAIN_TYPES = {
    "BIGINT": "BIGINT",
    "INT": "INTEGER",
    "INTEGER": "INTEGER",
    "DOUBLE PRECISION": "DOUBLE_PRECISION",
    "TEXT": "TEXT",
    "TIMESTAMP": "TIMESTAMP",
    "DATE": "DATE",
    "BOOLEAN": "BOOLEAN",
}
MAX_PRECISION = 38

_SPARK_TYPES: dict[str, T.DataType] = {
    "BIGINT": T.LongType(),
    "INTEGER": T.IntegerType(),
    "DOUBLE_PRECISION": T.DoubleType(),
    "TEXT": T.StringType(),
    "VARCHAR": T.StringType(),
    "CHAR": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DATE": T.DateType(),
    "BOOLEAN": T.BooleanType(),
}

_EXACT_NUMBER = re.compile(r"(?:NUMERIC|DECIMAL)\(([0-9]+),\s*([0-9]+)\)", re.ASCII)
_SIZED_TEXT = re.compile(r"(VARCHAR|CHAR)\(([0-9]+)\)", re.ASCII)


@dataclass(frozen=True)
class SqlType:
    """A parsed declared type."""

    base: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None

    @property
    def spark(self) -> T.DataType:
        """Spark type of the column. Sized text stays STRING: Spark's own CHAR
        pads on write, and the length is checked where the data is checked."""
        if self.base == "NUMERIC":
            return T.DecimalType(self.precision, self.scale)
        return _SPARK_TYPES[self.base]

    @property
    def is_text(self) -> bool:
        return self.base in ("TEXT", "VARCHAR", "CHAR")

    def __str__(self) -> str:
        if self.base == "NUMERIC":
            return f"NUMERIC({self.precision},{self.scale})"
        if self.length is not None:
            return f"{self.base}({self.length})"
        return self.base.replace("_", " ")


def parse_type(text: str) -> SqlType:
    """Parse a declared type; raise ContractError for anything else."""
    if not isinstance(text, str) or not text.isascii():
        raise ContractError(f"unsupported or invalid SQL type: {text!r}")
    spelled = text.strip().upper()
    if spelled in PLAIN_TYPES:
        return SqlType(PLAIN_TYPES[spelled])
    if found := _SIZED_TEXT.fullmatch(spelled):
        return SqlType(found[1], length=int(found[2]))
    if found := _EXACT_NUMBER.fullmatch(spelled):
        precision, scale = int(found[1]), int(found[2])
        if not 1 <= precision <= MAX_PRECISION:
            raise ContractError(
                f"NUMERIC precision must lie in 1..{MAX_PRECISION}, got {precision}"
            )
        if scale > precision:
            raise ContractError(
                f"NUMERIC scale must lie in 0..{precision}, got {scale}"
            )
        return SqlType("NUMERIC", precision=precision, scale=scale)
    raise ContractError(f"unsupported or invalid SQL type: {text!r}")
