"""What the operators share: words, work tables, free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.session import scratch_dir

# The blanks that part words, and a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Runtime setting: shuffle files go when the command that wrote them ends, not when the driver's memory is swept.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Runtime setting: rows that a Python task gets at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Runtime setting: bytes that a Python task gets at a time, about.
OCTETS = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialized(frame: DataFrame, name: str, *, sweep: bool = False, batch: int | None = None, octets: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read again.

    It cuts the lineage, survives lost executors, and gives the optimizer the
    true size, by which Spark decides on its own whether a side may be broadcast. With
    ``sweep`` the shuffle files of the write are deleted once it is done. ``batch`` bounds
    the rows that its Python tasks get at a time, where rows are large, and ``octets`` their bytes,
    where some are far larger than others; one larger row comes alone.
    """
    spark = frame.sparkSession
    folder = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    wanted = ({SWEEP: "true"} if sweep else {}) | ({BATCH: str(batch)} if batch else {}) | ({OCTETS: str(octets)} if octets else {})
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        frame.write.parquet(folder)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(frame.schema).parquet(folder)


def text_of(column: Column | str) -> Column:
    """A text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def windows_of(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` words; none in a shorter array.

    ``words`` must be a column of the frame below, as every window reads it again.
    """
    last = F.size(words) - width
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have, in any spelling."""
    taken = {name.lower() for name in frame.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name
