"""The strict-cast matrix, compared with pyarrow's safe cast value by value."""

import datetime as dt
import decimal
import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.errors import ConformError
from tablepact.functions.casts import strict_cast
from tablepact.sqltypes import parse_type

D = decimal.Decimal

ARROW = {
    "INTEGER": pa.int32(), "BIGINT": pa.int64(), "DOUBLE PRECISION": pa.float64(),
    "NUMERIC(10,2)": pa.decimal128(10, 2), "NUMERIC(38,10)": pa.decimal128(38, 10),
    "NUMERIC(21,2)": pa.decimal128(21, 2), "NUMERIC(5,0)": pa.decimal128(5, 0),
    "TEXT": pa.string(), "TIMESTAMP": pa.timestamp("us"), "DATE": pa.date32(),
}
BAD = "<refused>"


def arrow_results(values, source, target):
    out = []
    for v in values:
        try:
            got = pa.array([v], type=source).cast(ARROW[target], safe=True)[0].as_py()
        except (pa.ArrowInvalid, OverflowError):
            got = BAD
        out.append(got)
    return out


def spark_results(spark, values, source, target):
    df = spark.createDataFrame(list(enumerate(values)), T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("v", source)]))
    value, _ = strict_cast(F.col("v"), source, parse_type(target))
    rows = df.select("i", value.alias("c"), (F.col("v").isNotNull() & value.isNull()).alias("bad"))
    return [BAD if r.bad else r.c for r in sorted(rows.collect(), key=lambda r: r.i)]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b
    return a == b


def check(spark, values, arrow_source, spark_source, target):
    want = arrow_results(values, arrow_source, target)
    got = spark_results(spark, values, spark_source, target)
    wrong = [(v, w, g) for v, w, g in zip(values, want, got) if not same(w, g)]
    assert not wrong, wrong[:10]


TEXTS = [
    None, "", " ", "0", "1", "-1", "+1", " 1", "1 ", "1\n", "007", "-007", "-0", "0x1f", "0X1F",
    "-0x1", "0xffffffff", "0x7fffffff", "0x80000000", "0x0ffffffff", "0x", "0xg", "2147483647",
    "2147483648", "-2147483648", "-2147483649", "0xffffffffffffffff", "0x10000000000000000",
    "9223372036854775807", "9223372036854775808", "-9223372036854775808", "00000000000000000000001",
    "1.0", "1.", ".5", ".", "-", "+", "5.", "1e5", "1E+5", "1e", "e5", "nan", "-nan", "+nan", "NaN",
    "inf", "-INF", "+inf", "Infinity", "infinit", "1.0d", "1f", "0x1p3", "1e400", "-1e400", "1e-400",
    "1_0", "1.23", "1.230", "1.2300000", "1.234", "12345678.99", "123456789.12", "1.23e1", "1.234e1",
    "123e-3", "1200e-2", "0e50", "1e50", "0e-50", "10e-3", "1e-2", "1e+", "0.00e-3", "1e0005",
    "1e99999999999", "-0.00", "-1.50", "99999999.99", "99999999.995", "0.005", "0." + "0" * 48,
    "0" * 50 + "1.5", "12345678901234567890123456789.0123456789", "1.0000000000", "1.00000000001",
    "٣", "1,5", "--1", "+-1", "1e1.5", "true",
]
TIMES = [
    None, "", "2020-01-02", "2020-1-2", "2020-01-02 03", "2020-01-02T03:04", "2020-01-02 03:04:05",
    "2020-01-02 03:04:05.1", "2020-01-02 03:04:05.123456", "2020-01-02 03:04:05.1234567",
    "2020-01-02 03:04:05Z", "2020-01-02 03:04:05+01", "2020-01-02 24:00:00", "2020-01-02 03:04:60",
    "2020-01-02 03:60", "0000-01-01", "0001-01-01", "9999-12-31 23:59:59.999999", "10000-01-01",
    "2020-02-30", "2020-02-29", "1900-02-29", "2020-01-02 03:04:05.", "2020-01-02 ",
    "2020-01-02t03:04:05", "20200102", "2020-01-02 030405", " 2020-01-02", "2020-01-02\n",
    "1582-10-10", "1969-12-31 23:59:59.999999", "today", "now", "epoch", "2020-13-01",
]


@pytest.mark.parametrize("target", ["INTEGER", "BIGINT", "DOUBLE PRECISION", "NUMERIC(10,2)",
                                    "NUMERIC(38,10)", "NUMERIC(5,0)", "TEXT"])
def test_text_values(spark, target):
    check(spark, TEXTS, pa.string(), T.StringType(), target)


@pytest.mark.parametrize("target", ["TIMESTAMP", "DATE"])
def test_text_to_time(spark, target):
    check(spark, TIMES, pa.string(), T.StringType(), target)


def test_random_numeric_text(spark):
    rng = random.Random(7)
    values = []
    for _ in range(3000):
        text = rng.choice(["", "-", "+", ""])
        text += "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 9)))
        if rng.random() < 0.7:
            text += "." + "".join(rng.choice("00012") for _ in range(rng.randint(0, 5)))
        if rng.random() < 0.3:
            text += rng.choice("eE") + rng.choice(["", "+", "-"]) + str(rng.randint(0, 7))
        values.append(text)
    for target in ("INTEGER", "DOUBLE PRECISION", "NUMERIC(10,2)", "NUMERIC(38,10)"):
        check(spark, values, pa.string(), T.StringType(), target)


def test_integers(spark):
    longs = [None, 0, 1, -1, 2**31 - 1, 2**31, -2**31, -2**31 - 1, 2**53, -2**53, 2**53 + 1,
             2**53 + 2, 2**63 - 1, -2**63]
    for target in ("INTEGER", "BIGINT", "DOUBLE PRECISION", "NUMERIC(21,2)", "TEXT"):
        check(spark, longs, pa.int64(), T.LongType(), target)
    ints = [None, 0, 1, -1, 2**31 - 1, -2**31]
    for target in ("INTEGER", "BIGINT", "DOUBLE PRECISION", "NUMERIC(38,10)", "TEXT"):
        check(spark, ints, pa.int32(), T.IntegerType(), target)
    check(spark, [None, 0, -1, 18262, -719162, 2932896, 2932897, -719163], pa.int32(),
          T.IntegerType(), "DATE")
    micros = [None, 0, -1, 1577934245000001, -62135596800000000, 253402300799999999]
    check(spark, micros, pa.int64(), T.LongType(), "TIMESTAMP")


def test_floats(spark):
    values = [None, 0.0, -0.0, 1.0, -2.5, 3.9, 1e9, 1e10, 123456789.123, 1e15, 2.0**31, -2.0**31,
              2.0**62, 2.0**63, 1e300, float("nan"), float("inf"), float("-inf"), 0.1, 1e-5, 1e-6,
              9.99e-7, 1e-7, 1.5e-7, 100.0, 1e22, 1e23, 1 / 3, 9999999999.0, 12345678901.5, 5e-324, -1e-323, 1.5e-323, 2.2250738585072014e-308]
    for target in ("DOUBLE PRECISION", "TEXT"):
        check(spark, values, pa.float64(), T.DoubleType(), target)
    for target in ("INTEGER", "BIGINT"):
        check(spark, [v for v in values if v != 2.0**63], pa.float64(), T.DoubleType(), target)
    assert spark_results(spark, [2.0**63, -2.0**63], T.DoubleType(), "BIGINT") == [BAD, -2**63]
    singles = [struct.unpack("f", struct.pack("f", v))[0] for v in
               (0.1, 1.0, 1e10, 16777216.0, 3.4e38, 1e-7, 123.456, 1e-45, 1e-6, 1e-3, 1e7, 9999999.0, 9.99e-7, 0.00123, 1e9, -2.5e12)]
    check(spark, singles, pa.float32(), T.FloatType(), "TEXT")


def test_random_floats_to_text(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 14) for _ in range(2000)]
    values += [round(rng.uniform(0, 1e6), 2) for _ in range(2000)]
    check(spark, values, pa.float64(), T.DoubleType(), "TEXT")


def test_decimals(spark):
    short = [None, D("0.00"), D("1.50"), D("-0.05"), D("1.25"), D("99999999.99"), D("12345.00"),
             D("3000000000.00")]
    for target in ("INTEGER", "BIGINT", "DOUBLE PRECISION", "NUMERIC(10,2)", "NUMERIC(38,10)",
                   "NUMERIC(5,0)", "TEXT"):
        check(spark, short, pa.decimal128(12, 2), T.DecimalType(12, 2), target)
    deep = [D("0E-7"), D("1E-7"), D("0.000001"), D("1.0000001"), D("-1.5E-6"), D("-1E-7")]
    check(spark, deep, pa.decimal128(20, 7), T.DecimalType(20, 7), "TEXT")
    wide = [D("1.5"), D("1.55"), D("1.555"), D("12345678")]
    check(spark, wide, pa.decimal128(38, 30), T.DecimalType(38, 30), "NUMERIC(10,2)")


def test_times(spark):
    moments = [None, dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(1969, 12, 31, 23, 59, 59, 999999),
               dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 1),
               dt.datetime(2020, 3, 8, 2, 30)]
    for target in ("BIGINT", "TIMESTAMP", "TEXT"):
        check(spark, moments, pa.timestamp("us"), T.TimestampNTZType(), target)
    days = [None, dt.date(2020, 1, 2), dt.date(1, 1, 1), dt.date(1582, 10, 10)]
    for target in ("INTEGER", "DATE", "TIMESTAMP", "TEXT"):
        check(spark, days, pa.date32(), T.DateType(), target)


def test_times_do_not_depend_on_the_session_zone(spark):
    zoned = spark.sql("select timestamp_micros(1583634600000001) as v")
    plain = spark.sql("select timestamp_ntz'2020-03-08 02:30:00.000001' as v")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for df, text in ((zoned, "2020-03-08 02:30:00.000001Z"), (plain, "2020-03-08 02:30:00.000001")):
            have = df.schema["v"].dataType
            out = df.select(
                strict_cast(F.col("v"), have, parse_type("TEXT"))[0].alias("t"),
                strict_cast(F.col("v"), have, parse_type("BIGINT"))[0].alias("n"),
                strict_cast(F.col("v"), have, parse_type("TIMESTAMP"))[0].cast("string").alias("w"),
            ).first()
            assert out.t == text
            assert out.n == 1583634600000001
            assert out.w == "2020-03-08 02:30:00.000001"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_booleans_and_binary(spark):
    for target in ("INTEGER", "BIGINT", "DOUBLE PRECISION", "TEXT"):
        check(spark, [None, True, False], pa.bool_(), T.BooleanType(), target)
    check(spark, [None, b"abc", b"\xff", "é".encode()], pa.binary(), T.BinaryType(), "TEXT")


REFUSED = [
    ("double", "NUMERIC(10,2)"), ("float", "NUMERIC(10,2)"), ("int", "BOOLEAN"), ("string", "BOOLEAN"),
    ("double", "BOOLEAN"), ("void", "BOOLEAN"), ("timestamp_ntz", "DATE"), ("timestamp", "DATE"),
    ("int", "NUMERIC(10,2)"), ("bigint", "NUMERIC(20,2)"), ("tinyint", "NUMERIC(4,2)"),
    ("smallint", "NUMERIC(6,2)"), ("int", "TIMESTAMP"), ("bigint", "DATE"), ("double", "TIMESTAMP"),
    ("double", "DATE"), ("decimal(10,2)", "TIMESTAMP"), ("decimal(10,2)", "DATE"),
    ("decimal(10,2)", "BOOLEAN"), ("timestamp_ntz", "INTEGER"), ("timestamp_ntz", "DOUBLE PRECISION"),
    ("timestamp_ntz", "NUMERIC(20,0)"), ("date", "BIGINT"), ("date", "DOUBLE PRECISION"),
    ("date", "BOOLEAN"), ("boolean", "NUMERIC(5,0)"), ("boolean", "TIMESTAMP"), ("boolean", "DATE"),
    ("binary", "BIGINT"), ("binary", "DATE"), ("array<int>", "TEXT"), ("map<string,int>", "TEXT"),
    ("struct<a:int>", "INTEGER"), ("smallint", "DATE"),
]


@pytest.mark.parametrize("have,want", REFUSED)
def test_refused_by_type(spark, have, want):
    source = spark.sql("select null as v").schema["v"].dataType if have == "void" else \
        T._parse_datatype_string(have)
    with pytest.raises(ConformError, match="v"):
        strict_cast(F.col("v"), source, parse_type(want), "v")


def test_void_gives_typed_nulls(spark):
    for target in ("INTEGER", "NUMERIC(10,2)", "TEXT", "TIMESTAMP", "DATE"):
        value, can_fail = strict_cast(F.col("v"), T.NullType(), parse_type(target))
        out = spark.sql("select null as v").select(value.alias("c"))
        assert out.schema["c"].dataType == parse_type(target).spark and not can_fail
