"""CSV ingest, compared with pyarrow's reader on the same bytes."""

import io
import logging
import random

import pyarrow as pa
import pyarrow.csv as pacsv
import pytest

from tablepact.contract import Column
from tablepact.errors import ConformError, LoadError
from tablepact.sources.csv import check_header, header_line, header_names, plan_csv, read_csv

ARROW = {"INTEGER": pa.int32(), "BIGINT": pa.int64(), "DOUBLE PRECISION": pa.float64(),
         "NUMERIC(10,2)": pa.decimal128(10, 2), "NUMERIC(3,2)": pa.decimal128(3, 2),
         "TEXT": pa.string(), "VARCHAR(20)": pa.string(), "TIMESTAMP": pa.timestamp("us"),
         "DATE": pa.date32(), "BOOLEAN": pa.bool_()}


@pytest.fixture
def write(tmp_path):
    def _write(body, name="a.csv"):
        path = tmp_path / name
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
        return str(path)
    return _write


def load(spark, path, *cols, **kw):
    columns = [Column(*c) for c in cols]
    return [tuple(r) for r in read_csv(spark, path, columns, **kw).collect()]


def arrow(body, *cols):
    table = pacsv.read_csv(io.BytesIO(body.encode()), convert_options=pacsv.ConvertOptions(
        column_types={n: ARROW[t] for n, t in cols}))
    return list(zip(*[table.column(n).to_pylist() for n, _ in cols]))


def agrees(spark, write, body, *cols, **kw):
    try:
        want = arrow(body, *cols)
    except (pa.ArrowInvalid, pa.ArrowKeyError):
        want = "error"
    try:
        got = load(spark, write(body), *cols, **kw)
    except Exception as exc:
        assert "LoadError" in str(exc) or isinstance(exc, LoadError), exc
        got = "error"
    assert got == want, body


ORDERS = (("order_id", "INTEGER"), ("amount", "DOUBLE PRECISION"))


@pytest.mark.parametrize("body,cols", [
    ("order_id,amount\n1,10.5\n2,20.0\n", ORDERS),
    ("order_id,amount\n00123,10.5\n00456,20.0\n", (("order_id", "VARCHAR(20)"), ORDERS[1])),
    ("order_id,amount\n1,10.50\n2,20.00\n", (ORDERS[0], ("amount", "NUMERIC(10,2)"))),
    ("amount,order_id\n10.5,1\n", ORDERS),
    ("order_id,amount\r\n1,10.5\r\n", ORDERS),
    ("﻿order_id,amount\n1,10.5\n", ORDERS),
    ("order_id,amount\n\n1,10.5\n\n", ORDERS),
    ("\norder_id,amount\n1,10.5\n", ORDERS),
    ("order_id,amount\n", ORDERS),
    ("order_id,amount\n1\n", ORDERS),
    ("order_id,amount\n1,2,3\n", ORDERS),
    ('order_id,amount\n"1","2"\n', ORDERS),
    ('a,b\n"x""y",\\n\n"p,q",\\"\n', (("a", "TEXT"), ("b", "TEXT"))),
    ('a,b\n,\n"",""\nNULL,nan\n', (("a", "TEXT"), ("b", "TEXT"))),
    ('"a",b\n x , y \n', (("a", "TEXT"), ("b", "TEXT"))),
    ("", ORDERS),
])
def test_bodies(spark, write, body, cols):
    agrees(spark, write, body, *cols)


VALUES = ["", '""', "1", " 1 ", "\t1", "+1", "-1", "0x1f", "1.0", "1.5", " 1.5 ", "10.505", "10.500",
          "1.2300", "12.300", "1.5e1", "NULL", " NULL", '"NULL"', "null", "nan", "NaN", "+nan", "N/A", "#N/A",
          "inf", "Infinity", "true", " true ", "True", "TRUE", "yes", "t", "0", "false", "tRUE",
          "2020-01-02", " 2020-01-02 ", "2020-01-02T03:04:05", "2020-01-02 03:04:05.123456",
          " 2020-01-02 03:04:05", "2020-01-02T03:04:05Z", "2020-1-2", "21474836", "abc", '"a""b"']


@pytest.mark.parametrize("target", [t for t in ARROW if t not in ("NUMERIC(3,2)", "VARCHAR(20)")])
def test_each_value(spark, write, target):
    body = "a,b\n" + "".join(f"{value},{i}\n" for i, value in enumerate(VALUES))
    plan = plan_csv(spark, write(body), [Column("a", target), Column("b", "TEXT")])
    good, bad = plan.split()
    got = {int(r.b): r.a for r in good.collect()}
    wrong = []
    for i, value in enumerate(VALUES):
        try:
            want = arrow(f"a,b\n{value},x\n", ("a", target), ("b", "TEXT"))[0][0]
        except pa.ArrowInvalid:
            want = "error"
        if str(got.get(i, "error")) != str(want):
            wrong.append((value, want, got.get(i, "error")))
    assert not wrong
    assert good.count() + bad.count() == len(VALUES)


def test_integer_and_decimal_overflow(spark, write):
    # pyarrow's reader lets a whole number run past the declared precision; the
    # declared type does not.
    for target in ("INTEGER", "NUMERIC(10,2)"):
        with pytest.raises(Exception, match="LoadError"):
            load(spark, write("a\n2147483648\n"), ("a", target))


def test_written_precision(spark, write):
    for value in ("1.23", "01.23", "0001.5", "9.990", "1.2300", "1e0", "0.05", "12e-1"):
        agrees(spark, write, f"a\n{value}\n", ("a", "NUMERIC(3,2)"))


def test_line_break_in_quotes(spark, write):
    body = 'a,b\nx,"y\nz"\n1,"2\n3,4"\n'
    cols = (("a", "TEXT"), ("b", "TEXT"))
    assert load(spark, write(body), *cols, multi_line=True) == arrow(body, *cols)
    with pytest.raises(Exception, match="LoadError"):
        load(spark, write(body), *cols)
    # Both halves have the right number of fields: only the quotes give it away.
    with pytest.raises(Exception, match="multi_line"):
        load(spark, write('a,b\nx,"y\nz,w"\n'), *cols)
    with pytest.raises(Exception, match="multi_line"):
        load(spark, write('a\n"y\n"\n'), ("a", "TEXT"))
    # A quote inside an unquoted field opens nothing.
    body = 'a,b\n5" pipe,"z"\n6" x 7",y"\n"q""","w""z"\n'
    assert load(spark, write(body), *cols) == arrow(body, *cols)
    with pytest.raises(Exception, match="multi_line"):
        load(spark, write('a,b\n5" pipe,"z\n1,w"\n'), *cols)


def test_quoting_fuzz(spark, write):
    rng = random.Random(11)
    lines = []
    for i in range(400):
        text = "".join(rng.choice('ab,"\\ é😀;') for _ in range(rng.randint(0, 8)))
        lines.append(f'{i},"' + text.replace('"', '""') + '"')
    body = "i,t\n" + "\n".join(lines) + "\n"
    cols = (("i", "INTEGER"), ("t", "TEXT"))
    want = arrow(body, *cols)
    assert sorted(load(spark, write(body), *cols)) == want
    assert sorted(load(spark, write(body), *cols, multi_line=True)) == want


def test_extra_columns(spark, write, caplog):
    path = write("order_id,amount,extra\n1,10.5,x\n2,20.0,y\n")
    with pytest.raises(ConformError, match="not declared"):
        load(spark, path, *ORDERS)
    caplog.clear()
    with caplog.at_level(logging.WARNING):
        assert load(spark, path, *ORDERS, extra_columns="warn") == [(1, 10.5), (2, 20.0)]
    assert sum("csv_header_extra_columns" in r.message for r in caplog.records) == 1


def test_header_rules(spark, write):
    with pytest.raises(ConformError, match="not given"):
        load(spark, write("order_id\n1\n"), *ORDERS)
    with pytest.raises(ConformError, match="duplicate"):
        load(spark, write("order_id,order_id,amount\n1,1,1\n"), *ORDERS)
    assert check_header(["b", "a", "z"], ["a", "b"]) == ["z"]
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        check_header(["a"], ["y", "a", "x"])
    assert header_names('"a,b",c') == ["a,b", "c"]
    assert header_line(spark, write("﻿a,b\r\n1,2\r\n")) == "a,b"
    assert header_line(spark, write("")) == ""
    assert header_line(spark, write("x" * 100_000)) == "x" * 100_000
    with pytest.raises(ValueError, match="exceeds"):
        header_line(spark, write("a," * 600_000 + "\n1\n"))


def test_folder_with_one_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"{i}.csv").write_text(f"order_id,amount\n{i},1.5\n")
    assert sorted(load(spark, str(tmp_path / "d"), *ORDERS)) == [(0, 1.5), (1, 1.5), (2, 1.5)]
    (tmp_path / "d" / "3.csv").write_text("amount,order_id\n9,9\n")
    with pytest.raises(Exception, match="header"):
        load(spark, str(tmp_path / "d"), *ORDERS)


def test_a_data_row_equal_to_the_header_is_kept(spark, write):
    assert load(spark, write("a,b\na,b\n1,2\n"), ("a", "TEXT"), ("b", "TEXT")) == [("a", "b"), ("1", "2")]


def test_invalid_utf8_and_constraints(spark, write):
    with pytest.raises(Exception, match="LoadError"):
        load(spark, write(b"a,b\n\xff,1\n"), ("a", "TEXT"), ("b", "TEXT"))
    plan = plan_csv(spark, write("a,b\nabc,1\n,\n"), [Column("a", "VARCHAR(2)"), Column("b", "INTEGER", False)])
    seen = {(r.column_name, r.rule): (r.violations, r.max_length) for r in plan.report().collect()}
    assert seen[("a", "length")] == (1, 3) and seen[("b", "null")] == (1, None)
    with pytest.raises(ConformError, match="value length 3"):
        plan.verify()


def test_separator_bytes_in_the_data_survive(spark, write):
    assert load(spark, write("a,b\nx\x01\x02\x01y,2\n"), ("a", "TEXT"), ("b", "TEXT")) == [("x\x01\x02\x01y", "2")]
