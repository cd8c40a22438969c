"""Queries of the operators that SQL can express, against their SQL."""

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, difference

from tablepact.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
RNG = random.Random(21)


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])
TABLES = {
    "documents": DOCUMENTS,
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string())]),
}


def differs(spark, folder, name, **rows):
    """What differs between a query and its SQL on the given rows."""
    con = duckdb.connect()
    for table, schema in TABLES.items():
        given = [dict(zip(schema.names, row)) for row in rows.get(table, [])]
        pq.write_table(pa.Table.from_pylist(given, schema), folder / f"{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return difference(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def documents(texts):
    return [(i, t, RNG.choice(["en", "de", None])) for i, t in enumerate(texts)] + [(None, texts[0], "en"), (1, texts[1], "en"), (1, texts[1], "en"), (77, None, None), (78, "", "de")]


def prose(n):
    return " ".join("".join(RNG.choices("abcdefgh", k=5)) for _ in range(n))


def test_pii_rules(spark, tmp_path):
    texts = [
        "SSN 123-45-6789, 234-56-7890", "SSN (1-2-3) 123-45-6789", "pay BE68 5390 0754 7034 BIC GKCCBEBB", "AT61 1904 3002 3457 3201 EUR 50",
        "ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00", "NO12 BE68 5390 0754 7034", "ä PL61109010140000071219812874 IN",
        f"SSN {'x' * 37} 123-45-6789", "BE69 5390 0754 7034 BIC", "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00",
        "mail x@y.org or 10.0.0.1 or 300.1.1.1! call +49 (30) 12345-678, card 4111 1111 1111 1111", "social 987-65-4321 000-12-3456 123-00-4567 123-45-6789",
    ]
    pieces = ["SSN ", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", " ", "AB12 CD34", "123-45-6789", "x", "ö", "iban ", "4111111111111111", "\n", "FR14 2004 1010 0505 0001 3M02 606"]
    texts += ["".join(RNG.choices(pieces, k=RNG.randint(1, 9))) for _ in range(200)]
    assert differs(spark, tmp_path, "op4_pii", documents=documents(texts)) is None


def test_decontamination_rules(spark, tmp_path):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(37)]
    asked = "If a train with Anna Berg travels 120 km in 3 hours how far does the same train with Anna Berg travel in 7 hours"
    sums, short, one = "Compute 12 + 34 - 56 * 78", "red blue green", "Give seven good reasons for rain"
    items = [(0, " ".join(words)), (1, sums), (2, short), (3, one), (4, asked), (5, None), (6, "single"), (None, asked), (7, "five words make one window"), (8, "Say 5 km"), (8, one)]
    other = asked.replace("120", "85").replace("Anna Berg", "Tom").replace("7 hours", "9 days")
    mixed = asked.replace("with Anna Berg travels", "with Tom travels").replace("Anna Berg travel in", "Eva travel in").replace("120", "3").replace("3 hours", "4 hours")
    texts = [
        " ".join(words[:14] + ["xx"] + words[15:22] + ["yy"] + words[23:]), f"{prose(30)} {' '.join(words[8:28])} {prose(30)}", f"{prose(9)} {sums} {prose(9)}",
        "so compute 12 + 34 - 56 * 79", f"compute 12 + 34 - 56 * 78 {prose(5)}", f"{prose(9)} Red, blue, green {prose(9)}", "blue green red", f"{prose(9)} {one} {prose(9)}",
        " ".join(words[8:20]), f"{prose(20)} {asked} {prose(20)}", f"{prose(30)} {other}.", mixed, f"{asked} {other}", "Five words make one window", "say 5 km and Say 7 km",
    ]
    assert differs(spark, tmp_path, "op7_decontamination", documents=documents(texts), benchmark=items) is None


def test_filters_and_spelling_of_awkward_rows(spark, tmp_path):
    texts = ["Hyperion hyperions hyperion " * 40, "hyperio hyperioo ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ", " ".join(["hyperion"] * 30), "x " * 250, " ", "ABC #", "aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa"] * 9
    labels = [(RNG.randrange(60), RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    for name in ("op12_spelling_variants", "op13_filter_audit", "op5_quality_rules"):
        assert differs(spark, tmp_path, name, documents=documents(texts), labels=labels) is None


def test_urls_of_awkward_rows(spark, tmp_path):
    hosts = ["a.example.org", "EXAMPLE.org", "b.test.com", "c.test.com", "d.test.com", "x.co.uk", "y.x.co.uk", "10.0.0.1", "localhost:80", "one.two.net"]
    urls = [f"http://{RNG.choice(hosts)}/{RNG.choice(['en', 'es', 'fr', 'de'])}/{i}{RNG.choice(['', '?q=1', '#z', '.html', '/'])}" for i in range(700)]
    urls += [None, "", "none", "http://", "://", "http://b.test.com", "x://y://z/en/1"] * 2
    labels = [(i, int("d.test.com" not in u and "//c." not in u), RNG.choice([0, 0, 0, 1, None])) for i, u in enumerate(urls[:500])] + [(3, None, None), (4, 1, 0), (4, 0, None), (None, 0, 0)]
    assert differs(spark, tmp_path, "op11_url_filters", pages=list(enumerate(urls)), labels=labels) is None
    assert QUERIES["op11_url_filters"](spark, str(tmp_path)).where("verdict = 'block' and rule is null").count() > 0
    assert differs(spark, tmp_path, "op11_url_filters", pages=list(enumerate(urls))) is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_empty_tables(spark, tmp_path, name):
    assert differs(spark, tmp_path, name) is None
