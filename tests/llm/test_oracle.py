"""Every training-data query with SQL gives that SQL's rows."""

import duckdb
import pytest

from sparkcorr.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr) and got


def test_identifiers_of_odd_texts(spark, duck):
    """The SQL finds what a scan finds, where matches repeat, touch and fail."""
    texts = [None, "", "a@b.c a@b.c,a@b.cd@e.f", "1.2.3.4.5.6.7.8 1.2.3.4 256.1.1.1 01.002.0003.4", "4111 1111 1111 1111 4111 1111 1111 1112", "+1 (555) 123-4567 +1 2 +1 (555) 123-4567", "é 😀 a@b.c 1.2.3.4", "4111111111111111" * 3]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    from sparkcorr.llm import pii

    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    got = sorted(tuple(r) for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.BASE_IDENTIFIERS_SQL})").fetchall())
