import __spark_entry__ as contract


def test_flagship_has_rows_and_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.dtypes == [("id1", "string"), ("t1", "bigint"), ("id2", "string"), ("t2", "bigint"), ("lag", "bigint"), ("corr", "double")]
    assert df.count() == 116


def test_every_sql_has_its_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert len(contract.queries()) >= 53
