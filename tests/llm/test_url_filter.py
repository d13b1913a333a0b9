import duckdb
from pyspark.sql import functions as F

from sparkcorr.llm import registry
from sparkcorr.llm import url_filter as u


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    cursor = con.execute(registry.OP7_SQL)
    names = [x[0] for x in cursor.description]
    got = sorted((tuple(r) for r in registry.op7_url_filter(spark, sf_dir).select(*names).collect()), key=repr)
    assert got == sorted(cursor.fetchall(), key=repr)


def judged(spark, urls, listed=(), rules=registry.URL_RULES):
    pages = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(urls)], "page_id long, url string, host string")
    listing = spark.createDataFrame([(x,) for x in listed], "canonical string")
    return {r.page_id: r for r in u.filter_urls(pages, listing, rules).collect()}


def test_rules_and_parts(spark):
    got = judged(spark, ["HTTP://WWW.A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://ÉCom.com/de/", None, "no scheme", "a://", "http://b.net?x=/y", "http://org"])
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(11)] == [
        ("www.a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "/fr", None, "allow"),
        ("Écom.com", "/de/", "com/de/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.net", "", None, "allow"),
        ("org", "", None, "allow"),
    ]


def test_listed_urls_are_blocked_in_any_spelling(spark):
    same = ["http://www.a.net/x/", "https://a.net:443/x?utm_source=f&ref=y#top", "http://A.NET/x"]
    got = judged(spark, [*same, "http://a.net/y", "http://a.net/x?id=1"], listed=["a.net/x"])
    assert [got[k].verdict for k in range(5)] == ["block"] * 3 + ["allow"] * 2


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("a.net/"), "id").alias("canonical"))
    blocks = -(-5000 * u.BITS_PER_KEY // u.BITS)
    bloom = u.blocked_bloom(keys, blocks)
    both = keys.withColumn("in", F.lit(True)).unionByName(spark.range(5000, 25_000).select(F.concat(F.lit("a.net/"), "id").alias("canonical"), F.lit(False).alias("in")))
    may = both.withColumn("block", u._block(F.col("canonical"), blocks)).join(bloom, "block", "left").groupBy("in").agg(F.avg(F.coalesce(u._may_hold(F.col("words"), F.col("canonical")), F.lit(False)).cast("int")).alias("rate"))
    rates = {r["in"]: r["rate"] for r in may.collect()}
    assert rates[True] == 1 and rates[False] < 0.01


def test_large_filters_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(u, "BROADCAST_BYTES", 0)
    assert judged(spark, ["http://a.net/x"], listed=["a.net/x"])[0].verdict == "block"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(empty, u.campaign_urls(empty), registry.URL_RULES).count() == 0
    assert judged(spark, ["http://a.net/x"] * 2, rules=[])[1].verdict == "allow"
