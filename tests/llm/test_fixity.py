from pyspark.sql import functions as F

from sparkcorr.llm import fixity as x

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, n, change=()):
    rows = [(k, f"http://h/{k}", f"<p>{'x' * (k % 7)}</p>", "clash") for k in range(n)]
    return spark.createDataFrame([c for r in rows if (c := dict(change).get(r[0], r)) is not None], PAGES)


def test_damage_is_located_and_offsets_are_gapless(spark):
    ours = pages(spark, 9000)
    theirs = pages(spark, 9001, {17: (17, "http://h/17", "other", ""), 4100: None, 8999: (8999, None, None, "")})
    rows = x.audit(ours, theirs).collect()
    assert {r.page_id: r.status for r in rows if r.status != "intact"} == {17: "corrupt", 4100: "missing", 8999: "corrupt", 9000: "extra"}
    for archive in {r.archive for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.archive == archive and r.status != "extra"), key=lambda r: r.page_id):
            assert r.offset == at
            at += r.length


def test_only_mismatching_branches_are_descended(spark):
    a, b = (x.records(pages(spark, 9000, c)) for c in ((), {17: (17, "u", "other", "")}))
    found = x.differing_slots(a, b).collect()
    assert [(r.archive, r.slot) for r in found] == [(0, 17)]
    levels = x.tree(a)
    assert [t.count() for t in levels] == [9000, 563, 36, 3]
    assert x.differing_slots(a, a).count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None, ""), (None, "u", "h", ""), (None, None, None, ""), (5, None, None, ""), (5, "u", "h", ""), (5, "u", "h", ""), (-3, "u", "x" * 300_000, "")]
    odd = spark.createDataFrame(rows, PAGES)
    assert {r.status for r in x.audit(odd, odd).collect()} == {"intact"} and x.audit(odd, odd).count() == 7
    less = spark.createDataFrame(rows[:5], PAGES)
    assert x.audit(odd, less).where("status <> 'intact'").count() >= 1
    assert x.audit(odd.limit(0), odd.limit(0)).count() == 0
    assert x.audit(odd.limit(0), odd).where("status = 'extra'").count() == 7
    assert x.decayed(odd).where(F.col("page_id") == 5).count() in (0, 1, 2, 3)


def test_records_that_share_a_slot_are_told_apart_by_digest_and_count(spark):
    def audit(ours, theirs):
        of = lambda bodies: spark.createDataFrame([(5, "u", h, "") for h in bodies] + [(6, "u", "h", "")], PAGES)
        return sorted(r.status for r in x.audit(of(ours), of(theirs)).where("page_id = 5").collect())

    assert audit("aaa", "ab") == ["corrupt", "intact", "missing"]
    assert audit("a", "aaa") == ["extra", "extra", "intact"]
    assert audit("ab", "b") == ["intact", "missing"]
    assert audit("ab", "cd") == ["corrupt", "corrupt"]
    assert audit("ab", "bc") == ["corrupt", "intact"]
    assert audit("a", "bcd") == ["corrupt", "extra", "extra"]


def test_nodes_vouch_for_byte_ranges(spark):
    recs = x.records(pages(spark, 600))
    moved = recs.withColumn("length", F.when(F.col("slot") == 300, F.col("length") + 1).otherwise(F.col("length")))
    assert [(r.archive, r.slot) for r in x.differing_slots(recs, moved).collect()] == [(0, 300)]
    root = x.tree(recs)[-1].first()
    assert root.bytes == recs.agg(F.sum(F.col("length") * F.col("n"))).first()[0]


def test_copies_have_gapless_offsets(spark):
    rows = [(k, "u", "x" * (k or 0), "") for k in (1, 2, 2, 2, 3, None, None)]
    got = sorted((r.archive, r.offset, r.length) for r in x.audit(*[spark.createDataFrame(rows, PAGES)] * 2).collect())
    ends = {}
    for archive, offset, length in got:
        assert offset == ends.get(archive, 0)
        ends[archive] = offset + length
    assert len(got) == 7
