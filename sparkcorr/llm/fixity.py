"""Merkle fixity audit of WARC archives, in DataFrame operations.

Each page is a WARC record; an archive holds the records of a range of page ids, in order, and so
of offsets. Record digests are the leaves of a tree of fixed fan-out. A node covers a range of slots and of
bytes: its hash is that of its children's slots, lengths and hashes, so it vouches for the order and the offsets
of its records within its range, whatever was lost before it. Two replicas are compared from the roots down: only
the children of nodes that differ are joined, until the slots are found that differ; there records are told apart by
digest and count.

Edge cases: a null url or html is an empty one; records without an id are dealt to archives of
their own by content, in slots by digest; records that share an id share a slot, whose leaf covers
their digests with counts, in order, and equal ones are one row until the result is written; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcorr.llm.common import stash

FANOUT, LEVELS = 16, 3
PER_ARCHIVE = FANOUT**LEVELS


def record_text(page_id: Column, url: Column, html: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """archive, slot, page_id, length, digest and number ``n`` of each kind of record; bytes stay behind."""
    page = F.col(id_col).cast("long")
    text = record_text(page, F.col(url_col), F.col(html_col))
    made = pages.select(page.alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(F.concat(F.lit("record:"), text), 256).alias("digest"))
    by_digest = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    placed = made.select(
        F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE), -1 - F.floor(by_digest / PER_ARCHIVE)).cast("long").alias("archive"),
        F.coalesce(F.pmod("page_id", F.lit(PER_ARCHIVE)), F.pmod(by_digest, F.lit(PER_ARCHIVE))).cast("long").alias("slot"),
        "page_id",
        "length",
        "digest",
    )
    return placed.groupBy(*placed.columns).agg(F.count("*").alias("n"))


def with_offsets(recs: DataFrame) -> DataFrame:
    """The byte offset in its archive of the first record of each kind."""
    before = Window.partitionBy("archive").orderBy("slot", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return recs.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)).cast("long"))


def tree(recs: DataFrame) -> list[DataFrame]:
    """Nodes (archive, node, bytes, hash) by level: leaves first, the root last."""
    child = F.array_sort(F.collect_list(F.struct("digest", "n")))
    told = F.array_join(F.transform(child, lambda x: F.concat_ws("*", x["digest"], x["n"].cast("string"))), ",")
    level = recs.groupBy("archive", F.col("slot").alias("node")).agg(F.sum(F.col("length") * F.col("n")).alias("bytes"), F.sha2(F.concat(F.lit("leaf:"), told), 256).alias("hash"))
    out = [level]
    for _ in range(LEVELS):
        child = F.array_sort(F.collect_list(F.struct("node", "bytes", "hash")))
        told = F.array_join(F.transform(child, lambda x: F.concat_ws(":", x["node"].cast("string"), x["bytes"].cast("string"), x["hash"])), ",")
        level = level.groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(F.sum("bytes").alias("bytes"), F.sha2(F.concat(F.lit("node:"), told), 256).alias("hash"))
        out.append(level)
    return out


def differing_slots(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(archive, slot) of the leaves that differ, found by descending from the roots."""
    levels = [*zip(map(stash, tree(ours)), map(stash, tree(theirs)))][::-1]
    found = None
    for a, b in levels:
        if found is not None:
            parent = [F.col("archive"), F.floor(F.col("node") / FANOUT).cast("long").alias("parent"), F.col("node"), F.col("bytes"), F.col("hash")]
            a, b = (x.select(*parent).join(found, ["archive", "parent"], "left_semi") for x in (a, b))
        vouched = F.struct("bytes", "hash")
        both = a.select("archive", "node", vouched.alias("ours")).join(b.select("archive", "node", vouched.alias("theirs")), ["archive", "node"], "full")
        found = both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("archive", F.col("node").alias("parent"))
    return found.withColumnRenamed("parent", "slot")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of both replicas: archive, page_id, offset, length, digest, status.

    In a slot records of one digest match one for one and are intact. Of ours that are left, as many as the other replica has
    left are corrupt (it has other bytes there), and the rest missing; of theirs that are left, as many as
    go beyond ours are extra (offset and length are the other's).
    """
    ours, theirs = stash(records(ours)), stash(records(theirs))
    slots = stash(differing_slots(ours, theirs))
    place = ["archive", "slot"]
    counts = [side.join(slots, place, "left_semi").select(*place, "digest", F.col("n").alias(name)) for side, name in ((ours, "our_n"), (theirs, "their_n"))]
    both = counts[0].join(counts[1], [*place, "digest"], "full").na.fill(0, ["our_n", "their_n"]).withColumn("same", F.least("our_n", "their_n"))
    before = Window.partitionBy(*place).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*place)
    left = {name: F.col(f"{name}_n") - F.col("same") for name in ("our", "their")}
    judged = stash(both.select(*place, "digest", "same", *(F.coalesce(F.sum(left[k]).over(before), F.lit(0)).alias(f"{k}_before") for k in left), *(F.sum(left[k]).over(whole).alias(f"{k}_left") for k in left)))
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")
    at = (F.col("offset") + (F.col("k") - 1) * F.col("length")).alias("offset")
    own = with_offsets(ours).join(judged, [*place, "digest"], "left").select("*", k)
    counterpart = F.col("our_before") + F.col("k") - F.col("same") <= F.col("their_left")
    status = F.when(F.col("same").isNull() | (F.col("k") <= F.col("same")), "intact").when(counterpart, "corrupt").otherwise("missing")
    extra = with_offsets(theirs).join(judged, [*place, "digest"]).select("*", k).where((F.col("k") > F.col("same")) & (F.col("their_before") + F.col("k") - F.col("same") > F.col("our_left")))
    columns = ["archive", "page_id", at, "length", "digest"]
    return own.select(*columns, status.alias("status")).unionByName(extra.select(*columns, F.lit("extra").alias("status")))


def decayed(pages: DataFrame) -> DataFrame:
    """A second replica for exercises: by each page's own digest, about one in 64 has a changed
    first byte and one in 128 is lost."""
    mark = F.substring(F.md5(F.concat_ws("#", F.coalesce(F.col("url"), F.lit("")), F.col("page_id").cast("string"))), 1, 2)
    changed = F.when(mark.isin("00", "01", "02", "03"), F.concat(F.lit("?"), F.substring(F.col("html"), 2, 2147483647))).otherwise(F.col("html"))
    return pages.where(~mark.isin("fe", "ff")).withColumn("html", changed)
