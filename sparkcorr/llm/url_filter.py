"""URL rules and a listed-URL filter, all in Spark expressions.

Rules name a host suffix and a path prefix; the longest that fits decides. Other URLs are looked
up in a list: a blocked Bloom filter (512-bit blocks, each the union of its keys' six bits) tells
which can be listed, and only those go to the exact hash join that removes false positives.

Edge cases: a null URL, or one without ``://``, has empty host and path, no rule, and is allowed;
repeated rows are judged one by one; an empty list or table gives the plain result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES, BITS_PER_KEY = 512, 6, 16
#: A filter of at most so many bytes is sent to all executors; a larger one is joined by block.
BROADCAST_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; ``rules``: (verdict, host/path)."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def canonical(host: Column, path: Column, url: Column) -> Column:
    """One spelling of a URL: no scheme, ``www.``, port 80 or 443, tracking parameters, fragment or
    final slash; parameters in order. Null without a host."""
    site = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    page = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)(=|$)")))
    return F.when(host != "", F.concat(site, page, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def parsed(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = url_parts(F.col("__url"))
    out = out.withColumn("host", host).withColumn("path", path)
    return out.withColumn("canonical", canonical(F.col("host"), F.col("path"), F.col("__url"))).withColumn("__match", matching_rule(F.col("host"), F.col("path"), rules))


def campaign_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list for ``filter_urls``: canonical URLs that some page names with a campaign tag."""
    tagged = pages.where(F.col(url_col).rlike("[?&]utm_[a-z]+="))
    return parsed(tagged, [], url_col, url_col).where("canonical is not null").select("canonical").distinct()


def _bits(key: Column) -> list[Column]:
    """Positions 0..511 of a key's bits, nine hash bits each."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(BITS - 1)).cast("int") for i in range(HASHES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words): eight 64-bit words a block; blocks without keys have no row."""
    key = F.col("canonical")
    masks = []
    for w in range(BITS // 64):
        mask = F.lit(0).cast("long")
        for b in _bits(key):
            bit = F.expr("1L")
            mask = mask.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", bit, b.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        masks.append(F.bit_or(mask).alias(f"w{w}"))
    return listed.groupBy(_block(key, blocks).alias("block")).agg(*masks).select("block", F.array(*(f"w{w}" for w in range(BITS // 64))).alias("words"))


def _may_hold(words: Column, key: Column) -> Column:
    out = F.lit(True)
    for b in _bits(key):
        word = F.get(words, F.shiftright(b, 6))
        out = out & (F.call_function("shiftleft", F.expr("1L"), b.bitwiseAND(F.lit(63))).bitwiseAND(word) != 0)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every page's host, path, rule and verdict; ``listed`` has distinct canonical URLs to block.

    ``possible`` tells what the Bloom filter let through, ``listed`` what the exact join confirmed.
    """
    keys = listed.count()
    blocks = max(1, -(-keys * BITS_PER_KEY // BITS))
    bloom = blocked_bloom(listed, blocks)
    if blocks * BITS // 8 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    judged = parsed(pages, rules, id_col, url_col)
    ruled = F.col("__match").isNotNull()
    probed = judged.withColumn("block", F.when(~ruled, _block(F.col("canonical"), blocks)))
    open_ones = probed.where(F.col("block").isNotNull()).join(bloom, "block", "left").withColumn("possible", F.coalesce(_may_hold(F.col("words"), F.col("canonical")), F.lit(False)))
    hits = open_ones.where("possible").join(listed.select("canonical", F.lit(True).alias("listed")), "canonical", "left")

    def result(df: DataFrame, possible: Column, is_listed: Column) -> DataFrame:
        verdict = F.coalesce(F.col("__match.verdict"), F.when(is_listed, "block").otherwise("allow"))
        return df.select("page_id", "host", "path", F.col("__match.rule").alias("rule"), verdict.alias("verdict"), possible.alias("possible"), is_listed.alias("listed"))

    no = F.lit(False)
    return (
        result(probed.where(F.col("block").isNull()), no, no)
        .unionByName(result(open_ones.where(~F.col("possible")), no, no))
        .unionByName(result(hits, F.lit(True), F.coalesce(F.col("listed"), no)))
    )
