"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each read as a 23-bit word. The
perfect Golay code has a codeword within three bits of any word; a word's keys are the codewords
within four bits: one if the nearest is at two or less, else six (the nearest, and the five at
four, whose differences from the word share out the other twenty places). So words that differ in
two bits or fewer always share a key. Of four errors over three segments, two segments have at
most two together; a pair of keys from the same two segments therefore meets every linked pair of
fingerprints, and what meets is verified on all 64 bits.

Edge cases: a null, empty or blank text has no word, and the fingerprint zero, which links like
any other; fewer words than a shingle are one shingle; equal fingerprints are always linked;
repeated rows get the same answer; ids that are null take part, but name a group only if it has
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import map_batches, rest, stash
from sparkcorr.llm.components import components
from sparkcorr.shipping import ship

SEED, SHINGLE, MAX_BITS = 42, 4, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # of the cyclic (23, 12) Golay code
#: Bytes of keys a bucket should hold; fingerprints of one key in one piece of work at most.
BUCKET_BYTES, BLOCK = 32 << 20, 4096
SMALL = 8
#: Fingerprints of one key in a chunk beyond which they bypass the key's bucket; fingerprints in a chunk; bytes of a bundle of pieces.
MANY, CHUNK, BUNDLE = 256, 20_000, 4 << 20


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text's ASCII-lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit set where over half of the shingle hashes have it; signed, as Spark holds it."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = np.ascontiguousarray(h[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, lambda ids, texts: [ids, list(map(fingerprint, texts))], "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator: zero for codewords."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _key_offsets() -> np.ndarray:
    """For each syndrome, what turns a word into its codewords within four bits; -1 fills."""
    bits = 1 << np.arange(23, dtype=np.int64)
    sums = [np.zeros(1, np.int64)]
    for weight in range(1, 5):
        last = sums[-1]
        new = (last[:, None] | bits)[(last[:, None] < bits)]
        sums.append(new)
    offsets = [[] for _ in range(2048)]
    for errors in sums:
        for s, e in zip(_syndromes(errors).tolist(), errors.tolist()):
            offsets[s].append(e)
    table = np.full((2048, max(map(len, offsets))), -1, np.int64)
    for s, found in enumerate(offsets):
        table[s, : len(found)] = found
    return table


_OFFSETS: list[np.ndarray] = []


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Twelve-bit indices of each word's codewords within four bits; -1 fills."""
    if not _OFFSETS:
        _OFFSETS.append(_key_offsets())
    offsets = _OFFSETS[0][_syndromes(words)]
    return np.where(offsets >= 0, (words.astype(np.int64)[:, None] ^ offsets) >> 11, -1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) for every pair of segments and of their codewords."""
    u = fps.view(np.uint64)
    parts = [golay_keys(((u >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)) for first, width in SEGMENTS]
    keys, owners = [], []
    for p, (a, b) in enumerate(PAIRS):
        both = (parts[a][:, :, None] << 12) | parts[b][:, None, :]
        ok = (parts[a][:, :, None] >= 0) & (parts[b][:, None, :] >= 0)
        keys.append((both | (p << 24))[ok])
        owners.append(np.nonzero(ok)[0])
    return np.concatenate(keys).astype(np.uint32), np.concatenate(owners)


def _apart(a: np.ndarray, b) -> np.ndarray:
    """Differing bits. (numpy counts the bits of a signed number's absolute value.)"""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of ``fps``: a node takes all that it reaches out of the rest."""
    left, us, vs, todo = fps[1:], [], [], [fps[0]]
    while True:
        while todo and len(left):
            node = todo.pop()
            near = _apart(left, node) <= max_bits
            found = left[near]
            if len(found):
                us.append(np.full(len(found), node))
                vs.append(found)
                todo += list(found)
                left = left[~near]
        if not len(left):
            break
        todo, left = [left[0]], left[1:]
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


#: Rows between stages: keys with fingerprints for a bucket, marked keys, and keys with fingerprints of marked ones.
ENTRIES, MARKS, FREE = range(3)
DEALT_DDL = "bucket int, kind int, keys binary, fps binary"
#: Links; and, with a key, fingerprints ``u`` of a key that too many share.
LINKS_DDL = "u long, v long, key long"


def _blobs(bucket: np.ndarray, kind: int, keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    keys, fps, bucket = keys[order], fps[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(bucket[a]), kind, keys[a:b].tobytes(), fps[a:b].tobytes()


def _deal(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with their fingerprints, by bucket; a key of many in a chunk is marked, and its fingerprints are dealt by themselves."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), CHUNK):
            part = fps[at : at + CHUNK]
            keys, owners = fuzzy_keys(part)
            of = part[owners]
            kinds, code, counts = np.unique(keys, return_inverse=True, return_counts=True)
            bucket = (kinds * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(buckets)
            many = counts > MANY
            free = many[code]
            rows = list(_blobs(bucket[code[~free]], ENTRIES, keys[~free], of[~free]))
            rows += _blobs(bucket[many], MARKS, kinds[many], np.zeros(int(many.sum()), np.int64))
            rows += _blobs((of[free].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets), FREE, keys[free], of[free])
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "keys", "fps"])
            del keys, owners, of, kinds, code, counts, free, rows, columns
    rest()


def _links_in_bucket(table: pa.Table, max_bits: int) -> pa.Table:
    """Links of the keys of a bucket that at most ``BLOCK`` fingerprints share; the fingerprints of others."""
    kinds, key_blobs, fp_blobs = (table.column(n).to_pylist() for n in ("kind", "keys", "fps"))
    take = lambda blobs, kind, dtype: np.frombuffer(b"".join(b for b, k in zip(blobs, kinds) if k == kind), dtype)
    keys, fps = take(key_blobs, ENTRIES, np.uint32), take(fp_blobs, ENTRIES, np.int64)
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(edge)
    shared = (sizes > BLOCK) | np.isin(keys[edge[:-1]], take(key_blobs, MARKS, np.uint32))
    free = np.repeat(shared, sizes)
    of_row = np.repeat(sizes, sizes)
    us, vs = [fps[:0]], [fps[:0]]
    small = (of_row <= SMALL) & ~free
    k, f = keys[small & (of_row > 1)], fps[small & (of_row > 1)]
    for d in range(1, SMALL):
        hit = (k[d:] == k[:-d]) & (_apart(f[d:], f[:-d]) <= max_bits)
        us.append(f[:-d][hit])
        vs.append(f[d:][hit])
    for g in np.flatnonzero((sizes > SMALL) & ~shared):
        u, v = forest(fps[edge[g] : edge[g + 1]], max_bits)
        us.append(u)
        vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
    free_keys = np.concatenate((keys[free], take(key_blobs, FREE, np.uint32))).astype(np.int64)
    free_fps = np.concatenate((fps[free], take(fp_blobs, FREE, np.int64)))
    none = pa.nulls(len(free_keys), pa.int64())
    columns = (
        pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(free_fps)]),
        pa.concat_arrays([pa.array(pairs[:, 1]), none]),
        pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(free_keys)]),
    )
    return pa.Table.from_arrays(columns, names=["u", "v", "key"])


def _links_in_pieces(table: pa.Table, max_bits: int) -> pa.Table:
    """Links of the fingerprints of each piece of a bundle, a piece being a key's one or two blocks."""
    key, i, j, fps = (table.column(n).to_numpy() for n in ("key", "i", "j", "fp"))
    order = np.lexsort((fps, j, i, key))
    key, i, j, fps = key[order], i[order], j[order], fps[order]
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
    found = [forest(fps[a:b], max_bits) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table({"u": np.concatenate([u for u, _ in found]), "v": np.concatenate([v for _, v in found])})


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) of fingerprints at ``max_bits`` or fewer, enough to span every component.

    ``distinct`` has each fingerprint once. Keys travel packed, a blob for each bucket. The fingerprints of
    a key that more than ``BLOCK`` share are dealt to blocks, and each two blocks meet in one piece of work;
    no task holds a whole large key, nor makes its pieces.
    """
    ship(distinct.sparkSession)
    buckets = max(256, -(-distinct.count() * 86 * 12 // BUCKET_BYTES))
    dealt = distinct.select("fp").mapInArrow(lambda b: _deal(buckets, b), DEALT_DDL)
    found = stash(dealt.groupBy("bucket").applyInArrow(lambda t: _links_in_bucket(t, max_bits), LINKS_DDL))
    free = found.where("key is not null").select("key", F.col("u").alias("fp"))
    half = BLOCK // 2
    blocks = stash(free.groupBy("key").agg(F.ceil(F.count("*") / half).cast("int").alias("blocks")))
    size = blocks.agg(F.sum(F.col("blocks").cast("long") * F.col("blocks") * half * 12)).first()[0] or 0
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))).alias("other")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pieces = free.join(blocks, "key").select("key", "fp", block.alias("block"), other).select("key", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    bundle = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(64, -(-size // BUNDLE)))).alias("bundle")
    hot = pieces.groupBy(bundle).applyInArrow(lambda t: _links_in_pieces(t, max_bits), "u long, v long")
    return found.where("key is null").select("u", "v").unionByName(hot)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _named(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``fps`` (doc_id, fp)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys meet pairs of at most four differing bits")
    firsts = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), max_bits))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # written first, so that the join's two sides are dealt alone and a large group's can be split
    named = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return stash(rooted.join(named, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, *, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is named by its least id."""
    fps = stash(fingerprints(docs, id_col, text_col))
    return fps.join(_named(fps, max_bits), "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the least id, and of several with
    that id the one whose text has the least hash. Rows without an id stay. Of rows with one id and one text that stand for
    a component, which differ in other columns at most, the one with the least hash stays."""
    text = F.col("text").cast("string")
    hashed = map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")),
        lambda ids, hashes, texts: [ids, hashes, list(map(fingerprint, texts))],
        "doc_id long, th long, fp long",
    )
    fps = stash(hashed)
    row = F.struct("doc_id", "th")
    rooted = fps.where("doc_id is not null").join(_named(fps, max_bits).select("fp", "root"), "fp")
    # partial counts of rows go before the shuffle, so that a component of many copies is one entry a task
    counted = rooted.groupBy("root", "doc_id", "th").count()
    winners = stash(counted.groupBy("root").agg(F.min_by(F.struct("doc_id", "th", "count"), row).alias("w")).select("w.*"))
    alone, repeated = winners.where("count = 1"), winners.where("count > 1").select("doc_id", "th")
    rows = docs.withColumn("__th", F.xxhash64(docs["text"].cast("string")))
    # a merge join at every size: texts move once, and ids are never sent to all executors
    match = lambda side: (rows["doc_id"].cast("long") == side["doc_id"]) & (rows["__th"] == side["th"])
    out = docs.where(F.col("doc_id").isNull())
    if repeated.isEmpty():
        kept = winners.select("doc_id", "th").hint("merge")
        return out.unionByName(rows.join(kept, match(kept), "left_semi").drop("__th"))
    kept = alone.select("doc_id", "th").hint("merge")
    out = out.unionByName(rows.join(kept, match(kept), "left_semi").drop("__th"))
    several = rows.join(repeated.hint("merge"), match(repeated), "left_semi")
    whole = F.struct(*(several[c] for c in docs.columns))
    order = F.xxhash64(*(several[c] for c, kind in docs.dtypes if not kind.startswith("map")))
    return out.unionByName(several.groupBy("doc_id", "__th").agg(F.min_by(whole, order).alias("row")).select("row.*"))
