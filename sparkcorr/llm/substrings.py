"""Exact removal of byte strings that a document with a smaller id has, by suffix arrays of shards.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller
id. Sorting the suffixes of a whole corpus would move every suffix; instead

1. every window of ``SPAN`` bytes picks an *anchor* in it, by its content alone (a mod-minimizer:
   the least hashed 15-gram decides), so equal windows pick the same bytes. An anchor is ``KEY``
   bytes; its *context* is all windows that hold it. Hashes of both go, packed, to a bucket.
2. where a smaller document has the same context, all of its windows go. Where a smaller document
   has the anchor in another context, some may.
3. the contexts left over by 2, a few hundredths of the text, are gathered in shards by anchor.
   Each shard's suffixes are sorted by induced sorting, and permuted common prefixes of ``SPAN``
   or more tell which windows are equal, and whether a smaller document has them.
4. documents and what was found for them meet in groups of bounded size, and the bytes are cut.

Repeated contexts are reduced to the smallest document before they travel, so that a passage in a
third of all documents sends one entry a task and not one a document. An anchor in many different
contexts, as a phrase of less than ``SPAN`` bytes in a third of all documents is, passes its bucket by:
its contexts are dealt by their own hashes for step 2, and window by window for step 3. Contexts are
equal if two hashes of 64 bits each are; the windows of step 3 are compared byte by byte.

Edge cases: a null or empty text has no byte and no removal; documents without an id count as
larger than all others, so that they are cut but cut no other; rows that share an id do not cut
each other; texts shorter than ``SPAN`` bytes match nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import release, stash
from sparkcorr.llm.suffix_array import permuted_lcp, suffix_array, words8
from sparkcorr.shipping import ship

SPAN, KEY, GRAM = 50, 33, 15
WINDOWS = SPAN - KEY + 1  # that hold an anchor
SIDE = WINDOWS - 1
CONTEXT = KEY + 2 * SIDE
NO_ID = (1 << 63) - 1
GAP = 0xFF  # no byte of UTF-8
#: Bytes of text in one numpy slice, in one map-side reduction, in one group of documents.
SLICE, CHUNK, GROUP = 1 << 18, 6 << 20, 8 << 20
#: Bytes of text for which there is one bucket of anchors, and one shard of contexts.
BUCKET, PER_SHARD = 16 << 20, 4 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
#: Contexts of one anchor, in a chunk and in a bucket, beyond which they are dealt by themselves.
MANY, TOO_MANY = 256, 16384


class Slice:
    """Texts in one buffer, apart by gaps, with their anchors: position, document, hashes.

    ``a`` and ``b`` are two hashes of the context; ``key`` and ``bucket_hash`` 32 bits each of the anchor's.
    """

    def __init__(self, texts: list[bytes]):
        gap = bytes([GAP]) * SPAN
        self.data = np.frombuffer(gap + gap.join(texts) + gap + gap, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + SPAN)
        self.starts = self.ends - sizes
        words = words8(self.data)
        self.at = self._anchors(words)
        self.doc = np.searchsorted(self.starts, self.at, "right") - 1
        keys = self._hash(words, (0, 8, 16, 24, KEY - 8), _A)
        sides = (*range(-SIDE, SPAN - 8, 8), SPAN - 8)
        self.a, self.b = self._hash(words, sides, _B), self._hash(words, sides[::-1], _C)
        self.bucket_hash = (keys & _LOW).astype(np.int64)
        self.key = (keys >> np.uint64(32)).astype(np.uint32)

    def _anchors(self, words: np.ndarray) -> np.ndarray:
        grams = (words[: -(GRAM - 8)] * _A) ^ (words[GRAM - 8 :] * _B)
        grams ^= grams >> np.uint64(29)
        grams *= _A
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, reach = SPAN - GRAM + 1, 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        n = len(self.data) - SPAN + 1
        window = np.arange(n)
        picked = window + ((least[:n] & _LOW).astype(np.int64) - window) % WINDOWS
        gaps = np.concatenate(([0], np.cumsum(self.data == GAP)))
        self.whole = gaps[SPAN:] == gaps[:-SPAN]  # windows inside one text
        mark = np.zeros(len(self.data), bool)
        mark[picked[self.whole]] = True
        return np.flatnonzero(mark)

    def _hash(self, words: np.ndarray, offsets: tuple[int, ...], factor: np.uint64) -> np.ndarray:
        out = np.zeros(len(self.at), np.uint64)
        for o in offsets:
            out = (out ^ words[self.at + o]) * factor
            out ^= out >> np.uint64(32)
        out *= _A
        return out ^ (out >> np.uint64(31))

    def contexts(self, which: np.ndarray) -> np.ndarray:
        return self.data[(self.at[which] - SIDE)[:, None] + np.arange(CONTEXT)]


def slices(texts: list[bytes]) -> Iterator[tuple[int, Slice]]:
    """(index of the first text, slice); a slice is about ``SLICE`` bytes, or one longer text."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + SPAN
        if size >= SLICE or k == len(texts) - 1:
            yield first, Slice(texts[first : k + 1])
            first, size = k + 1, 0


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _packed(rows: np.ndarray) -> bytes:
    """Rows byte by byte: first bytes of all, then second ones; high bytes are mostly zero, and compress."""
    return rows.view(np.uint8).reshape(len(rows), -1).T.tobytes()


def _unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T for b in blobs if b]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.zeros(0, kind)


def _split(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, its rows packed) for each distinct key."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cut = [*_runs(key).tolist(), len(key)]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(key[a]), _packed(rows[a:b])


#: A context in a document; what a document is told of one: the windows that go; and one whose bytes are asked for.
ENTRY = np.dtype([("doc", np.int64), ("a", np.uint64), ("b", np.uint64), ("key", np.uint32), ("grp", np.int32)])
TELL = np.dtype([("doc", np.int64), ("a", np.uint64), ("b", np.uint64), ("windows", np.uint32)])
ASKED = np.dtype([("doc", np.int64), ("a", np.uint64), ("b", np.uint64), ("grp", np.int32), ("part", np.uint8), ("bytes", np.uint8, (CONTEXT,))])
MARK = np.dtype(np.uint32)
#: Rows between stages: entries and marked anchors for a bucket, entries of marked anchors, what a group is told.
ENTRIES, MARKS, FREE, TOLD = range(4)
DEALT = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
MET = pa.schema([f for f in DEALT if f.name != "bucket"])
MET_DDL, BLOB_DDL = "grp long, kind int, blob binary", "grp long, blob binary"
ALL, ASK, BY_WINDOW = (1 << WINDOWS) - 1, 1 << 31, 1 << 30
WHOLE = 255  # the part of a context that is all of it


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, rows)], schema=schema)


def _told(entries: np.ndarray, windows: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows that tell entries' groups of their windows."""
    out = np.zeros(len(entries), TELL)
    for name in ("doc", "a", "b"):
        out[name] = entries[name]
    out["windows"] = windows
    for grp, blob in _split(entries["grp"], out):
        yield grp, TOLD, blob


def _by_context(entries: np.ndarray) -> np.ndarray:
    """Order by anchor, then context. Contexts that agree in 64 of their bits may mix; equal ones that are so parted count
    as two, and their bytes decide."""
    return np.argsort((entries["key"].astype(np.uint64) << np.uint64(32)) | (entries["a"] >> np.uint64(32)))


def _larger(entries: np.ndarray) -> np.ndarray:
    """Of entries in order of context, whether a smaller document has the context."""
    starts = _runs(entries["a"], entries["b"])
    if not len(starts):
        return np.zeros(0, bool)
    return entries["doc"] > np.repeat(np.minimum.reduceat(entries["doc"], starts), np.diff([*starts.tolist(), len(entries)]))


def _deal(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to their anchors' buckets, the smallest document of each chunk only.

    What a smaller document of the same chunk cuts goes along as told already. An anchor with many
    contexts in the chunk is marked, and its entries bypass the bucket.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        w, hashes = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = _by_context(w)
        w, bucket = w[order], hashes[order] % buckets
        starts = _runs(w["a"], w["b"])
        keys = w["key"][starts]
        anchors = _runs(keys)
        contexts = np.diff([*anchors.tolist(), len(keys)])
        many = np.isin(w["key"], keys[anchors[contexts > MANY]])
        mine = _larger(w)
        rows = [(g % buckets, g, kind, blob) for g, kind, blob in _told(w[mine], ALL)]
        rows += [(b, -1, FREE, blob) for b, blob in _split((w["a"][many & ~mine] % np.uint64(buckets)).astype(np.int64), w[many & ~mine])]
        rows += [(b, -1, ENTRIES, blob) for b, blob in _split(bucket[~many & ~mine], w[~many & ~mine])]
        marks = np.unique((bucket[many].astype(np.uint64) << np.uint64(32)) | w["key"][many])
        rows += [(b, -1, MARKS, blob) for b, blob in _split((marks >> np.uint64(32)).astype(np.int64), (marks & _LOW).astype(MARK))]
        for at in range(0, len(rows), 256):
            yield _batch(DEALT, rows[at : at + 256])

    for batch in batches:
        docs, texts, groups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        for first, part in slices(texts):
            if len(part.at):
                of = part.doc + first
                w = np.zeros(len(of), ENTRY)
                w["doc"], w["a"], w["b"], w["key"], w["grp"] = docs[of], part.a, part.b, part.key, groups[of]
                held.append((w, part.bucket_hash))
            size += len(part.data)
            if size >= CHUNK and held:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _judge(table: pa.Table) -> pa.Table:
    """One bucket: documents whose contexts a smaller one has; those to ask for their bytes; and entries of marked anchors."""
    kinds, blobs, groups = table.column("kind").to_numpy(), table.column("blob").to_pylist(), table.column("grp").to_pylist()
    rows = [(groups[k], int(kinds[k]), blobs[k]) for k in np.flatnonzero((kinds == TOLD) | (kinds == FREE)).tolist()]
    w, marks = (_unpacked([blobs[k] for k in np.flatnonzero(kinds == kind).tolist()], dtype) for kind, dtype in ((ENTRIES, ENTRY), (MARKS, MARK)))
    del blobs
    if len(w):
        w = w[_by_context(w)]
        starts = _runs(w["key"], w["a"], w["b"])
        sizes = np.diff([*starts.tolist(), len(w)])
        least = np.minimum.reduceat(w["doc"], starts)
        keys = w["key"][starts]
        anchors = _runs(keys)
        contexts = np.diff([*anchors.tolist(), len(keys)])
        varied = np.minimum.reduceat(least, anchors) != np.maximum.reduceat(least, anchors)
        free = (contexts > TOO_MANY) | np.isin(keys[anchors], marks)
        asked, free = (np.repeat(np.repeat(x, contexts), sizes) for x in ((contexts > 1) & varied, free))
        cut = w["doc"] > np.repeat(least, sizes)
        rows += [*_told(w[cut & ~free], ALL), *_told(w[asked & ~cut & ~free], ASK)]
        passed = w[free]
        rows += [(-1, FREE, _packed(passed[at : at + 65536])) for at in range(0, len(passed), 65536)]
    return _table(MET, rows)


def _redeal(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of marked anchors, by their contexts."""
    for batch in batches:
        for blob in batch.column(0):
            w = _unpacked([blob.as_py()], ENTRY)
            yield _batch(DEALT, [(b, -1, FREE, part) for b, part in _split((w["a"] % np.uint64(buckets)).astype(np.int64), w)])


def _judge_free(table: pa.Table) -> pa.Table:
    """Entries of marked anchors: documents whose contexts a smaller one has; the others are asked, window by window."""
    w = _unpacked(table.column("blob").to_pylist(), ENTRY)
    w = w[np.lexsort((w["b"], w["a"]))]
    cut = _larger(w)
    return _table(MET, [*_told(w[cut], ALL), *_told(w[~cut], ASK | BY_WINDOW)])


class Told:
    """Looks up contexts of documents among what a group was told."""

    def __init__(self, table: pa.Table):
        told = _unpacked(table.column("blob").to_pylist(), TELL)
        self.known = np.unique(told["doc"])
        mixed = self._mix(told["doc"], told["a"], told["b"])
        order = np.argsort(mixed)
        mixed, told = mixed[order], told[order]
        starts = _runs(mixed, told["b"])
        self.mixed, self.b = mixed[starts], told["b"][starts]
        self.windows = np.bitwise_or.reduceat(told["windows"], starts) if len(starts) else told["windows"]

    @staticmethod
    def _mix(docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (np.ascontiguousarray(docs).view(np.uint64) * _A) ^ (a * _B) ^ (b * _C)
        return (out ^ (out >> np.uint64(32))) * _A

    def windows_of(self, docs: np.ndarray, part: Slice) -> np.ndarray:
        if not len(self.mixed):
            return np.zeros(len(docs), np.uint32)
        want = self._mix(docs, part.a, part.b)
        at = np.searchsorted(self.mixed, want)
        at[at == len(self.mixed)] = 0
        return np.where((self.mixed[at] == want) & (self.b[at] == part.b), self.windows[at], np.uint32(0))


SHARD = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])


def _by_window(rows: np.ndarray) -> np.ndarray:
    """Each context as many times as it has windows, each time with the bytes of one window only."""
    out = np.repeat(rows, WINDOWS)
    part = np.tile(np.arange(WINDOWS, dtype=np.uint8), len(rows))
    place = np.arange(CONTEXT)
    out["part"] = part
    out["bytes"] = np.where((place >= part[:, None]) & (place < part[:, None] + SPAN), out["bytes"], np.uint8(GAP))
    whole = (out["bytes"] == GAP).sum(1) == CONTEXT - SPAN  # windows that reach past the text are none
    return out[whole]


def _hash_bytes(rows: np.ndarray) -> np.ndarray:
    words = np.zeros((len(rows), -(-CONTEXT // 8) * 8), np.uint8)
    words[:, :CONTEXT] = rows
    out = np.zeros(len(rows), np.uint64)
    for word in words.view(np.uint64).T:
        out = (out ^ word) * _A
        out ^= out >> np.uint64(32)
    return out


def _ask(shards: int, docs_table: pa.Table, told_table: pa.Table) -> pa.Table:
    """The contexts that a group was asked for, by shard."""
    told = Told(told_table)
    out = []
    docs = docs_table.column("doc").to_numpy()
    texts = docs_table.column("text").to_pylist()
    wanted = np.flatnonzero(np.isin(docs, told.known)).tolist()
    if wanted:
        docs, texts, group = docs[wanted], [texts[k] for k in wanted], docs_table.column("grp")[0].as_py()
        for first, part in slices(texts):
            of = docs[part.doc + first]
            windows = told.windows_of(of, part)
            which = np.flatnonzero(windows & np.uint32(ASK))
            if not len(which):
                continue
            rows = np.zeros(len(which), ASKED)
            rows["doc"], rows["a"], rows["b"], rows["grp"], rows["part"], rows["bytes"] = of[which], part.a[which], part.b[which], group, WHOLE, part.contexts(which)
            free = windows[which] & np.uint32(BY_WINDOW) > 0
            by_window = _by_window(rows[free])
            shard = np.concatenate((part.key[which][~free].astype(np.uint64), _hash_bytes(by_window["bytes"]))) % np.uint64(shards)
            rows = np.concatenate((rows[~free], by_window))
            order = np.argsort(shard, kind="stable")
            shard, rows = shard[order], rows[order]
            cut = [*_runs(shard).tolist(), len(shard)]
            out += [(int(shard[x]), rows[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
    return _table(SHARD, out)


def _sort_shard(table: pa.Table) -> pa.Table:
    """Windows of a shard's contexts that a smaller document has in another one."""
    rows = np.frombuffer(b"".join(table.column("blob").to_pylist()), ASKED)
    rows = rows[np.lexsort((rows["doc"], rows["part"], rows["b"], rows["a"]))]
    starts = _runs(rows["a"], rows["b"], rows["part"])  # each context once, with its smallest document: all ask for the same
    least = rows["doc"][starts]
    text = np.concatenate((rows["bytes"][starts], np.full((len(starts), 1), GAP, np.uint8)), 1).ravel()
    gaps = np.concatenate(([0], np.cumsum(text == GAP)))
    whole = np.zeros(len(text), bool)
    whole[: len(text) - SPAN + 1] = gaps[SPAN:] == gaps[:-SPAN]
    suffixes = suffix_array(text)
    suffixes = suffixes[whole[suffixes]]
    found = np.zeros(len(starts), np.uint32)
    if len(suffixes):
        common = permuted_lcp(text, suffixes, SPAN)[suffixes]
        equal = np.flatnonzero(common < SPAN)  # first of each class of equal windows
        owner = least[suffixes // (CONTEXT + 1)]
        smallest = np.minimum.reduceat(owner, equal)
        mine = owner > np.repeat(smallest, np.diff([*equal.tolist(), len(suffixes)]))
        hit = suffixes[mine]
        np.bitwise_or.at(found, hit // (CONTEXT + 1), (np.uint32(1) << (hit % (CONTEXT + 1)).astype(np.uint32)))
    out = np.zeros(len(rows), TELL)
    for name in ("doc", "a", "b"):
        out[name] = rows[name]
    out["windows"] = np.repeat(found, np.diff([*starts.tolist(), len(rows)]))
    some = out["windows"] > 0
    return _table(MET, [(g, TOLD, blob) for g, blob in _split(rows["grp"][some], out[some])])


KEPT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(with_text: bool, docs_table: pa.Table, told_table: pa.Table) -> pa.Table:
    """What is left of each document of a group."""
    told = Told(told_table)
    docs, texts, rows = docs_table.column("doc").to_numpy(), docs_table.column("text").to_pylist(), []
    known = np.isin(docs, told.known)

    def whole(k: int) -> tuple:
        return (docs[k], len(texts[k]), 0, 0, hashlib.sha256(texts[k]).hexdigest(), texts[k] if with_text else None)

    rows = [whole(k) for k in np.flatnonzero(~known).tolist()]
    some = np.flatnonzero(known)
    docs, texts = docs[some], [texts[k] for k in some.tolist()]
    for first, part in slices(texts):
        windows = told.windows_of(docs[part.doc + first], part) & np.uint32(ALL)
        change = np.zeros(len(part.data) + SPAN + 1, np.int32)
        begins = np.zeros(len(part.data) + 1, np.int32)
        all_of = part.at[windows == ALL] - SIDE
        np.add.at(begins, all_of, 1)
        np.add.at(begins, all_of + WINDOWS, -1)
        starts = np.cumsum(begins)[: len(part.whole)] > 0
        at, bits = part.at[(windows != ALL) & (windows > 0)] - SIDE, windows[(windows != ALL) & (windows > 0)]
        for k in range(WINDOWS):
            starts[at[bits >> np.uint32(k) & np.uint32(1) == 1] + k] = True
        hit = np.flatnonzero(starts & part.whole)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + SPAN, -1)
        gone = np.cumsum(change)[: len(part.data)] > 0
        edges = gone & ~np.concatenate(([False], gone[:-1]))
        for k, (a, b) in enumerate(zip(part.starts.tolist(), part.ends.tolist())):
            removed = int(gone[a:b].sum())
            if not removed:
                text = texts[first + k]
            else:
                text = part.data[a:b][~gone[a:b]].tobytes()
            rows.append((docs[first + k], b - a, removed, int(edges[a:b].sum()), hashlib.sha256(text).hexdigest(), text if with_text else None))
    return _table(KEPT, rows)


def remove_repeats(docs: DataFrame, *, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``with_text`` the
    bytes that are left, as ``kept``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups, buckets, shards = max(64, -(-size // GROUP)), max(256, -(-size // BUCKET)), max(64, -(-size // PER_SHARD))
    # documents without an id are dealt by their text
    group = F.pmod(F.when(F.col("doc") == NO_ID, F.xxhash64("text")).otherwise(F.xxhash64("doc")), F.lit(groups))
    rows = rows.withColumn("grp", group)
    dealt = rows.mapInArrow(lambda b: _deal(buckets, b), f"bucket long, {MET_DDL}")
    met = stash(dealt.groupBy("bucket").applyInArrow(_judge, MET_DDL))
    release(spark)
    free = met.where(f"kind = {FREE}").select("blob").mapInArrow(lambda b: _redeal(buckets, b), f"bucket long, {MET_DDL}")
    judged = stash(free.groupBy("bucket").applyInArrow(_judge_free, MET_DDL))
    told = met.where(f"kind = {TOLD}").unionByName(judged).select("grp", "blob")
    by_group = rows.groupBy("grp")
    asked = by_group.cogroup(told.groupBy("grp")).applyInArrow(lambda d, t: _ask(shards, d, t), "shard long, blob binary")
    found = stash(asked.groupBy("shard").applyInArrow(_sort_shard, MET_DDL))
    release(spark)
    every = told.unionByName(found.select("grp", "blob"))
    out = by_group.cogroup(every.groupBy("grp")).applyInArrow(lambda d, t: _cut(with_text, d, t), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")
    return out if with_text else out.drop("kept")
