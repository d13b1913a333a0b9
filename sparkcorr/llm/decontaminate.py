"""Benchmark decontamination by template canonicalisation.

Numbers, units after them, and names (capitalised words inside a sentence) become typed
placeholders; windows of template tokens are hashed, and the documents' windows are hash-joined with
the benchmark's. Each hit is then checked along its diagonal: literal tokens must agree, slots
must be of one type, and one slot value of the item must always stand for one value in the
document. So a question with other numbers or names is caught, and chance is not. All this is done
twice, the second time with neighbouring names, and a number and its unit, joined to one slot, so
that a name of another count of words, or a unit more or less, does not leave the diagonal.

An item is found by a run of ``MIN_RUN`` words, half of them literal (or slots of one value), or of
all its words, ``MIN_LITERAL`` of them literal. Items of under ``WINDOW`` tokens have one window, of
their length; those whose windows all have fewer than ``MIN_LITERAL`` literal tokens are known by the
windows with most.

Neither side is collected. The documents' windows are thinned before the join by the sorted hashes of
the benchmark's if these are at most ``SENT_HASHES``, else by a bitmap of fixed size, whose false
positives the join removes. Only documents with a window left, and of these the tokens, are moved.
Rows with one text are judged once.

Edge cases: null or empty texts, and items of under ``MIN_LITERAL`` tokens or without a word, match
nothing; repeated rows get the same answer; an empty benchmark finds nothing; items with a null id
are compared but can't be named, and count as -1; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import rest, stash
from sparkcorr.shipping import ship

WINDOW, MIN_LITERAL, MIN_RUN = 8, 4, 13
#: Hashes of the benchmark's windows that are sent to all tasks (32 MB); beyond, a bitmap of so many bits (32 MB) is.
SENT_HASHES, SENT_BITS = 4 << 20, 1 << 28
#: Rows of verdicts that are sent to all tasks; more are joined by merging.
SENT_ROWS = 100_000
#: Characters of text tokenised at once.
SLICE = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
END = frozenset(".!?\n")
#: Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeters miles feet inches pounds grams kilograms liters litres gallons "
    "dollar dollars cent cents euro euros usd eur percent mph kmh hz w kw v a k c f".split()
)
LITERAL, NUMBER, UNIT, NAME = range(4)
#: What a vocabulary tells of a word, in bits. Characters of words beyond which a new one is begun.
IS_END, IS_NUMBER, IS_UNIT, IS_CAPITAL = 1, 2, 4, 8
VOCABULARY_CHARS = 2 << 20
_PLACEHOLDER = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FACTOR = np.uint64(0x9FB21C651E98DF25)


class Vocabulary(dict):
    """The number of each word met, and what is known of it; a word is looked at once, however many slices have it."""

    def __init__(self):
        self.words, self.hashes, self.flags, self.chars = [], array("Q"), bytearray(), 0

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self.words)
        low = w.lower()
        self.words.append(w)
        self.hashes.append(xxhash.xxh64_intdigest(low))
        self.flags.append((w in END) * IS_END | w[0].isdigit() * IS_NUMBER | (low in UNITS) * IS_UNIT | (w[0].isupper() and w[1:].islower()) * IS_CAPITAL)
        self.chars += len(w)
        return n


_VOCABULARY = [Vocabulary()]


def _vocabulary() -> Vocabulary:
    if _VOCABULARY[0].chars > VOCABULARY_CHARS:
        _VOCABULARY[0] = Vocabulary()
    return _VOCABULARY[0]


class Templates:
    """The tokens of a slice of texts: strings, kinds, and hashes of their windows."""

    def __init__(self, texts: list[str | None]):
        vocabulary = _vocabulary()
        found = [TOKEN.findall(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        flags = np.frombuffer(bytes(vocabulary.flags), np.uint8)
        of_token = flags[codes]
        ends = of_token & IS_END > 0
        text_of = np.repeat(np.arange(len(texts)), sizes)
        first = np.ones(len(codes), bool)
        first[1:] = ends[:-1] | (text_of[1:] != text_of[:-1])
        keep = ~ends
        self.words, self.hashes, self.capital = vocabulary.words, np.array(vocabulary.hashes, np.uint64), flags & IS_CAPITAL > 0
        self.codes, self.text_of, self.first, of_token = codes[keep], text_of[keep], first[keep], of_token[keep]
        kinds = np.where(of_token & IS_NUMBER > 0, NUMBER, LITERAL)
        if len(kinds):
            after = np.zeros(len(kinds), bool)
            after[1:] = (kinds[:-1] == NUMBER) & ~self.first[1:]
            kinds = np.where(after & (of_token & IS_UNIT > 0), UNIT, kinds)
            kinds = np.where((kinds == LITERAL) & (of_token & IS_CAPITAL > 0) & ~self.first, NAME, kinds)
        self.kinds = kinds
        self.all_codes, self.at, self.counts = self.codes, np.arange(len(kinds)), np.ones(len(kinds), np.int64)
        self.bounds = np.searchsorted(self.text_of, np.arange(len(texts) + 1))

    def joined(self) -> Templates:
        """With neighbouring names, and a number and its unit, as one token each."""
        goes_on = np.zeros(len(self.kinds), bool)
        goes_on[1:] = (self.text_of[1:] == self.text_of[:-1]) & ((self.kinds[1:] == UNIT) | (self.kinds[1:] == NAME) & (self.kinds[:-1] == NAME))
        out = copy.copy(self)
        out.at = np.flatnonzero(~goes_on)
        out.counts = np.diff(np.append(out.at, len(self.kinds)))
        out.codes, out.kinds, out.text_of, out.first = (c[out.at] for c in (self.codes, self.kinds, self.text_of, self.first))
        out.bounds = np.searchsorted(out.text_of, np.arange(len(self.bounds)))
        return out

    def windows(self, size: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, literal tokens) of each window of ``size`` tokens inside one text."""
        n = len(self.codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        canon = np.where(self.kinds == LITERAL, self.hashes[self.codes], _PLACEHOLDER[self.kinds])
        rolled = np.full(n, 2 * size + salt, np.uint64)
        for k in range(size):
            rolled = rolled * _FACTOR + canon[k : k + n]
        rolled ^= rolled >> np.uint64(29)
        literal = np.concatenate(([0], np.cumsum(self.kinds == LITERAL)))
        at = np.flatnonzero(self.text_of[size - 1 :] == self.text_of[:n])
        return rolled[at], at, (literal[size:] - literal[:-size])[at]

    def row(self, text: int) -> tuple[list[str], list[int]]:
        """The lower-cased tokens of a text; and of each kind + 4 (opens a sentence with a capital) + 8 words in it."""
        lo, hi = int(self.bounds[text]), int(self.bounds[text + 1])
        strings = [self.words[c].lower() for c in self.codes[lo:hi].tolist()]
        for k in np.flatnonzero(self.counts[lo:hi] > 1).tolist():
            first, count = int(self.at[lo + k]), int(self.counts[lo + k])
            strings[k] = " ".join(self.words[c] for c in self.all_codes[first : first + count]).lower()
        opens = self.first[lo:hi] & self.capital[self.codes[lo:hi]] if hi > lo else self.first[lo:hi]
        return strings, (self.kinds[lo:hi] + 4 * opens + 8 * self.counts[lo:hi]).tolist()


def variants(texts: list[str | None]) -> list[Templates]:
    plain = Templates(texts)
    return [plain, plain.joined()]


def item_windows(t: Templates, salt: int) -> Iterator[tuple[int, int, int, int]]:
    """(item, size, hash, place) of the windows by which each item is known."""
    sizes = np.diff(t.bounds)
    for size in range(MIN_LITERAL, WINDOW + 1):
        if not ((sizes == size) | (size == WINDOW) & (sizes > size)).any():
            continue
        hashes, at, literal = t.windows(size, salt)
        item = t.text_of[at]
        most = np.zeros(len(sizes), np.int64)
        np.maximum.at(most, item, literal)
        fits = (sizes[item] == size) | (size == WINDOW) & (sizes[item] > size)
        ok = fits & (literal > 0) & (literal >= np.minimum(MIN_LITERAL, most[item]))
        for k in np.flatnonzero(ok).tolist():
            yield int(item[k]), size, int(hashes[k].view(np.int64)), int(at[k] - t.bounds[item[k]])


def consistent_run(item: tuple[list[str], list[int]], doc: tuple[list[str], list[int]], words: int) -> int:
    """The item's words in the longest run in which aligned tokens agree and slots are consistent, or 0.

    ``words`` is how many the item has. Of a run at least half, or of the whole item ``MIN_LITERAL``,
    must be literal or slots of one value. A slot that contradicts an earlier one ends the runs that hold both.
    """
    best = start = 0
    there: dict = {}
    back: dict = {}
    length, literal, balance = [0], [0], [0]  # sums of words, literal ones, and twice the latter less the former
    for k, (a, ma, b, mb) in enumerate(zip(*item, *doc)):
        kind, n = ma & 3, ma >> 3
        slot = kind == mb & 3 and kind != LITERAL or ma & 4 and mb & 4
        same = a == b
        if not slot and not same:
            start = k + 1
        elif slot:
            value, at = there.get(a, (b, -1))
            if value != b:
                start = max(start, at + 1)
            there[a] = (b, k)
            if kind != UNIT:
                value, at = back.get(b, (a, -1))
                if value != a:
                    start = max(start, at + 1)
                back[b] = (a, k)
        length.append(length[-1] + n)
        literal.append(literal[-1] + (n if same or not slot else 0))
        balance.append(2 * literal[-1] - length[-1])
        if length[-1] - length[start] <= best:
            continue
        if length[-1] - length[start] >= words and literal[-1] - literal[start] >= MIN_LITERAL:
            best = length[-1] - length[start]
            continue
        for first in range(start, k + 1):
            if length[-1] - length[first] <= best:
                break
            if balance[-1] >= balance[first]:
                if literal[-1] - literal[first] >= MIN_LITERAL:
                    best = length[-1] - length[first]
                break
    return best


class Known:
    """Hashes of the benchmark's windows, all of them or as a bitmap."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None):
        self.hashes, self.bits = hashes, bits
        if hashes is not None:  # a small table tells most that aren't known
            size = max(16, min(26, int(len(hashes) * 16).bit_length()))
            self.mask = np.uint64((1 << size) - 1)
            self.may = np.zeros(1 << size, bool)
            self.may[hashes & self.mask] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        if self.hashes is None:
            at = hashes % np.uint64(SENT_BITS)
            return np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        likely = np.flatnonzero(self.may[hashes & self.mask])
        at = np.searchsorted(self.hashes, hashes[likely])
        at[at == len(self.hashes)] = 0
        return likely[self.hashes[at] == hashes[likely]] if len(self.hashes) else likely[:0]


ITEM_SCHEMA = "item long, item_id long, variant int, size int, tokens array<string>, marks array<int>, hashes array<long>, places array<int>"
PROBE_SCHEMA = "k1 long, k2 long, variant int, tokens array<string>, marks array<int>, hashes array<long>, places array<int>"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list]]:
    """(first column, second, texts) of slices of bounded size, or of one longer text."""
    one, two, texts = (c.to_pylist() for c in batch.columns)
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or k == len(texts) - 1:
            yield one[first : k + 1], two[first : k + 1], texts[first : k + 1]
            first, size = k + 1, 0


def _index(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their tokens and windows."""
    for batch in batches:
        for keys, ids, texts in _slices(batch):
            rows = []
            for variant, t in enumerate(variants(texts)):
                of: dict[int, list] = {}
                for item, size, h, place in item_windows(t, variant):
                    of.setdefault(item, [size, [], []])[1].append(h)
                    of[item][2].append(place)
                rows += [(keys[k], ids[k], variant, size, *t.row(k), hashes, places) for k, (size, hashes, places) in of.items()]
            yield _emit(schema, rows)


def _probe(schema: pa.Schema, sizes: list[int], known: Known, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with windows that the benchmark may have."""
    for batch in batches:
        for k1, k2, texts in _slices(batch):
            rows = []
            for variant, t in enumerate(variants(texts)):
                of: dict[int, tuple[list, list]] = {}
                for size in sizes:
                    hashes, at, _ = t.windows(size, variant)
                    hit = known.among(hashes)
                    for h, place in zip(hashes[hit].view(np.int64).tolist(), at[hit].tolist()):
                        found = of.setdefault(int(t.text_of[place]), ([], []))
                        found[0].append(h)
                        found[1].append(place - int(t.bounds[t.text_of[place]]))
                rows += [(k1[k], k2[k], variant, *t.row(k), *found) for k, found in of.items()]
            if rows:
                yield _emit(schema, rows)
            del t, rows
    _VOCABULARY[0] = Vocabulary()  # a worker that waits holds none
    rest()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k1, k2, item_id, tokens, marks, there, there_marks, words in zip(*(c.to_pylist() for c in batch.columns)):
            run = consistent_run((tokens, marks), (there, there_marks), words)
            if run >= min(MIN_RUN, words):
                rows.append((k1, k2, item_id, run))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, names=["k1", "k2", "item_id", "run"])


def _keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def _known(items: DataFrame) -> Known:
    hashes = items.select(F.explode("hashes").alias("h")).distinct()
    count = hashes.count()
    if count <= SENT_HASHES:
        return Known(np.sort(np.fromiter((r.h for r in hashes.toLocalIterator()), np.int64, count).view(np.uint64)), None)
    byte, bit = F.shiftright(F.expr(f"h & {SENT_BITS - 1}"), 3), F.expr("1 << cast(h & 7 as int)")
    bits = np.zeros(SENT_BITS >> 3, np.uint8)
    for r in hashes.select(byte.alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r.byte] = r.bit
    return Known(None, bits)


def findings(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(k1, k2, item_id, run): the items that each distinct text holds, with the longest run; see ``_keys``."""
    spark = docs.sparkSession
    ship(spark)
    schema, probe_schema = _arrow(ITEM_SCHEMA), _arrow(PROBE_SCHEMA)
    text = F.col("text").cast("string")
    named = benchmark.select(F.xxhash64("item_id", text).alias("item"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), text.alias("text")).where("text is not null").distinct()
    items = stash(named.mapInArrow(lambda b: _index(schema, b), ITEM_SCHEMA))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most five
    known = spark.sparkContext.broadcast(_known(items))  # of bounded size
    whole = F.col(text_col).cast("string")
    probes = stash(docs.select(*_keys(whole), whole.alias("text")).where("text is not null").mapInArrow(lambda b: _probe(probe_schema, sizes, known.value, b), PROBE_SCHEMA).dropDuplicates(["k1", "k2", "variant"]))
    listed = items.select("item", "variant", F.size("tokens").alias("n"), F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("item", "variant", "n", F.col("w.hashes").alias("hash"), F.col("w.places").alias("place"))
    seen = probes.select("k1", "k2", "variant", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("k1", "k2", "variant", F.col("w.hashes").alias("hash"), F.col("w.places").alias("at"))
    hits = seen.join(listed, ["hash", "variant"]).select("k1", "k2", "variant", "item", (F.col("at") - F.col("place")).alias("start")).distinct()
    aligned = hits.join(probes.select("k1", "k2", "variant", F.col("tokens").alias("there"), F.col("marks").alias("there_marks")), ["k1", "k2", "variant"])
    aligned = aligned.join(items.select("item", "variant", "item_id", "tokens", "marks"), ["item", "variant"])
    skip, first = F.greatest(-F.col("start"), F.lit(0)), F.greatest("start", F.lit(0))
    cut = lambda c, at, n: F.slice(c, at + 1, n).alias(c)
    both = aligned.select("k1", "k2", "item_id", cut("tokens", skip, F.size("tokens")), cut("marks", skip, F.size("tokens")), cut("there", first, F.size("tokens") - skip), cut("there_marks", first, F.size("tokens") - skip), F.aggregate("marks", F.lit(0), lambda x, m: x + F.shiftright(m, 3)).alias("words"))
    runs = both.mapInArrow(_verify, "k1 long, k2 long, item_id long, run long")
    return stash(runs.groupBy("k1", "k2", "item_id").agg(F.max("run").alias("run")))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (comma-joined) and longest_run of every row."""
    found = findings(docs, benchmark, text_col=text_col)
    listed = F.array_sort(F.collect_list("item_id"))
    by_text = found.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.array_join(listed.cast("array<string>"), ",").alias("item_ids"), F.max("run").alias("longest_run"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keys(F.col(text_col).cast("string")))
    zero = F.lit(0).cast("long")
    n = F.coalesce("n_items", zero)
    return rows.join(by_text, ["k1", "k2"], "left").select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("longest_run", zero).alias("longest_run"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = stash(findings(docs, benchmark).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())
    found = F.broadcast(found) if found.count() <= SENT_ROWS else found.hint("merge")
    k1, k2 = _keys(docs["text"].cast("string"))
    return docs.join(found, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
