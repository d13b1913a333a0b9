"""Sum-of-squares online packing of tokenised documents into windows.

Each task packs the documents of its partition as they come. The open windows are counted by
fill level; a document goes to the level for which the sum of the squared counts falls most, or
rises least, so that no level piles up windows that nothing fits. At the end of a partition the
open windows are topped up by cutting the emptiest ones; the rest, less than one window, is laid
out in sequences whose lengths are powers of two, which need no padding.

Edge cases: a null or empty text is the end token alone; a document of more than a window is
first cut into full windows, and its rest placed; repeated rows, and null ids, are packed one by
one; an empty table gives an empty result; other columns are ignored. Sequence ids are unique, not
dense: the partition's number in the high bits.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import rest
from sparkcorr.shipping import ship

END_ID = 2
CACHED_PIECES, CACHED_CHARS = 250_000, 64
#: Texts, and characters of them, encoded at once.
SLICE_ROWS, SLICE_CHARS = 2000, 4 << 20
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
SPACE, LETTER, STOP = 1, 2, 3
#: The class of each byte of UTF-8. Of letters beyond ASCII those in U+00C0 to U+00FF count; they are two bytes.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = LETTER
_CLASS[list(b" \n")], _CLASS[list(b",.")] = SPACE, STOP


class Stored:
    """Ids of pieces, end to end; ``rows`` has each piece's number."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.ends, self.n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first, n = int(self.ends[self.n]), self.n + len(sizes)
        if n >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(n, np.int64)))
        if first + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(first + len(ids), "<u4")))
        self.ids[first : first + len(ids)] = ids
        self.ends[self.n + 1 : n + 1] = first + np.cumsum(sizes)
        self.n = n
        return np.arange(n - len(sizes), n)

    def shrink(self) -> None:
        """Without room to grow."""
        self.ids, self.ends = self.ids[: self.ends[self.n]].copy(), self.ends[: self.n + 1].copy()

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many of each."""
        first = self.ends[rows]
        sizes = self.ends[rows + 1] - first
        upto = np.cumsum(sizes)
        return self.ids[np.repeat(first - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)], sizes


class Encoder:
    """Little-endian 32-bit ids of texts.

    No token of this vocabulary spans white space, nor the edge of a letter or digit and a stop or
    comma after it. So texts are cut there, all of a slice at once, and each distinct piece is looked up;
    ``tokenizers`` encodes those not yet seen. Texts that may hold special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = {t.content[:2] for t in added.values()}
        self.between = next(((k, t.content) for k, t in added.items() if t.special and not t.normalized), None)
        self.store, self.older_store = Stored(), Stored()

    @property
    def known(self) -> dict[str, int]:
        return self.store.rows

    @property
    def older(self) -> dict[str, int]:
        return self.older_store.rows

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many of each; many go in one text, with a special token after each."""
        if not self.between:
            ids = self._whole(pieces)
            return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        mark, token = self.between
        ids = np.concatenate(self._whole([token.join([*pieces[k : k + 1000], ""]) for k in range(0, len(pieces), 1000)]))
        is_mark = ids == mark
        return ids[~is_mark], np.diff(np.flatnonzero(is_mark), prepend=-1) - 1

    @staticmethod
    def _plain(text: str) -> bytes:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.encode()
        return text.lower().encode()  # one letter for one, as the vocabulary's normaliser does

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """Where ``store`` has each of the distinct pieces. Its older half is dropped when the newer one is full; what was used since stays."""
        if len(self.known) > CACHED_PIECES or len(self.store.ids) > 64 * CACHED_PIECES:
            self.store, self.older_store = Stored(), self.store
        get = self.known.get
        rows = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0)
        get = self.older.get
        before = np.fromiter((get(pieces[k], -1) for k in missing.tolist()), np.int64, len(missing))
        for some, found in ((missing[before >= 0], self.older_store.take), (missing[before < 0], None)):
            if len(some):
                new = [pieces[k] for k in some.tolist()]
                rows[some] = at = self.store.add(*(found(before[before >= 0]) if found else self._encoded(new)))
                self.known.update(zip(new, at.tolist()))
                for piece in new:
                    if len(piece) > CACHED_CHARS:
                        del self.known[piece]
        return rows

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        whole = [any(mark in t for mark in self.marks) for t in texts]
        plain = [b"" if w else self._plain(t) for t, w in zip(texts, whole)]
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        raw = np.frombuffer(b" ".join([*plain, b""]), np.uint8)
        kind = _CLASS[raw]
        letter, keep = kind == LETTER, kind != SPACE
        second = np.flatnonzero(raw == 0xC3) + 1
        letter[second] = (raw[second] != 0x97) & (raw[second] != 0xB7)  # multiplied by, divided by
        start = keep.copy()
        start[1:] &= ~keep[:-1] | (kind[1:] == STOP) & letter[:-1]
        at, data = np.flatnonzero(start), raw[keep]
        firsts = np.append(np.flatnonzero(start[keep]), len(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(firsts), pa.py_buffer(data)]).dictionary_encode()
        rows = self._rows(pieces.dictionary.to_pylist())
        ids, sizes = self.store.take(rows[pieces.indices.to_numpy()])
        upto = np.concatenate(([0], np.cumsum(sizes)))
        cut = upto[np.concatenate(([0], np.searchsorted(at, ends)))].tolist()
        return [self._whole([t])[0].tobytes() if w else ids[a:b].tobytes() for t, w, a, b in zip(texts, whole, cut[:-1], cut[1:])]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of slices of bounded size, or of one longer text."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        ids, texts = (c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)
        first = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= SLICE_CHARS or k == len(texts) - 1:
                yield ids[first : k + 1], [t or "" for t in texts[first : k + 1]]
                first, size = k + 1, 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Windows of ``size`` ids. A piece is (document, start, length); ``done`` gets (pieces of a sequence)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # windows open at each level
        self.open: dict[int, list[list]] = {}
        self.done: list[list] = []

    def _level(self, n: int) -> int:
        """The level to place ``n`` ids at: 0 opens a window. Ties: the fullest."""
        if n == self.size:
            return 0
        count = self.count
        left = np.where(count[: self.size - n + 1] > 0, 1 - 2 * count[: self.size - n + 1], self.size)
        left[0] = 0
        change = left + 2 * count[n:] + 1
        change[-1] -= 1  # a full window isn't counted
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc, n: int) -> None:
        at = 0
        while n - at >= self.size:
            self.done.append([(doc, at, self.size)])
            at += self.size
        if at < n:
            self._place((doc, at, n - at))

    def _place(self, piece: tuple) -> None:
        level = self._level(piece[2])
        window: list = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        level += piece[2]
        if level == self.size:
            self.done.append(window)
        else:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1

    def finish(self) -> None:
        """Fill the fullest windows with cuts from the emptiest; then powers of two."""
        left = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.count = {}, np.zeros_like(self.count)
        spare: list = []
        while left:
            level, window = left.pop(0) if not spare else (0, [])
            gap = self.size - level
            while gap and (spare or left):
                if not spare:
                    spare = left.pop()[1]
                doc, start, n = spare.pop()
                take = min(n, gap)
                window.append((doc, start, take))
                gap -= take
                if take < n:
                    spare.append((doc, start + take, n - take))
            if gap:
                spare = window
                break
            self.done.append(window)
        while spare:
            total = sum(p[2] for p in spare)
            room = min(self.size, 1 << (total.bit_length() - 1))
            window = []
            while room:
                doc, start, n = spare.pop(0)
                take = min(n, room)
                window.append((doc, start, take))
                room -= take
                if take < n:
                    spare.insert(0, (doc, start + take, n - take))
            self.done.append(window)


def pack(docs: DataFrame, tokenizer: str, *, size: int = 4096, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = encoder(tokenizer), Packer(size), np.asarray([end_id], "<u4").tobytes()
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 33
        made = 0
        held: dict[int, tuple] = {}  # documents with a piece in an open window: id, ids, pieces left
        serial = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = []
            for window in packer.done:
                at = 0
                for doc, start, n in window:
                    doc_id, ids = held[doc][:2]
                    rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, first + made, at))
                    at += n
                    held[doc][2] -= n
                    if not held[doc][2]:
                        del held[doc]
                made += 1
            packer.done = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=PIECES)

        for batch in batches:
            for ids_of, texts in _slices(batch):
                for doc_id, ids in zip(ids_of, encode(texts)):
                    ids += end
                    held[serial] = [doc_id, ids, len(ids) // 4]
                    packer.add(serial, len(ids) // 4)
                    serial += 1
                yield from emit()
        packer.finish()
        yield from emit()
        encode.store.shrink()
        encode.older_store = Stored()
        rest()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in PIECES.names))
