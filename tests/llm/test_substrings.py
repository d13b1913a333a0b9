import hashlib
import random

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from sparkcorr.llm import substrings as s
from sparkcorr.llm.suffix_array import permuted_lcp, suffix_array


def brute(rows):
    first, data = {}, [(s.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], s.NO_ID))
    out = []
    for (name, _), (d, b) in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((name, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in s.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26, 255])
def test_suffix_arrays(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        d = bytes(rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 5, 30, 120]))) * rng.choice([1, 1, 3])
        got = suffix_array(np.frombuffer(d, np.uint8))
        want = sorted(range(len(d)), key=lambda i: d[i:])
        assert got.tolist() == want
        common = permuted_lcp(np.frombuffer(d, np.uint8), got, 50)
        for i, j in zip(want[1:], want):
            n = next((k for k in range(50) if i + k >= len(d) or j + k >= len(d) or d[i + k] != d[j + k]), 50)
            assert common[i] == n


def test_a_corpus(documents):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_fragments_at_every_offset(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(4)] + ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            b, n = rng.choice(base), rng.choice([30, 48, 49, 50, 51, 66, 67, 68, 150])
            x = rng.randrange(len(b))
            parts.append(b[x : x + n] + rng.choice(["", "\x00", "zz "]))
        rows.append((rng.choice([i, i, None, 5, -1]), "".join(parts) or rng.choice(["", None])))
    rows += [(1000, "a" * 200), (1001, "a" * 60), (1002, "a" * 49), (1003, "a" * 50)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_odd_rows_and_kept_bytes(spark, odd_docs, no_docs):
    assert result(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert s.remove_repeats(no_docs).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in s.remove_repeats(spark.createDataFrame([(1, "x" * 10 + "y" * 60), (2, "y" * 60 + "z")], "doc_id long, text string"), with_text=True).collect()}
    assert kept == {1: b"x" * 10 + b"y" * 60, 2: b"z"}


def phrases(seed, n=250):
    """A phrase of 49 bytes, and longer ones, between sides of a few letters, in most texts."""
    rng = random.Random(seed)
    side = lambda k: "".join(rng.choice("ab") for _ in range(rng.randrange(k)))
    phrase = ["".join(rng.choice("cdefgh") for _ in range(k)) for k in (33, 49, 49, 52, 90)]
    return [(i, side(30) + rng.choice(phrase) + side(8) + (rng.choice(phrase) if i % 3 else "") + side(30)) for i in range(n)]


@pytest.mark.parametrize("many", [3, 64])
def test_anchors_in_many_contexts(spark, monkeypatch, many):
    monkeypatch.setattr(s, "MANY", many)
    monkeypatch.setattr(s, "TOO_MANY", many)
    rows = phrases(many)
    rng = random.Random(5)
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


@pytest.mark.parametrize("bits", [2, 8])
def test_weak_hashes(spark, monkeypatch, bits):
    """Anchors told apart by few bits, or contexts by one of their two hashes: the same bytes go."""
    strong = s.Slice._hash
    for weak in (s._A, s._B, s._C):
        monkeypatch.setattr(s.Slice, "_hash", lambda self, words, offsets, factor, weak=weak: strong(self, words, offsets, factor) & s.np.uint64((1 << bits) - 1 if factor == weak else 0xFFFFFFFFFFFFFFFF))
        rows = phrases(bits)
        told = [bytes(t, "utf8") for _, t in rows]
        groups = s.np.zeros(len(rows), s.np.int64)
        docs = s.np.arange(len(rows))
        batch = s.pa.RecordBatch.from_arrays([s.pa.array(docs), s.pa.array(told, s.pa.binary()), s.pa.array(groups)], names=["doc", "text", "grp"])
        dealt = s.pa.Table.from_batches(list(s._deal(1, iter([batch]))))
        met = s._judge(dealt)
        free = [b for k, b in zip(met.column("kind").to_pylist(), met.column("blob").to_pylist()) if k == s.FREE]
        more = [s._judge_free(s.pa.table({"blob": free}))] if free else []
        told_rows = s.pa.concat_tables([met, *more])
        told_rows = told_rows.filter(s.pa.compute.equal(told_rows.column("kind"), s.TOLD))
        documents = s.pa.table({"doc": docs, "text": s.pa.array(told, s.pa.binary()), "grp": groups})
        asked = s._ask(4, documents, told_rows)
        found = s._sort_shard(asked) if asked.num_rows else asked
        every = s.pa.concat_tables([told_rows.select(["grp", "blob"]), *([found.select(["grp", "blob"])] if asked.num_rows else [])])
        out = s._cut(False, documents, every).drop_columns(["kept"]).to_pylist()
        assert sorted((tuple(r.values()) for r in out), key=repr) == brute(rows)
