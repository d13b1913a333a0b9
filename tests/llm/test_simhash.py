import itertools
import random

import numpy as np
import xxhash

from sparkcorr.llm import simhash as s
from sparkcorr.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    keys = [set(k[k >= 0].tolist()) for k in s.golay_keys(words)]
    assert {len(k) for k in keys} == {1, 6}
    for a, b in itertools.combinations_with_replacement(range(23), 2):
        other = words ^ (1 << a) ^ (0 if a == b else 1 << b)
        assert all(x & set(k[k >= 0].tolist()) for x, k in zip(keys, s.golay_keys(other)))


def test_every_link_shares_a_key():
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(1500)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for f in fps]
    both = []
    for x in (fps, near):
        keys, owners = s.fuzzy_keys(np.array(x, np.uint64).view(np.int64))
        of = [set() for _ in x]
        for k, o in zip(keys.tolist(), owners.tolist()):
            of[o].add(k)
        both.append(of)
    assert all(a & b for a, b in zip(*both))


def test_a_corpus(documents):
    rows = s.near_duplicates(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    fps = [int(r.fingerprint, 16) for r in rows]
    assert all(f == brute_fingerprint(texts[r.doc_id]) for f, r in zip(fps, rows))
    groups = brute_groups(fps)
    least = {}
    for g, r in zip(groups, rows):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert [r.component_id for r in rows] == [least[g] for g in groups]


def clustered(n, seed=3):
    """Fingerprints in a chain and a dense ball: one key holds many of them."""
    rng = random.Random(seed)
    x = rng.getrandbits(64)
    out = {x}
    while len(out) < n:
        out.add(rng.choice(list(out)) ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randrange(1, 5))) if rng.random() < 0.8 else rng.getrandbits(64))
    return list(out)


def test_hot_keys_are_split_and_lose_no_link(spark, monkeypatch):
    fps = clustered(300)
    signed = np.array(fps, np.uint64).view(np.int64)
    distinct = spark.createDataFrame([(int(f),) for f in signed], "fp long")
    want = brute_groups(fps)
    for block, many in ((40, 256), (40, 20), (4096, 10**9)):
        monkeypatch.setattr(s, "BLOCK", block)
        monkeypatch.setattr(s, "MANY", many)
        batch = s.pa.RecordBatch.from_arrays([s.pa.array(signed)], names=["fp"])
        dealt = s.pa.Table.from_batches(list(s._deal(1, iter([batch]))))
        found = s._links_in_bucket(dealt, 4).column("key")
        assert (found.null_count < len(found)) == (block == 40)
        assert (s.MARKS in dealt.column("kind").to_pylist()) == (many == 20)
        roots = {r.node: r.root for r in components(s.links(distinct)).collect()}
        got = [roots.get(int(f), int(f)) for f in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_stars_and_odd_edges(spark):
    edges = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (1, None), (0, 1), (0, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 500 for k in range(500, 560)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = s.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    assert s.near_duplicates(no_docs).count() == 0
    kept = s.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6]


def test_rows_that_share_an_id_keep_their_distinct_texts(spark):
    words = [" ".join(f"{k}w{i}" for i in range(30)) for k in range(4)]
    rows = [(1, words[0], "a"), (1, words[1], "b"), (1, words[1], "c"), (2, words[1], "d"), (3, words[2], "e"), (3, words[2], "e"), (None, words[2], "f"), (4, words[3], "g")]
    for seed in range(3):
        docs = spark.createDataFrame(sorted(rows, key=lambda r: hash((seed, r[2]))), "doc_id long, text string, other string").repartition(3)
        got = sorted(tuple(r) for r in s.one_of_each(docs).collect() if r.doc_id)
        assert [r[:2] for r in got] == sorted([(1, words[0]), (1, words[1]), (3, words[2]), (4, words[3])])
        assert seed == 0 or got == before
        before = got


def test_one_of_each_keeps_every_group(documents):
    rows = s.near_duplicates(documents).collect()
    assert {r.doc_id for r in s.one_of_each(documents).collect()} == {r.component_id for r in rows}
