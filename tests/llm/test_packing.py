import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkcorr.llm import packing as p
from sparkcorr.llm.registry import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["", " ", "a<|endoftext|>b", "<|startoftext|>", "  x\ty\r\nz  ", "it's İstanbul ΣΑΣ é ﬁ 1234 ", "a\x1cb c d", " ́a", "x.. y., z,. é. é, _. 3.14,15 a.'s it's,' don't. ...a", "ＡＢ．ｃ Ⅷ. ²,", "ÀÉ. ŒUVRE, ǅ. ", "µ. ÿ, ß.", "word" * 50, "😀.,"]


def test_the_encoder_is_the_tokenizer(tokenizer, documents):
    texts = [*ODD, *(r.text for r in documents.limit(300).collect())]
    encode = p.Encoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts)]
        assert got == [ids(tokenizer, t)[:-1] for t in texts]


def test_the_cache_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(p, "CACHED_PIECES", 50)
    encode, rng = p.Encoder(PATH), random.Random(1)
    for _ in range(20):
        text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 30) + "." for _ in range(40))
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == ids(tokenizer, text)[:-1]
        assert len(encode.known) <= 50 + 60 and len(encode.older) <= 50 + 60


def test_pieces_are_cut_and_encoded_many_at_once(tokenizer, monkeypatch):
    """Letters beyond ASCII at cuts; and new pieces reach the tokenizer in few texts."""
    edges = ["É.é,ÿ.", "×.×,÷.÷,", "a×.b÷,c", "ΑΒ.Γ,À.", "...,,a..b,.c", " .a ,b ", "\n.\n,x\n\n", "", ".", "ß.ẞ.ﬁ.é.", "<|endoftext|> a.b", "K.Å,", "a\u00a0.b\u2028.c\t.d\r\n.e"]
    rng = random.Random(2)
    edges += ["".join(rng.choice("aZ9.,  \nÉ×÷ÿΑé\u0301\t'<|") for _ in range(60)) for _ in range(400)]
    encode = p.Encoder(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(edges)] == [ids(tokenizer, t)[:-1] for t in edges]
    sent, whole = [], p.Encoder._whole
    monkeypatch.setattr(p.Encoder, "_whole", lambda self, texts: sent.extend(texts) or whole(self, texts))
    texts = [" ".join(f"q{k}x{j}" for j in range(50)) for k in range(100)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [ids(tokenizer, t)[:-1] for t in texts]
    assert len(sent) <= 10  # and not 5 000


def check(rows, encoded, size=4096):
    """Each id in one piece, sequences gapless, and only powers of two shorter than ``size``."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0
    got = sorted((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc, tokens in encoded.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(tokens)
        at = 0
        for r in mine:
            assert r.start == at
            at += r.length
            want.append((doc, len(tokens), r.start, r.length, zlib.crc32(np.array(tokens[r.start : at], "<u4").tobytes())))
    assert got == sorted(want)


def test_a_corpus(tokenizer, documents):
    rows = p.pack(documents, PATH).collect()
    check(rows, {r.doc_id: ids(tokenizer, r.text) for r in documents.collect()})
    pieces = len(rows) / 1000
    assert pieces < 1.5


def test_levels_minimise_the_sum_of_squares():
    rng = random.Random(2)
    packer = p.Packer(64)
    for k in range(2000):
        n = rng.randrange(1, 64)
        before = packer.count.copy()
        best = min((h for h in range(0, 64 - n + 1) if h == 0 or before[h]), key=lambda h: (squares(before, h, n), -h))
        assert packer._level(n) == best
        packer.add(k, n)
        assert packer.count[0] == 0 and all(packer.count[h] == len(packer.open.get(h, [])) for h in range(65))


def squares(count, level, n):
    after = count.copy()
    if level:
        after[level] -= 1
    if level + n < 64:
        after[level + n] += 1
    return int((after**2).sum())


def test_little_padding_and_few_windows_left_open():
    rng = random.Random(3)
    packer = p.Packer(4096)
    for k in range(5000):
        packer.add(k, rng.randrange(1, 6000))
    left = sum(map(len, packer.open.values()))
    assert left < 0.4 * (len(packer.done) + left)
    packer.finish()
    sizes = [sum(x[2] for x in w) for w in packer.done]
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes) and sum(n < 4096 for n in sizes) <= 12


def test_odd_rows(odd_docs, no_docs):
    rows = p.pack(odd_docs, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id == 5) == 40_001
    assert sum(r.start == 0 for r in rows) == 9
    assert p.pack(no_docs, PATH).count() == 0
