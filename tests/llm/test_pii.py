import hashlib
import re
import time

import pytest

from sparkcorr.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    text = text or ""
    checks = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, luhn),
        ("phone", PHONE, lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    out = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(checks) for m in p.finditer(text) if ok(m[0])]
    return [f"{name}:{s}:{e}" for s, _, e, name in sorted(out)]


def test_base_spans_match_brute_force(documents):
    rows = documents.join(pii.find_pii(documents), "doc_id").collect()
    for r in rows:
        want = brute(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [sum(x.startswith(k) for x in want) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
    assert sum(r.n_email + r.n_phone for r in rows) > 20 and sum(r.n_added for r in rows) == 0


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y", "@a.b", "a..b@c-d.e.f.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255", "4539 1488 0343 6467 4539", "+1(2)3-4.5 678 90 +", "++44 20 7946 0958", "a@b.c.d@e.f", "%@a.b-" * 5])
def test_base_corner_cases(text):
    base, _ = pii.spans(text)
    assert [f"{k}:{s}:{e}" for s, e, k in base] == brute(text)


@pytest.mark.parametrize(
    "text,kind,source",
    [
        ("mail john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
        ("write jane at example dot co dot uk ok", "email", "jane at example dot co dot uk"),
        ("jоhn＠exаmple．com", "email", "jоhn＠exаmple．com"),
        ("x a​b@ex​ample.com y", "email", "a​b@ex​ample.com"),
        ("call +one two three four five six seven eight nine zero", "phone", "+one two three four five six seven eight nine zero"),
        ("call plus four four two zero seven nine four six zero nine five eight.", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("card four five three nine 1488 0343 6467", "card", "four five three nine 1488 0343 6467"),
        ("host １０.2.3.4 up", "ip", "１０.2.3.4"),
        ("host 192 dot 168 dot 1 dot 20 up", "ip", "192 dot 168 dot 1 dot 20"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, added = pii.spans(text)
    assert not base and [(k, text[s:e]) for s, e, k in added] == [(kind, source)]
    assert pii.masked(text) == text.replace(source, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    "text,kind,source",
    [
        ("mail jоhn@example.com now", "email", "jоhn@example.com"),
        ("mail john@mail.exаmple.com now", "email", "john@mail.exаmple.com"),
        ("mail john@example.co dot uk now", "email", "john@example.co dot uk"),
        ("host 10.2.3.1４ up", "ip", "10.2.3.1４"),
    ],
)
def test_a_disguise_that_leaves_a_base_identifier_is_added_whole(text, kind, source):
    base, added = pii.spans(text)
    assert base == pii.find(text) and len(base) == 1 and [(k, text[s:e]) for s, e, k in added] == [(kind, source)]
    assert pii.masked(text) == text.replace(source, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["jоhn is john@example.com", "１ of +44 20 7946 0958"])
def test_a_base_identifier_is_not_added_again(text):
    assert len(pii.find(text)) == 1 and pii.spans(text) == (pii.find(text), [])


@pytest.mark.parametrize("end", "!?;:\"']/…")
def test_any_sign_ends_a_spelled_run(end):
    text = "call +one two three four five six seven eight nine"
    assert pii.masked(text + end) == "call <PHONE>" + end


@pytest.mark.parametrize("text", ["we met at home dot", "one two buckle my shoe", "look at that. Then dot the i", "ten (at most) or [dot] so", "room one oh one"])
def test_plain_prose_stays(text):
    assert pii.spans(text) == ([], []) and pii.masked(text) == text


def test_long_hostile_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "@" * 50_000, "a@" * 50_000, "one " * 50_000, "+1 " * 50_000):
        pii.spans(text)


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find_pii(odd_docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 9 and all(r.base_sha256 == empty and r.spans == "" for r in rows if r.doc_id in (2, 3, 4))
    assert next(r for r in rows if r.doc_id == 6).n_email == 30
    assert pii.find_pii(no_docs).count() == 0
    masked = pii.mask(odd_docs)
    assert masked.columns == odd_docs.columns and masked.dtypes == odd_docs.dtypes
    assert {r.doc_id: r.n_chars for r in masked.collect()}[6] == len(("é😀 ß\x00 <EMAIL> ") * 30)


HOSTILE = ["a@a.a ", "john at mail dot com ", "a@", "@a.b", "1.2.3.4 ", "1 ", "+1 ", "+1(", "4111 1111 1111 1111 ", "one two ", "one-", "plus 1", "jоhn@example.com ", "(at)", " at x dot y", "dot ", "1.", "a@b dot c dot ", "one two three at x dot y ", "оne1 "]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_texts_take_linear_time(part):
    began = time.process_time()
    pii.masked(part * (200_000 // len(part)))
    assert time.process_time() - began < 15
