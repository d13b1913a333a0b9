"""Offset-preserving deobfuscation of personal data.

Base identifiers are found in the text as it stands. Then transducers rewrite the text --
homoglyphs and full-width forms to ASCII, invisible characters to nothing, spelled digits to
digits, at/dot disguises to ``@`` and ``.`` -- each keeping, for every character that it emits,
the source span that made it. Identifiers found in the rewritten text are mapped back to source
spans, and added unless they lie within an identifier that is there already; one that goes beyond a
base identifier, of which a disguise had left a part only, is added beside it.

Edge cases: a null text counts as an empty one (no spans; the digest of the empty string);
offsets are code points, ends exclusive; repeated rows are searched one by one; an empty table
gives an empty result; other columns are ignored, whatever their names. All scans are linear in
the text but for the walk left of each ``@``, which stops at the previous one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")

#: The identifiers' forms.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like these ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ",
        "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXovp",
        strict=True,
    )
)
#: Digits as words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Characters that show nothing: soft hyphen, zero-width ones, word joiner, byte order mark.
INVISIBLE = frozenset("­​‌‍⁠﻿")

_DIGIT_WORD = "|".join(SPELLED)
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:(?:{_DIGIT_WORD}|[0-9])(?:[ ,-]{{1,2}}(?=[A-Za-z0-9])|(?![^\W_]))){{3,}}", re.I)
_SPELLED_ONE = re.compile(rf"(?<![A-Za-z0-9])(?:{_DIGIT_WORD})(?![A-Za-z0-9])", re.I)
_SPELLED_HINT = re.compile(rf"(?<![A-Za-z0-9])(?:{_DIGIT_WORD})[ ,-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])(?![A-Za-z])", re.I)
_BRACKETED = re.compile(r"\s?[(\[{<]\s?(at|dot|plus)\s?[)\]}>]\s?", re.I)
_WORDY = re.compile(r"(?<=[A-Za-z0-9]) (?:at) (?=[A-Za-z0-9-]+(?: dot |\.)[A-Za-z0-9-])(?=\S+(?: dot \S+)+)", re.I)
_WORDY_DOT = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.I)
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:(?:\.| dot )[A-Za-z0-9-]+)+", re.I)
_DIGIT_DOT = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)
_SPOKEN_PLUS = re.compile(r"(?<![A-Za-z0-9])plus (?=[0-9])", re.I)
_DISGUISED_DOMAIN = re.compile(r"[0-9] dot [0-9]|plus [0-9]|[(\[{<]\s?(?:at|dot|plus)\s?[)\]}>]| at \S+ dot |@[A-Za-z0-9.-]+ dot ", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is all that may be one before each ``@``."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


FINDERS: dict[str, Callable[[str], list[tuple[int, int]]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}

Span = tuple[int, int, str]


def find(text: str) -> list[Span]:
    """Base identifiers: (start, end, kind)."""
    return [(s, e, kind) for kind, finder in FINDERS.items() for s, e in finder(text)]


class Traced:
    """A rewritten text; ``starts[i]``, ``ends[i]`` is the source span that made character ``i``."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace non-overlapping spans, given in order; each new character maps to the whole of its span."""
        if not edits:
            return
        parts, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            parts += [self.text[at:s], new]
            starts += [*self.starts[at:s], *[self.starts[s]] * len(new)]
            ends += [*self.ends[at:s], *[self.ends[e - 1]] * len(new)]
            at = e
        self.text = "".join([*parts, self.text[at:]])
        self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _plain_char(ch: str) -> str | None:
    """What stands for a character that isn't ASCII; None if it stays."""
    if ch in INVISIBLE:
        return ""
    if ch in HOMOGLYPHS:
        return HOMOGLYPHS[ch]
    if unicodedata.category(ch) == "Nd":
        return str(unicodedata.digit(ch))
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() and not folded.isspace() else None


_PLAIN: dict[str, str | None] = {}


def _lookalikes(t: Traced) -> None:
    if t.text.isascii():
        return
    for ch in set(t.text):
        if ch > "\x7f" and ch not in _PLAIN:
            _PLAIN[ch] = _plain_char(ch)
    odd = [ch for ch in set(t.text) if _PLAIN.get(ch) is not None]
    if odd:
        t.rewrite([(m.start(), m.end(), _PLAIN[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", t.text)])


def _spelled(t: Traced) -> None:
    if not _SPELLED_HINT.search(t.text):
        return
    edits = []
    for run in _SPELLED_RUN.finditer(t.text):
        at = run.start()
        for m in _SPELLED_ONE.finditer(t.text, run.start(), run.end()):
            if m.start() > at and edits and edits[-1][1] == at:
                edits.append((at, m.start(), ""))  # the gap between two digits goes
            edits.append((*m.span(), SPELLED[m[0].lower()]))
            at = m.end()
    t.rewrite([e for e in edits if e[0] < e[1]])


def _disguises(t: Traced) -> None:
    if not _DISGUISED_DOMAIN.search(t.text):
        return
    sign = {"at": "@", "dot": ".", "plus": "+"}
    t.rewrite([(*m.span(), sign[m[1].lower()]) for m in _BRACKETED.finditer(t.text)])
    t.rewrite([(*m.span(), "@") for m in _WORDY.finditer(t.text)])
    t.rewrite([(*m.span(), ".") for m in _DIGIT_DOT.finditer(t.text)])
    t.rewrite([(*m.span(), "+") for m in _SPOKEN_PLUS.finditer(t.text)])
    t.rewrite([(*d.span(), ".") for m in _AFTER_AT.finditer(t.text) for d in _WORDY_DOT.finditer(t.text, *m.span())])


TRANSDUCERS = (_lookalikes, _spelled, _disguises)


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added ones, by start, then kind."""
    text = text or ""
    base = find(text)
    traced = Traced(text)
    for apply in TRANSDUCERS:
        apply(traced)
    order = lambda x: (x[0], KINDS.index(x[2]))
    added: list[Span] = []
    if traced.text != text:
        mapped = [(*traced.source(s, e), kind) for s, e, kind in find(traced.text)]
        reach = 0
        # by start, the longest first: what ends by then lies within one before it
        for (s, e, kind), new in sorted([*((x, False) for x in base), *((x, True) for x in mapped)], key=lambda x: (x[0][0], -x[0][1], x[1], KINDS.index(x[0][2]))):
            if new and e > reach:
                added.append((s, e, kind))
            reach = max(reach, e)
    return sorted(base, key=order), sorted(added, key=order)


def _joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifiers of every row: base ones by kind and digest, and the spans with the added ones."""

    def search(ids: list, texts: list) -> list:
        rows = []
        for text in texts:
            base, added = spans(text)
            every = sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(added)))
        return [ids, *(list(c) for c in zip(*rows))]

    return map_batches(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        search,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def masked(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind; overlapping ones go together."""
    if text is None:
        return None
    base, added = spans(text)
    out, at = [], 0
    for s, e, kind in sorted([*base, *added]):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every identifier in ``text`` masked, and ``n_chars`` that of the new text."""
    columns = docs.columns
    text_at = columns.index("text")

    def apply(*cols: list) -> list:
        new = list(map(masked, cols[text_at]))
        return [new if k == text_at else c for k, c in enumerate(cols)]

    out = map_batches(docs, apply, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
