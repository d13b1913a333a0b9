"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Each scores its log-likelihood ratio between content and
the rest, learned from pages that label their own content with one ``article`` or ``main``
element: words score positive, the tags of menus and page frames negative. A linear scan finds
the contiguous region of the highest total; its blocks are the text. Elements that are never
content (scripts, styles, forms, menus, adverts, notices, reader comments) score nothing and are
left out, inside the region too.

Edge cases: a null or empty page, and one whose every region scores below zero, has an empty text;
unclosed elements end with the page, but an unclosed one that is to be left out ends at the next
tag, so that it can't swallow an article; ties go to the first region; repeated rows are extracted
one by one; an empty table gives an empty result; other columns are ignored. Without any labelled
page, ``DEFAULT_WEIGHTS`` hold.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import hash_sample, map_batches

#: HTML's elements by their part in a page.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes")
NEVER = frozenset(RAW) | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "label", "fieldset", "canvas", "audio", "video"}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id attributes, and roles, that mark what isn't content.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "comment comments disqus respond cookie cookies consent notice notices popup modal newsletter subscribe signup share sharing social related recommended widget toolbar pagination pager".split()
)
FRAME_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"})
PROSE = INLINE - {"a"} | frozenset("p br h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dl dt dd".split())
#: The other elements of HTML; tags of any other name count as one.
KNOWN = NEVER | INLINE | VOID | PROSE | frozenset("html body article main section div address hgroup ul ol li dir table caption thead tbody tfoot tr th td colgroup center details summary hr legend datalist optgroup output progress meter search video picture map frame frameset slot".split())
#: Score of a word, and of tags, where nothing is learned; tags of prose then score nothing.
DEFAULT_WEIGHTS = {"word": 0.5, "tag": -2.0, "open article": -8.0, "close article": -8.0}

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

Token = tuple[str, str]  # kind (open, close, text), name or text


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that closes a tag, outside quotes; -1 if there is none."""
    while True:
        stop = _STOP.search(page, at)
        if not stop:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = page.find(stop[0], stop.end()) + 1
        if not at:
            return -1


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or raw text, attributes); comments, declarations and raw elements are gone.

    One pass: a ``<`` that opens nothing, or a tag that nothing closes, is text. Where a tag's quotes leave it
    unclosed, quotes count for nothing from there on, so that no scan to the end is made twice.
    """
    out: list[tuple[str, str, str]] = []
    at, n = 0, len(page)
    quotes = True
    last = page.rfind(">")
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            out.append(("text", page[at:begin], ""))
        if begin == n:
            break
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _OPEN.match(page, at)
        if tag is None:
            end = page.find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") and at < last else -1
            if end < 0:
                out.append(("text", "<", ""))
                at += 1
            else:
                at = end + 1
            continue
        end = _tag_end(page, tag.end()) if quotes and at < last else -1
        if end < 0:
            quotes = False
            end = page.find(">", tag.end()) if at < last else -1
            if end < 0:
                out.append(("text", "<", ""))
                at += 1
                continue
        name = tag[2].lower()
        at = end + 1
        if name in _RAW_END and not tag[1]:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else n
            continue
        out.append(("close" if tag[1] else "open", name, page[tag.end() : end]))
    return out


def _left_out(name: str, rest: str) -> bool:
    if name in NEVER:
        return True
    if not rest or name in ("body", "html", "article", "main"):
        return False
    for key, value in _ATTR.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in FRAME_ROLES:
            return True
        if key in ("class", "id") and any(w in FRAME_WORDS for name in value.split() for w in (name, *re.split(r"[-_]+", name)[:1])):
            return True
    return False


def _skips(found: list[tuple[str, str, str]]) -> list[bool]:
    """Whether each token belongs to an element that is left out."""
    out = [False] * len(found)
    last = len(found)
    end_of = [-1] * last  # of each opening tag, the closing one, by depth among tags of its name
    waiting: dict[str, list[int]] = {}
    for k, (kind, name, _) in enumerate(found):
        if kind == "open" and name not in VOID:
            waiting.setdefault(name, []).append(k)
        elif kind == "close" and waiting.get(name):
            end_of[waiting[name].pop()] = k
    k = 0
    while k < last:
        kind, name, rest = found[k]
        if kind != "open" or not _left_out(name, rest):
            k += 1
            continue
        if name in VOID:
            end = k
        elif end_of[k] >= 0:
            end = end_of[k]
        else:
            end = k + 1 if k + 1 < last and found[k + 1][0] == "text" else k
        out[k : end + 1] = [True] * (end + 1 - k)
        k = end + 1
    return out


def _key(kind: str, name: str) -> str:
    return "word" if kind == "text" else f"{kind} {name if name in KNOWN else '?'}"


def label_counts(page: str | None) -> Counter:
    """(key, inside) counts of a page with exactly one ``article``, or else one ``main``; else nothing."""
    found = tokens(page or "")
    out: Counter = Counter()
    for name in ("article", "main"):
        opens = [k for k, t in enumerate(found) if t[:2] == ("open", name)]
        closes = [k for k, t in enumerate(found) if t[:2] == ("close", name)]
        if len(opens) == len(closes) == 1 and opens[0] < closes[0]:
            skip = _skips(found)
            for k, (kind, value, _) in enumerate(found):
                inside = opens[0] < k < closes[0]
                n = len(entities.unescape(value).split()) if kind == "text" else 1
                if n and not (inside and skip[k]):
                    out[_key(kind, value), inside] += n
            break
    return out


def learn_weights(pages: DataFrame, *, max_pages: int = 2_000, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Log-likelihood ratios from a sample of about ``max_pages`` pages; ``tag`` is for unseen ones."""
    sample = hash_sample(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")), "page_id", max_pages).select("html")

    def count(texts: list) -> list:
        rows = [(key, inside, n) for (key, inside), n in sum(map(label_counts, texts), Counter()).items()]
        return list(zip(*rows)) if rows else [[], [], []]

    counted = map_batches(sample, count, "key string, inside boolean, n long")
    sums = counted.groupBy("key").agg(*(F.sum(F.when(F.col("inside") == F.lit(side), F.col("n")).otherwise(0)).alias(name) for side, name in ((True, "within"), (False, "without"))))
    rows = sums.collect()  # at most one a kind of tag that is known
    total = [sum(r[k] for r in rows) for k in ("within", "without")]
    if not all(total):
        return DEFAULT_WEIGHTS
    size = len(rows) + 1
    ratio = lambda a, b: math.log((a + 1) / (total[0] + size)) - math.log((b + 1) / (total[1] + size))
    learned = {r["key"]: ratio(r["within"], r["without"]) for r in rows}
    return {k: w for k, w in learned.items() if k != "word"} | {"word": max(learned.get("word", 0), 0.1), "tag": min(ratio(0, 0), -1.0)}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the highest positive total."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = tokens(page or "")
    skip = _skips(found)
    word, other = weights["word"], weights["tag"]
    scores = []
    for (kind, value, _), left_out in zip(found, skip):
        if left_out:
            scores.append(0.0)
        elif kind == "text":
            scores.append(word * len(value.split()))
        else:
            scores.append(weights.get(_key(kind, value), 0.0 if value in PROSE else other))
    start, end = best_region(scores)
    blocks, now = [], []
    for k in range(start, end):
        kind, value, _ = found[k]
        if skip[k]:
            now.append(" " if kind != "text" else "")
        elif kind == "text":
            now.append(value)
        elif value == "br":
            now.append(" ")
        elif value not in INLINE:
            blocks.append(now)
            now = []
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in [*blocks, now])
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, *, max_pages: int = 2_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page. ``max_pages`` bounds the pages learned from."""
    weights = learn_weights(pages, max_pages=max_pages, id_col=id_col, html_col=html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(ids: list, urls: list, texts: list) -> list:
        out = [main_text(t, weights) for t in texts]
        return [ids, urls, out, list(map(len, out))]

    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return map_batches(rows, run, schema, step=500)
