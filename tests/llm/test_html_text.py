import html
import random
import re
import time

import pytest

from sparkcorr.llm import html_text as h


def truth(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_extracts_exactly_the_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.join(h.extract(pages).drop("url"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        assert r.text == truth(r.html) and r.n_chars == len(r.text)


def test_unlabelled_pages_by_weights_from_labelled_ones(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = h.learn_weights(pages)
    for r in pages.limit(100).collect():
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert h.main_text(bare, weights) == truth(r.html)


def test_best_region_is_the_brute_force_one():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.uniform(-2, 2) for _ in range(rng.randrange(1, 20))]
        a, b = h.best_region(s)
        assert abs(sum(s[a:b]) - max(0, max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))) < 1e-9


PAGE = """<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; line</h1><p>One  two&nbsp;three<br>four</p>
<aside>Related stuff here</aside><div class="ad-box">Buy now and save a lot</div><script>if (a < b) { x = "</p>" }</script><p>Five <b>six</b> seven &lt;eight&gt;</p><!-- no --><form><input value=q>Search me</form></article>
<section class="comments"><p>I like this a lot, thanks for it</p></section><footer>Legal words at the end</footer></body></html>"""


@pytest.mark.parametrize("weights", [h.DEFAULT_WEIGHTS])
def test_what_is_left_out(weights):
    assert h.main_text(PAGE, weights) == "Head & line\n\nOne two three four\n\nFive six seven <eight>"


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "no tags at all, only words", "x"), (2, "u", "no tags at all, only words", "x"), (3, "u", "<p>" * 20_000 + "deep", "x"), (4, "u", "<p>a < b &am</p><div class=ad>open", "x"), (5, "u", "<!-- open", "x")]
    odd = spark.createDataFrame(rows, schema)
    got = h.extract(odd).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id == 2] == ["no tags at all, only words"] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (None, 1, 5))
    assert h.extract(odd.limit(0)).count() == 0


HOSTILE = ["<a x ", "<a \">\" ", "<a \" ' ", "<a ' >", "<!x ", "</", "<", "<script>", "<!--", "<div class=comment>x</div>", "<div class=ad>", "<p><div id=comments>", "</div>", "<nav>y", "&amp", "<a href='\">"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_pages_take_linear_time(part):
    page = "<article><p>Some words here</p></article>" + part * (400_000 // len(part))
    began = time.process_time()
    h.main_text(page, h.DEFAULT_WEIGHTS)
    h.label_counts(page)
    assert time.process_time() - began < 10


def test_quotes_hide_tags_ends():
    assert h.tokens('<p title="a > b">x</p><i a=\'">\'>y') == [("open", "p", ' title="a > b"'), ("text", "x", ""), ("close", "p", ""), ("open", "i", " a='\">'"), ("text", "y", "")]
    assert h.tokens('<p a="x>y</p>') == [("open", "p", ' a="x'), ("text", "y", ""), ("close", "p", "")]
    assert h.tokens("a <3 b <b") == [("text", "a ", ""), ("text", "<", ""), ("text", "3 b ", ""), ("text", "<", ""), ("text", "b", "")]


INSIDE = [
    '<div class="comments"><p>{}</p><p>{}</p></div>',
    '<section id="comment-list"><div class="reply"><p>{}</p></div><p>{}</p></section>',
    '<aside><h2>{}</h2><p>{}</p></aside>',
    '<div class="advert-box"><p>{}</p><div>{}</div></div>',
    '<p class="cookie-notice">{} {}</p>',
    '<div role="complementary"><p>{}</p>{}</div>',
    '<form><label>{}</label><textarea>{}</textarea></form>',
    '<div hidden><p>{}</p>{}</div>',
    '<footer><p>{}</p>{}</footer>',
]


def test_notices_adverts_and_comments_inside_the_content(spark, sf_dir):
    """Given pages with one such element put at a random place of the article: the same text."""
    rng = random.Random(9)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = h.learn_weights(pages)
    for k, r in enumerate(pages.limit(200).collect()):
        words = [" ".join(rng.choice(truth(r.html).split()) for _ in range(rng.randrange(3, 60))) for _ in range(2)]
        places = [m.start() for m in re.finditer(r"<p>", r.html) if r.html.index("<article>") < m.start() < r.html.index("</article>")]
        at = rng.choice(places)
        page = r.html[:at] + INSIDE[k % len(INSIDE)].format(*map(html.escape, words)) + r.html[at:]
        assert h.main_text(page, weights) == truth(r.html)
