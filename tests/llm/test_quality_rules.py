import re
from collections import Counter

import numpy as np

from sparkcorr.llm import quality_rules as q

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(documents):
    rows = documents.join(q.text_statistics(documents), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_rules_learn_a_conjunction_and_nothing_from_noise():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    bad = (x[:, 1] > 0.8) & (x[:, 2] < 0.4)
    rules = q.learn_rules(x, bad)
    caught = np.zeros(len(x), bool)
    for r in rules:
        caught |= r.holds(x)
    assert (caught & ~bad).sum() <= 0.1 * bad.sum() and (caught & bad).sum() >= 0.9 * bad.sum()
    assert not q.learn_rules(x[:, :1], rng.random(3000) < 0.1)
    assert not q.learn_rules(x, np.zeros(3000, bool)) and not q.learn_rules(x[:0], bad[:0])


def test_held_out_labels_are_met(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = q.judge(documents, train).join(test, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_the_bound_on_labelled_rows_holds(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    x, _ = q.labelled_features(documents, labels, max_rows=100)
    assert 20 < len(x) < 160


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    rows = q.judge(odd_docs, none).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) == 2
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert all(r.n_words == 0 and not r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert next(r for r in rows if r.doc_id == 5).n_repeat_words == 40_000
    assert q.judge(no_docs, none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 0, 0), (1, 1, 0)], LABELS)
    assert q.judge(odd_docs, odd).count() == 9
    kept = q.keep_good(odd_docs, none)
    assert kept.columns == odd_docs.columns and sorted(r.n_words or 0 for r in kept.collect()) == [0, 7, 7]
