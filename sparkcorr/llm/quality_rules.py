"""Learned decision lists over text statistics.

``text_statistics`` counts what a rule may look at, in one pass over whole texts.
``learn_rules`` grows and prunes threshold conjunctions by sequential covering, on a bounded
sample of labelled rows. ``decision_list`` writes the rules as one ordered Spark conditional, so
that judging the corpus is a JVM-side projection.

Edge cases: a null text counts as an empty one (all counts 0, ``base_failed`` true); repeated
rows are judged one by one; an empty table gives an empty result; other columns are ignored.
Labels that are null, or that contradict each other for one document, are no evidence. With
fewer than ``2 * min_cover`` labelled rows or only one class no rule is learned, and the verdict
is that of the base checks alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkcorr.llm.common import hash_sample, map_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
WINDOW = 5

STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bare_words long"


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words that occurs at least twice."""
    windows = list(zip(*(words[i:] for i in range(size))))
    seen = set(windows)
    if len(seen) == len(windows):
        return 0
    counts = Counter(windows)
    covered, reach = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + size - max(at, reach)
            reach = at + size
    return covered


def statistics_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup_lines = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    kinds = Counter(words)
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        dup_lines,
        repeated_words(words),
        lines,
        len(UPPER.findall(text)),
        sum(n for word, n in kinds.items() if not any(map(str.isalnum, word))),
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of each row's whole text, under the column names of ``STATISTICS``."""

    def count(ids: list, texts: list) -> list:
        return [ids, *(list(c) for c in zip(*map(statistics_of, texts)))]

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), count, STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What the rules may test: counts, and shares that do not grow with a text's length."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "bare_share": F.col("n_bare_words") / words,
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Test:
    """``feature >= cut`` if ``above``, else ``feature <= cut``."""

    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.cut if self.above else x[:, self.feature] <= self.cut


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for test in self.tests:
            out &= test.holds(x)
        return out


def _best_test(x: np.ndarray, bad: np.ndarray, min_cover: int) -> tuple[float, Test] | None:
    """The threshold with the largest information gain on the covered rows (FOIL's measure)."""
    p0, n0 = bad.sum(), len(bad)
    before = np.log2(p0 / n0)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows before an edge lie below it
        if not len(edge):
            continue
        below = np.cumsum(b)[edge - 1]
        cuts = (v[edge] + v[edge - 1]) / 2
        for above, p, n in ((False, below, edge), (True, p0 - below, n0 - edge)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((p > 0) & (n >= min_cover), p * (np.log2(p / n) - before), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), Test(f, above, float(cuts[k])))
    return best


def _grow(x: np.ndarray, bad: np.ndarray, min_cover: int, max_tests: int) -> Rule:
    tests: list[Test] = []
    while len(tests) < max_tests and 0 < bad.sum() < len(bad):
        found = _best_test(x, bad, min_cover)
        if found is None:
            break
        tests.append(found[1])
        inside = found[1].holds(x)
        x, bad = x[inside], bad[inside]
    return Rule(tuple(tests))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float]:
    """Drop final tests while the held-out worth (p - n) / (p + n) does not fall."""
    best, worth = rule, -1.0
    for keep in range(len(rule.tests), 0, -1):
        shorter = Rule(rule.tests[:keep])
        inside = shorter.holds(x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        w = (p - n) / (p + n) if p + n else -1.0
        if w >= worth:
            best, worth = shorter, w
    return best, worth


def learn_rules(x: np.ndarray, bad: np.ndarray, *, min_cover: int = 5, min_precision: float = 0.9, max_rules: int = 16, max_tests: int = 4, tries: int = 8, seed: int = 7) -> list[Rule]:
    """Sequential covering: rules for the rows to reject, most telling first.

    A rule is grown on two thirds of the rows left and pruned on the rest, in ``tries`` random
    splits, so that few labels are no matter of luck. The best on all rows left is emitted if at least
    ``min_precision`` of what it covers is bad. Covered rows then leave.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    if len(x) < 2 * min_cover:
        return rules
    min_cover = max(min_cover, -(-int(bad.sum()) // 50))  # a rule for a handful is chance
    price = min_precision / (1 - min_precision)  # bad rows that a good one's loss must bring
    while len(rules) < max_rules and bad.sum() >= min_cover and not bad.all():
        best, gain = None, 0.0
        for _ in range(tries):
            grow = rng.random(len(x)) < 2 / 3
            if not 0 < bad[grow].sum() < grow.sum():
                continue
            rule, _ = _prune(_grow(x[grow], bad[grow], min_cover, max_tests), x[~grow], bad[~grow])
            inside = rule.holds(x)
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            if rule.tests and p + n >= min_cover and p - price * n > gain:
                best, gain = rule, p - price * n
        if best is None:
            break
        rules.append(best)
        inside = best.holds(x)
        x, bad = x[~inside], bad[~inside]
    return rules


def labelled_features(docs: DataFrame, labels: DataFrame, *, max_rows: int, label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and ``label = 0`` of a sample of about ``max_rows`` labelled documents that pass the base checks.

    Of rows that share an id one is taken, by its statistics' hash; the order is that of ids. So the rules don't depend on
    the order of rows.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high")
    sample = F.broadcast(hash_sample(known, "doc_id", max_rows))  # bounded by max_rows
    of_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample.select("doc_id"), "doc_id", "left_semi")
    stats = text_statistics(of_docs).where(~base_failed())
    names = stats.columns[1:]
    one = stats.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("s")).select("doc_id", "s.*")
    rows = one.join(sample, "doc_id").select("doc_id", *(c.alias(k) for k, c in features().items()), (F.col("low") == 0).alias("bad")).toPandas().sort_values("doc_id")
    return rows.drop(columns=["doc_id", "bad"]).to_numpy(float).reshape(-1, len(features())), rows["bad"].to_numpy(bool)


def decision_list(rules: list[Rule]) -> Column:
    """Index of the first rule that holds, from 1, as an ordered conditional; 0 if none does."""
    of = list(features().values())
    out = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for t in rule.tests:
            holds = holds & (of[t.feature] >= F.lit(t.cut) if t.above else of[t.feature] <= F.lit(t.cut))
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def describe(rules: list[Rule]) -> list[str]:
    names = list(features())
    return [" and ".join(f"{names[t.feature]} {'>=' if t.above else '<='} {t.cut:.6g}" for t in r.tests) for r in rules]


def judge(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    ``max_rows`` bounds the labelled rows that the rules are fitted on. ``rule`` is the number of
    the rule that rejected the row, 0 if none.
    """
    rules = learn_rules(*labelled_features(docs, labels, max_rows=max_rows))
    judged = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", decision_list(rules).cast("int"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass. The verdict comes from a row's own text, so rows are
    matched by their content and not only by ``doc_id``."""
    rules = learn_rules(*labelled_features(docs, labels, **({"max_rows": 20_000} | options)))
    columns, names = docs.columns, [n.split()[0] for n in STATISTICS.split(", ")[1:]]
    mark = "__"
    while any(c.startswith(mark) for c in columns):  # no column of ours may clash with the documents'
        mark += "_"
    schema = StructType([*docs.schema.fields, *(StructField(mark + n, LongType()) for n in names)])
    text_at = columns.index("text")

    def count(*cols: list) -> list:
        return [*cols, *(list(c) for c in zip(*map(statistics_of, cols[text_at])))]

    clash = {c: f"{mark}own_{c}" for c in columns if c in names}
    counted = map_batches(docs, count, schema).withColumnsRenamed(clash).withColumnsRenamed({mark + n: n for n in names})
    kept = counted.where(~base_failed() & (decision_list(rules) == 0)).drop(*names)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}).select(*columns)
