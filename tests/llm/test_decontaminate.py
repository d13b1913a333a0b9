import random

import pytest

from sparkcorr.llm import decontaminate as d

ITEM = "On Monday the farmer Alice sold 12 kg of apples to Bob and then Alice bought 3 sheep from Bob in the old market town."


def found(text, items=((1, ITEM),), by_windows=True):
    """Items in a text with their longest runs: along the diagonals of shared windows, or along all of them."""
    out = {}
    for variant, (t, u) in enumerate(zip(d.variants([text]), d.variants([i for _, i in items]))):
        there, there_marks = t.row(0)
        places = {}
        for size in range(4, 9):
            hashes, at, _ = t.windows(size, variant)
            for h, x in zip(hashes.view("int64").tolist(), at.tolist()):
                places.setdefault(h, []).append(x)
        starts = {(k, x - place) for k, _, h, place in d.item_windows(u, variant) for x in places.get(h, [])}
        if not by_windows:
            starts = {(k, s) for k in range(len(items)) for s in range(-len(u.row(k)[0]), len(there))}
        for k, start in starts:
            tokens, marks = u.row(k)
            skip, first, words = max(0, -start), max(0, start), sum(m >> 3 for m in marks)
            run = d.consistent_run((tokens[skip:], marks[skip:]), (there[first:], there_marks[first:]), words)
            if run >= min(d.MIN_RUN, words) > 0:
                out[items[k][0]] = max(run, out.get(items[k][0], 0))
    return out


def run_by_brute_force(item, doc, words):
    best, n = 0, min(len(item[0]), len(doc[0]))
    for i in range(n):
        there, back, length, literal = {}, {}, 0, 0
        for k in range(i, n):
            a, ma, b, mb = item[0][k], item[1][k], doc[0][k], doc[1][k]
            slot = (ma & 3) == (mb & 3) != 0 or bool(ma & 4 and mb & 4)
            if not slot and a != b or slot and (there.setdefault(a, b) != b or ma & 3 != d.UNIT and back.setdefault(b, a) != a):
                break
            length += ma >> 3
            literal += ma >> 3 if a == b or not slot else 0
            if literal >= d.MIN_LITERAL and (2 * literal >= length or length == words):
                best = max(best, length)
    return best


def test_runs_against_all_sub_runs():
    rng = random.Random(3)
    for _ in range(3000):
        n, kinds = rng.randrange(1, 26), rng.choice([[0, 0, 0, 1, 3], [0, 1, 2, 3], [1, 3, 3]])
        marks = [8 * rng.choice([1, 1, 2]) + rng.choice(kinds) + 4 * (rng.random() < 0.1) for _ in range(n)]
        item = [rng.choice("pqrs") for _ in marks], marks
        doc = [a if rng.random() < 0.8 else rng.choice("pqrs") for a in item[0]], [m if rng.random() < 0.95 else 8 + rng.choice(kinds) for m in marks]
        words = sum(m >> 3 for m in marks)
        assert d.consistent_run(item, doc, words) == run_by_brute_force(item, doc, words)


def test_a_contradiction_ends_only_runs_that_hold_both():
    item = "then we add 3 apples then put the ripe fruit 3 times into the red bowl again"
    doc = "then we add 5 apples then put the ripe fruit 7 times into the red bowl again"
    assert found(doc, [(1, item)]) == {1: 13}


@pytest.mark.parametrize("item,text,hit", [("Who wrote the red book", "so who wrote the red book then", True), ("Who wrote the red book", "so who wrote the blue book then", False), ("add 3 to 4 and 5 to 6 and 7", "we add 1 to 2 and 8 to 9 and 4 here", True), ("What is 3 4", "and what is 5 6 then", False), ("is 3 4 5 6 7 8 9 of it", "is 1 2 3 4 5 6 7 of it", False), ("is 3 4 5 6 7 8 9 of it now", "is 1 2 3 4 5 6 7 of it now", True)])
def test_short_items_and_numbers(item, text, hit):
    assert bool(found(text, [(1, item)])) == hit


def test_reparameterised_questions_are_caught():
    assert found("So. " + ITEM + " Yes.") == {1: 25} or found("So. " + ITEM)[1] >= 20
    assert 1 in found("so on Monday the farmer Carol sold 15 lb of apples to Dave and then Carol bought 9 sheep from Dave in the old market town")


@pytest.mark.parametrize("old,new", [("Alice", "Mary Ann"), ("Bob", "Jean Luc Picard"), ("12 kg", "15"), ("3 sheep", "3 kg sheep")])
def test_slots_of_another_count_of_words_are_caught(old, new):
    assert found("So. " + ITEM.replace(old, new))[1] >= 20
    assert 1 in found("So. " + ITEM, [(1, ITEM.replace(old, new))])


def test_joined_slots_must_be_consistent():
    text = "the farmer Mary Ann sold 15 lb of apples to Jean Luc and then Erin Lee bought 9 sheep from Frank in the old"
    assert found(text) == {1: 14}  # from after the first Alice, up to before the second Bob
    assert not found(text.replace("Jean Luc", "Erin Lee"))


def test_inconsistent_slots_are_not_one_question():
    mixed = "the farmer Carol sold 15 lb of apples to Dave and then Erin bought 9 sheep from Frank in the old"
    assert found(mixed) == {1: 14}
    assert not found(mixed.replace("Dave", "Erin"))
    assert not found(mixed.replace("9 sheep", "9 goats"))


def test_chance_is_not_contamination():
    assert not found("the farmer sold apples in the old market town on a fine day and went home")
    assert not found("In 1 of 2 or 3 of 4 or 5 of 6 or 7 of 8 or 9 of 10 or 11 of 12 cases")


def brute(texts, items, n=13):
    """Documents that hold n consecutive literal tokens of an item, case aside."""
    words = lambda t: [w.lower() for w in d.TOKEN.findall(t or "") if w not in d.END]
    grams = set()
    for _, t in items:
        w = words(t)
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return [any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)) for w in map(words, texts)]


def test_all_literal_leaks_are_found_and_clean_documents_kept(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    rows = documents.orderBy("doc_id").collect()
    want = {r.doc_id for r, b in zip(rows, brute([r.text for r in rows], items)) if b}
    got = {r.doc_id for r in d.contamination(documents, benchmark).where("contaminated").collect()}
    assert got == want and want
    assert {r.doc_id for r in d.keep_clean(documents, benchmark).collect()} == {r.doc_id for r in rows} - got


def reparameterised(seed, n=120):
    """Items, and texts that hold them with other numbers, names and units, or with contradictions."""
    rng = random.Random(seed)
    names, units = ["Alice", "Bob", "Carol Ann", "Dave", "Mary Lou Smith"], ["kg", "lb", "days", "euros"]
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    def item():
        return [rng.choice([str(rng.randrange(9)) + " " + rng.choice(units), str(rng.randrange(30)), rng.choice(names)]) if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.choice([5, 7, 9, 16, 30]))]
    items = [item() for _ in range(12)]
    texts = []
    for _ in range(n):
        slots = {}
        part = []
        for w in rng.choice(items):
            kind = "name" if w[0].isupper() else "number" if w[0].isdigit() else None
            if kind and rng.random() < 0.9:
                new = rng.choice(names) if kind == "name" else str(rng.randrange(50)) + (" " + rng.choice(units) if rng.random() < 0.5 else "")
                part.append(slots.setdefault(w, new) if rng.random() < 0.9 else new)
            else:
                part.append(w if rng.random() < 0.98 else rng.choice(words))
        fill = lambda: [rng.choice(words) for _ in range(rng.randrange(12))]
        texts.append(" ".join(["So", *fill(), *part[rng.choice([0, 0, 2]) :], *fill()]))
    return [(k, " ".join(["Now", *i])) for k, i in enumerate(items)], texts


def test_the_query_against_brute_force(spark, monkeypatch):
    """Every item along the diagonals of windows, and along all, against the join; and the same with the bitmap."""
    items, texts = reparameterised(5)
    want = [found(t, items) for t in texts]
    # an item of few windows is missed only if a word that is a slot on one side alone is in each of them
    every = [found(t, items, by_windows=False) for t in texts]
    assert all(w.items() <= e.items() for w, e in zip(want, every)) and sum(map(len, want)) >= 0.95 * sum(map(len, every))
    assert all(k in w for w, e in zip(want, every) for k, run in e.items() if run > d.MIN_RUN)
    schema = "doc_id long, text string"
    docs, benchmark = spark.createDataFrame(list(enumerate(texts)), schema).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for most in (d.SENT_HASHES, 5):
        monkeypatch.setattr(d, "SENT_HASHES", most)
        got = {r.doc_id: (r.item_ids, r.longest_run) for r in d.contamination(docs, benchmark).collect()}
        assert got == {k: (",".join(map(str, sorted(w))), max(w.values(), default=0)) for k, w in enumerate(want)}
    assert sum(map(bool, want)) > 30 and not all(want)


def test_odd_rows(spark, odd_docs, no_docs):
    schema = "item_id long, text string, doc_id long"
    odd = spark.createDataFrame([(None, "plain words that say a little, and then some more of them.", 1), (2, None, 1), (3, "", 1), (4, "word", 1)], schema)
    rows = d.contamination(odd_docs, odd).collect()
    assert len(rows) == 9 and sorted(r.item_ids for r in rows if r.contaminated) == ["-1"] * 3
    assert not d.contamination(odd_docs, odd.limit(0)).where("contaminated").count()
    assert d.contamination(no_docs, odd).count() == 0
    clean = d.keep_clean(odd_docs, odd)
    assert clean.columns == odd_docs.columns and clean.count() == 6


@pytest.mark.parametrize("n,hit", [(12, False), (13, True)])
def test_a_run_of_thirteen_tokens_is_enough(n, hit):
    words = [f"w{chr(97 + k)}{chr(98 + k)}" for k in range(24)]
    text = " ".join(w.replace("w", "v") for w in words)
    assert bool(found("some other start " + " ".join(text.split()[3 : 3 + n]) + " and another end", [(1, text)])) == hit


def test_a_word_is_looked_at_once(monkeypatch):
    """Slices share what is known of words; a vocabulary that is full is begun anew, with the same templates."""
    texts = [f"Anna paid 3 kg of Éclairs, {k} in ALL. She met Bob Lee!\n4 ΣΑΣ days on" for k in range(40)]
    digest, looked = d.xxhash.xxh64_intdigest, []
    monkeypatch.setattr(d.xxhash, "xxh64_intdigest", lambda w: looked.append(w) or digest(w))
    monkeypatch.setattr(d, "_VOCABULARY", [d.Vocabulary()])
    first = [d.variants([t]) for t in texts]
    assert len(looked) == len({w for t in texts for w in d.TOKEN.findall(t)})  # and not once a slice
    monkeypatch.setattr(d, "VOCABULARY_CHARS", 30)
    for text, before in zip(texts, first):
        for t, u in zip(d.variants([text]), before):
            assert t.row(0) == u.row(0) and all((x == y).all() for x, y in zip(t.windows(8, 1), u.windows(8, 1)))
            assert len(d._VOCABULARY[0]) <= 60
    assert first[0][0].row(0)[0][-4:] == ["4", "σας", "days", "on"]
