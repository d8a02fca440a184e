"""Problem 9 against an edit-distance search without any filter."""

import random

import pytest

from tidemark.llm import leakage
from tidemark.llm.leakage import EDIT_IN, MIN_WORDS, Items, leaked_items, items_in, leaks_in, remove_leaks
from tidemark.sources import load

WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]
NOISE = [f"noise{i}" for i in range(50)]


def brute(item: list[str], text: list[str]) -> bool:
    for a in range(len(item) - MIN_WORDS + 1):
        far = 10**6
        cost = [far] + [0 if w == item[a] else far for w in text]
        for i in range(a + 1, len(item)):
            ends = [cost[j] for j, w in enumerate(text) if w == item[i]]
            if i - a + 1 >= MIN_WORDS and ends and min(ends) * EDIT_IN <= i - a + 1:
                return True
            new = [cost[0] + 1]
            for j, w in enumerate(text, 1):
                new.append(min(cost[j] + 1, new[-1] + 1, cost[j - 1] + (w != item[i])))
            cost = new
    return False


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        if x < 2 * share / 3:
            out.append(rng.choice(NOISE))
        else:
            out.append(w)
            if x < share:
                out.append(rng.choice(NOISE))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_random_edits(seed):
    rng = random.Random(seed)
    item = rng.sample(WORDS, 60)
    n = rng.randint(15, 60)
    at = rng.randint(0, 60 - n)
    inside = edited(rng, item[at : at + n], rng.choice([0, 0.08, 0.16, 0.2, 0.3]))
    text = [rng.choice(NOISE) for _ in range(30)] + inside + [rng.choice(NOISE) for _ in range(30)]
    got = leaks_in(Items([(1, " ".join(item))]), " ".join(text))
    assert bool(got) == brute(item, text) == bool(items_in(Items([(1, " ".join(item))]), " ".join(text)))


PASSAGE = "The quick brown fox jumps over one lazy dog while seven silent owls watch from a twisted oak and count every falling leaf before the cold dawn breaks over distant hills"


@pytest.mark.parametrize(
    "text, leaks",
    [
        (PASSAGE, True), (PASSAGE.upper(), True), ("> " + PASSAGE.replace(" ", "\n> "), True), (PASSAGE.replace(" ", "\xa0\t"), True),
        (PASSAGE.replace("o", "ö").replace("e", "é"), True), (PASSAGE.replace("silent", "sil�nt").replace("brown", "br�wn"), True),
        (PASSAGE.replace(" ", "�"), True), (PASSAGE.replace(" ", "Â\xa0"), True), (PASSAGE.replace(" ", ", "), True),
        (" ".join(PASSAGE.split()[:24]), False), (" ".join(sorted(PASSAGE.split())), False), ("", False), (None, False),
        ("x " * 50_000 + PASSAGE + " y" * 50_000, True),
    ],
)
def test_dress(text, leaks):
    assert bool(leaks_in(Items([(1, PASSAGE), (2, "too short to leak"), (3, None)]), text)) == leaks


def test_tables(spark, data):
    docs, items = load(spark, data, "documents"), load(spark, data, "eval_items")
    found = leaked_items(docs, items)
    rows = {tuple(r) for r in found.collect()}
    assert len(rows) == found.count() > 10
    cleaned = remove_leaks(docs, items)
    assert {r.doc_id for r in cleaned.collect()} == {d for d, _ in rows}
    assert leaked_items(cleaned, items).count() == 0
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("between", [" ", " and some words that are foreign to it ", " it " * 40])
@pytest.mark.parametrize("times", [2, 3, 60])
def test_repeated_passage_is_cut_each_time(spark, between, times):
    text = "Before. " + between.join([PASSAGE] * times) + " After."
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    left = remove_leaks(spark.createDataFrame([(7, text)], "doc_id long, text string"), items).first().text
    assert "quick" not in left and left.startswith("Before.") and left.endswith("After.")


def test_damaged_words_cost_nothing():
    words = PASSAGE.lower().split()
    hurt = [w if k % 4 else w[0] + "\ufffd" + w[2:] for k, w in enumerate(words)]  # every fourth word, short ones too
    assert leaks_in(Items([(1, PASSAGE)]), " ".join(hurt))
    junk = " ".join(w + ".Â" if k % 3 else w for k, w in enumerate(words)) + " a"
    assert leaks_in(Items([(1, PASSAGE + " a")]), junk)


def test_items_in_parts(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(6)], "item_id long, text string")
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in enumerate(texts)] + [(9, " and ".join(texts)), (10, "clean"), (11, None)], "doc_id long, text string")
    whole = {tuple(r) for r in leaked_items(docs, items).collect()}
    left = {tuple(r) for r in remove_leaks(docs, items).collect()}
    monkeypatch.setattr(leakage, "MAX_ITEM_BYTES", 300)
    assert len(leakage._item_parts(items)) > 1
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == whole == {(i, i) for i in range(6)} | {(9, i) for i in range(6)}
    assert {tuple(r) for r in remove_leaks(docs, items).collect()} == left and len(left) == 7
