"""Leaks against brute force, by the sent and by the shuffled way."""

import random

import numpy as np
import pytest

from verdigrade.llm import leaks as lk

RNG = random.Random(7)
VOCAB = [f"w{i}" for i in range(60)]


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def brute(docs, items, run=12):
    out = set()
    for d, t in docs:
        w = lk.words(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, x in items:
            v = lk.words(x)
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def data():
    items = [(i, text(40)) for i in range(8)] + [(8, text(11)), (9, None), (10, "")]
    items.append((11, items[0][1]))  # the same passage twice
    docs = []
    for d in range(60):
        src = items[d % 8][1].split()
        n, at = RNG.choice((5, 11, 12, 13, 25)), RNG.randrange(10)
        part = [f"**{w.upper()}**," if RNG.random() < 0.3 else w for w in src[at : at + n]]
        docs.append((d, f"{text(RNG.randrange(30))} “{'  '.join(part)}” {text(RNG.randrange(30))}"))
    docs += [(100, None), (101, ""), (102, " ".join([items[1][1]] * 300)), (None, items[2][1]), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_brute_force(spark, data, sent, monkeypatch):
    monkeypatch.setattr(lk, "SENT_BYTES", sent)
    docs, items = data
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, item_text string, text string")
    got = lk.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.exact} == {x for x in brute(docs, [x for x in items if x[1]]) if x[0] is not None}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_hot_seed_and_item(spark, sent, monkeypatch):
    """A third of all documents holds one passage, and many items share a sentence."""
    monkeypatch.setattr(lk, "SENT_BYTES", sent)
    shared = " ".join(f"c{i}" for i in range(14))
    items = [(i, f"{text(10)} i{i} {shared} {text(10)} j{i}") for i in range(40)]
    docs = [(d, f"{text(20)} {shared} {text(20)}" if d % 3 == 0 else text(50)) for d in range(300)] + [(1000 + d, items[0][1]) for d in range(150)]
    got = {(r.doc_id, r.item_id) for r in lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect() if r.exact}
    assert got == brute(docs, items) and len(got) >= 100 * 40


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_recall_of_edited_copies(spark, sent, monkeypatch):
    """Of passages of 60 words with so many of them replaced, dropped or added at random, the share that comes out."""
    monkeypatch.setattr(lk, "SENT_BYTES", sent)
    draw = random.Random(4)
    items = [(i, " ".join(f"v{draw.randrange(5000)}" for _ in range(60))) for i in range(100)]
    docs = []
    for k, share in enumerate((0.05, 0.1, 0.2, 0.3)):
        for i, t in items:
            w = t.split()
            for _ in range(round(len(w) * share)):
                at, kind = draw.randrange(len(w)), draw.randrange(3)
                w[at : at + 1] = [[f"n{draw.randrange(9999)}"], [], [w[at], f"n{draw.randrange(9999)}"]][kind]
            docs.append((k * 1000 + i, f"{text(15)} {' '.join(w)} {text(15)}"))
    got = {(r.doc_id // 1000, r.doc_id % 1000) for r in lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect() if r.doc_id % 1000 == r.item_id}
    recall = [sum((k, i) in got for i, _ in items) / 100 for k in range(4)]
    print("recall of edited copies", recall)
    assert recall[0] == 1 and recall[1] >= 0.97 and recall[2] >= 0.6


def test_edited_copy(spark):
    item = [f"q{i}" for i in range(40)]
    doc = [("z" if i % 8 == 7 else w) for i, w in enumerate(item)]
    d, i = spark.createDataFrame([(1, "x " + " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, item_text string")
    r = lk.leaks(d, i).collect()
    assert [(x.item_id, x.exact, x.longest_run) for x in r] == [(5, False, 7)]


def test_empty(spark):
    d, i = spark.createDataFrame([(1, text(30))], "doc_id long, text string"), spark.createDataFrame([(1, text(30))], "item_id long, item_text string")
    assert lk.leaks(d.limit(0), i).count() == 0 and lk.leaks(d, i.limit(0)).count() == 0


def test_every_run_holds_a_seed():
    for _ in range(200):
        counts = np.array([RNG.randrange(4) for _ in range(RNG.randrange(1, 40))])
        got, window = set(lk.rarest_in_windows(counts, 7).tolist()), 7
        assert all(got & set(range(s, s + window)) for s in range(max(1, len(counts) - window + 1)))


def test_alignment():
    a = np.arange(20)
    assert lk.smith_waterman(a, a) == (40, 20)
    assert lk.smith_waterman(a, np.concatenate([a[:10], [99], a[10:]])) == (39, 10)
    assert lk.smith_waterman(a, a + 100) == (0, 0) and lk.smith_waterman(a[:0], a) == (0, 0)
