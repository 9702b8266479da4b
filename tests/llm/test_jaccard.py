"""Pipeline's near-duplicate stage against brute force over all pairs."""

import numpy as np
import pytest

from corpus_pipeline import near_duplicates as stage
from epochalis.llm import jaccard


def similar(a, b, words=5):
    def cut(t):
        p = t.lower().split()
        return {tuple(p[i : i + words]) for i in range(max(1, len(p) - words + 1))}

    x, y = cut(a or ""), cut(b or "")
    return 5 * len(x & y) >= 4 * len(x | y)


@pytest.mark.parametrize("cap", [jaccard.CAP, 3])
def test_near_duplicates_from_08(spark, monkeypatch, cap):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(jaccard.open_pairs, "__defaults__", (cap,))
    texts = ["", None, "two words", "Two  words", "three other words"]
    for n in (9, 40, 160):
        for _ in range(6):
            base = [f"w{k}" for k in rng.integers(0, 5000, n)]
            texts.append(" ".join(base))
            for changes in (1, 2, 3, 4):
                copy = list(base)
                for at in rng.choice(n, changes, replace=False):
                    copy[at] = "changed"
                texts.append(" ".join(copy))
    line = " ".join(f"common{i}" for i in range(12))
    texts += [f"{line} {' '.join(f'own{i}x{k}' for k in range(i))}" for i in range(12)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and similar(texts[i], texts[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(label))
    kept = {r.doc_id for r in stage(spark, docs, None).collect()}
    assert kept == set(label)


def test_a_quoted_passage_makes_few_pairs(spark, monkeypatch):
    # each text quotes one of the passages and is else its own; the passages' shingles are too rare to come last
    made = []
    real = jaccard.open_pairs
    monkeypatch.setattr(jaccard, "open_pairs", lambda *a, **k: made.append(real(*a, **k).count()) or real(*a, **k))
    monkeypatch.setattr(jaccard, "OFTEN", 1 << 30)
    line = [[f"p{k}x{i}" for i in range(60)] for k in range(2)]
    docs = [(d, " ".join([f"d{d}x{i}" for i in range(200)] + line[d % 2] + [f"e{d}x{i}" for i in range(40)])) for d in range(40)]
    docs += [(d + 100, t.replace(f"d{d}x7 ", "changed ")) for d, t in docs[:5]]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d % 100 for d, _ in docs}
    assert made[0] <= 45


def test_shared_halves_make_few_pairs(spark, monkeypatch):
    # each text is half a passage and half its own: longer prefixes share enough to leave none out, and no sample shows the passages
    made = []
    real = jaccard.open_pairs
    monkeypatch.setattr(jaccard, "open_pairs", lambda *a, **k: made.append(real(*a, **k).count()) or real(*a, **k))
    monkeypatch.setattr(jaccard, "OFTEN", 1 << 30)
    half = [[f"p{k}x{i}" for i in range(100)] for k in range(2)]
    docs = [(d, " ".join([f"d{d}x{i}" for i in range(100)] + half[d % 2])) for d in range(40)]
    docs += [(d + 100, t.replace(f"d{d}x7 ", "changed ")) for d, t in docs[:5]]
    # one id twice, with one set and with two
    docs += [docs[0], (0, docs[0][1].replace(" ", "  ")), (1, "other words " * 3 + docs[7][1])]
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(d, 1 if d == 7 else d % 100) for d, _ in docs}
    assert made[0] <= 10


def test_a_pair_is_made_where_it_meets_first(spark, monkeypatch):
    # two sets of ten shingles that share five in a row, and one more behind shingles that others share with them
    shared = [1, 2, 3, 4, 5, 9]
    rows = [(d, (10 << 32) + i, t, p) for d, own in ((7, 6), (8, 6)) for i, (t, p) in enumerate(zip(shared, [0, 1, 2, 3, 4, own + d]))]
    groups = spark.createDataFrame([(*r, 2) for r in rows], "rep long, place long, token long, prev long, size long")
    comp = spark.createDataFrame([], "id long, component long")
    monkeypatch.setattr(type(groups), "distinct", lambda some: some)
    assert [tuple(r) for r in jaccard.open_pairs(groups, comp, 1, 5).collect()] == [(7, 8)] * 2
