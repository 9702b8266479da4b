"""Folds, rank tests and the nested search against enumeration and plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochalis.operators import statistics as S
from epochalis.operators import validation as V


def spread(counts, fold, folds):
    share = counts / counts.sum(0)
    return sum(((share[fold == f].sum(0)) ** 2).sum() for f in range(folds))


def test_folds_are_as_balanced_as_can_be():
    rng = np.random.default_rng(0)
    for n, folds in ((5, 2), (6, 3), (7, 3)):
        for _ in range(10):
            counts = rng.integers(0, 30, (n, 2)).astype(float) + 1
            least = min(spread(counts, np.array(w), folds) for w in itertools.product(range(folds), repeat=n))
            assert spread(counts, V.balanced(counts, folds), folds) <= least + 1e-9
    # beyond that, close to the bound of equal folds, and never worse than dealing by size
    for _ in range(5):
        counts = rng.integers(0, 50, (60, 3)).astype(float) + 1
        got = spread(counts, V.balanced(counts, 5), 5)
        turns = np.empty(60, int)
        turns[np.argsort(-counts.sum(1))] = np.arange(60) % 5
        assert 3 / 5 <= got <= min(spread(counts, turns, 5), 3 / 5 + 1e-3)


def test_no_group_is_split(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", int(rng.random() < 0.2 + 0.02 * g)) for g in range(30) for _ in range(rng.integers(5, 60))] + [(None, 1), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, y int")
    for block in (2048, 8):
        out = V.stratified_folds(df, "g", "y", 4, block).collect()
        assert len(out) == 30 and {r["fold"] for r in out} == set(range(4)) and sum(r["n"] for r in out) == len(rows) - 2
        fold = {r["g"]: r["fold"] for r in out}
        for y in (0, 1):
            sizes = [sum(1 for g, v in rows if v == y and fold.get(g) == f) for f in range(4)]
            assert max(sizes) - min(sizes) <= (0.1 if block == 2048 else 0.6) * max(sizes)
    few = V.stratified_folds(df.where("g in ('g1', 'g2', 'g3')"), "g", "y", 9).collect()
    assert {r["fold"] for r in few} == {0, 1, 2}
    rare = spark.createDataFrame([(i, int(i < 3)) for i in range(40)], "i int, y int")
    got = V.stratified_rows(rare, "i", "y", 5).collect()
    assert {r["fold"] for r in got} == {0, 1, 2} and sorted(r["fold"] for r in got if r["y"] == 1) == [0, 1, 2]


def enumerated(d):
    """Two-sided p by all signs."""
    d = [x for x in d if x]
    sizes = sorted(abs(x) for x in d)
    rank = {a: np.mean([i + 1 for i, b in enumerate(sizes) if b == a]) for a in sizes}
    low = min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    sums = [sum(rank[abs(x)] for x, s in zip(d, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * sum(s <= low + 1e-9 for s in sums) / len(sums))


def test_p_values_equal_enumeration(spark):
    rng = np.random.default_rng(2)
    for d in ([3.0, 1.0, -2.0, 5.0, 4.0, 6.0], [1.0, 1.0, -1.0, 2.0, 0.0, 2.0, -3.0], [0.5], list(rng.integers(-4, 9, 12).astype(float)), list(rng.normal(0.5, 1, 11))):
        df = spark.createDataFrame([(float(x),) for x in d] + [(None,), (float("nan"),)], "d double")
        row = S.signed_rank_test(df, F.col("d")).first()
        assert math.isclose(row["p"], enumerated(d), rel_tol=1e-9) and row["n"] == sum(x != 0 for x in d)
    none = S.signed_rank_test(df.limit(0), F.col("d")).first()
    assert tuple(none) == (0, 0.0, 0.0, 1.0)
    # the normal law meets the exact one where both can be had
    df = spark.createDataFrame([(float(x),) for x in rng.normal(0.25, 1, 58)], "d double")
    exact, normal = (S.signed_rank_test(df, F.col("d"), k).first()["p"] for k in (60, 10))
    assert abs(exact - normal) < 0.01
    z = [0.0, 0.3, 1.0, 2.5, 2.999, 3.0, 4.0, 8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(S.upper_tail(F.col("z"))).collect()
    assert np.allclose([r[0] for r in got], [0.5 * math.erfc(x / math.sqrt(2)) for x in z], rtol=1e-9)


def test_ranks_of_scores_of_any_scale(spark):
    rng = np.random.default_rng(3)
    for scale in (1e-9, 1.0, 1e9):
        y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1) * scale
        df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").repartition(5)
        want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
        assert math.isclose(S.roc_auc(df, "y", "s").first()["auc"], want, rel_tol=1e-9)
        assert S.roc_auc(df.limit(0), "y", "s").first()["auc"] is None


def plain_fit(x, y, alpha, k):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    t = 2.0 * y - 1
    order = np.argsort(-np.round(((z * (t - t.mean())[:, None]).mean(0)) ** 2, 12), kind="stable")[:k]
    w = np.linalg.solve(z[:, order].T @ z[:, order] / len(z) + alpha * np.eye(k), z[:, order].T @ (t - t.mean()) / len(z))
    return lambda q: ((q - mean) / sd)[:, order] @ w + t.mean()


def test_nested_search_equals_loops(spark):
    rng = np.random.default_rng(4)
    groups = np.repeat(np.arange(12), 25)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 3] + [0, 5, 0, 100]
    y = ((x[:, 0] + 0.3 * (x[:, 1] - 5) + rng.normal(size=300)) > 0).astype(int)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(int(i), f"s{g}", int(v), *map(float, r)) for i, (g, v, r) in enumerate(zip(groups, y, x))], "i int, s string, y int, a double, b double, c double, d double").repartition(5)
    configs = [{"alpha": a, "k": k} for a in (1e-3, 0.1, 10.0) for k in (1, 2, 4)]
    out, done = V.nested_search(df, names, "y", "s", configs, outer=3, inner=3)
    rows = {r["i"]: r for r in out.collect()}
    assert len(rows) == 300
    fold = {r["s"]: r["fold"] for r in rows.values()}
    assert all(r["fold"] == fold[r["s"]] for r in rows.values())
    told = {r["fold"]: r for r in done.collect()}
    f = np.array([fold[f"s{g}"] for g in groups])
    for o in range(3):
        train = f != o
        parts = {r["s"]: r["fold"] for r in V.stratified_folds(df.where(F.col("s").isin(*[s for s in fold if fold[s] != o])), "s", "y", 3).collect()}
        inner = np.array([parts.get(f"s{g}", -1) for g in groups])
        scores = [np.mean([((plain_fit(x[train & (inner != i)], y[train & (inner != i)], **c)(x[inner == i]) > 0) == y[inner == i]).mean() for i in range(3)]) for c in configs]
        assert told[o]["config"] == int(np.argmax(np.round(scores, 12))) and math.isclose(told[o]["inner_accuracy"], max(scores))
        guess = plain_fit(x[train], y[train], **configs[told[o]["config"]])(x[f == o])
        assert np.allclose([rows[i]["score"] for i in np.flatnonzero(f == o)], guess, atol=1e-8)
        assert math.isclose(told[o]["outer_accuracy"], ((guess > 0) == y[f == o]).mean())
    with pytest.raises(ValueError):
        V.nested_search(df.where("s = 's1'"), names, "y", "s", configs)


def test_decisions(spark):
    rng = np.random.default_rng(5)
    base = rng.random(20)
    rows = [(m, i, float(b + up)) for m, up in (("a", 0.3), ("b", -0.1), ("x", 0.0), ("y", -0.2)) for i, b in enumerate(base)]
    scores = spark.createDataFrame(rows, "model string, s int, score double")
    won = V.decided(scores, "s", ["a", "b"], ["x", "y"]).first()
    assert (won["ours"], won["theirs"], won["n"], won["verdict"]) == ("a", "x", 20, "win") and math.isclose(won["p"], 2 / 2**20) and math.isclose(won["lead"], 0.3)
    assert V.decided(scores, "s", ["b"], ["x"]).first()["verdict"] == "behind"
    few = scores.where("s < 4")
    assert V.decided(few, "s", ["a"], ["x"]).first()["verdict"] == "ahead"


def test_exact_percentiles(spark):
    rng = np.random.default_rng(6)
    groups = {"even": rng.normal(size=2000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]), "tiny": rng.normal(size=7) * 1e-12, "wide": np.exp(rng.normal(size=900) * 20)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("none", None)], "g string, v double").repartition(5)
    shares = [0.0, 0.01, 0.5, 0.75, 0.99, 1.0]
    for parts in (256, 4):
        got = {r["g"]: [r[f"p{k}"] for k in range(6)] for r in S.exact_percentiles(df, "g", "v", shares, parts).collect()}
        assert got.keys() == groups.keys()
        for g, x in groups.items():
            assert np.allclose(got[g], np.quantile(x, shares), rtol=1e-12, atol=0)
    assert S.exact_percentiles(df.limit(0), "g", "v", shares).count() == 0
