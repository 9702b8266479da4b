"""Designs with many horizons, from sums alone, against loops over rows."""

import math

import numpy as np

from epochalis.operators import designs as D


def made(spark, seed=0, people=3, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(people):
        z = np.cumsum(rng.normal(size=(n, 2)), 0) * 0.3 + np.sin(np.arange(n) / 5)[:, None]
        for t in range(n):
            rows.append((f"p{p}", t, t // 20, z[t].tolist(), bool(rng.random() > 0.15)))
    return rows, spark.createDataFrame(rows, "person string, idx bigint, file bigint, z array<double>, valid boolean").repartition(5)


HOR, HISTORY = [1, 3], 4


def plainly(rows):
    """Design rows one by one: (person, idx) -> (file, x, y by horizon, mask)."""
    at = {(r[0], r[1]): r for r in rows}
    out = {}
    for p, t, f, z, valid in rows:
        ends = [at.get((p, t - HISTORY + 1)), *(at.get((p, t + h)) for h in HOR)]
        if valid and all(e is not None and e[2] == f for e in ends):
            out[p, t] = (f, z, [[a - b for a, b in zip(at[p, t + h][3], z)] for h in HOR], [at[p, t + h][4] for h in HOR])
    return out


def test_rows_equal_a_loop(spark):
    rows, frame = made(spark)
    want = plainly(rows)
    got = {(r["person"], r["idx"]): r for r in D.horizon_rows(frame, HOR, HISTORY).collect()}
    assert got.keys() == want.keys() and 0 < len(got) < len(rows)
    for k, (f, x, y, m) in want.items():
        assert got[k]["file"] == f and got[k]["x"] == x and np.allclose(got[k]["y"], y) and got[k]["m"] == m


def test_parts_never_look_across_the_middle(spark):
    _, frame = made(spark)
    rows = D.halves(D.horizon_rows(frame, HOR, HISTORY), HOR, HISTORY, val_share=0.4).collect()
    files = {part: {(r["person"], r["file"]) for r in rows if r["part"] == part} for part in ("trn", "val", "tst")}
    assert all(files.values()) and not files["trn"] & files["val"]
    for r in rows:
        assert r["idx"] + max(HOR) < 80 if r["part"] != "tst" else r["idx"] - HISTORY + 1 >= 80


def scores(x, y, m, w):
    """Squared error of predictions and of no change, row by row."""
    e = sum(((x[i] @ w[h] - y[i, h]) ** 2).sum() for i in range(len(x)) for h in range(len(HOR)) if m[i, h])
    return e, sum((y[i, h] ** 2).sum() for i in range(len(x)) for h in range(len(HOR)) if m[i, h])


def fits(sets, alphas):
    out = {}
    for a in alphas:
        out[a] = [np.linalg.solve(sum(x[m[:, h]].T @ x[m[:, h]] for x, _, m in sets) + a * np.eye(sets[0][0].shape[1]), sum(x[m[:, h]].T @ y[m[:, h], h] for x, y, m in sets)) for h in range(len(HOR))]
    return out


def test_skills_equal_loops(spark):
    _, frame = made(spark, seed=1)
    rows = D.halves(D.horizon_rows(frame, HOR, HISTORY), HOR, HISTORY, val_share=0.4)
    alphas = (0.1, 3.0, 100.0)
    got = {r["person"]: r for r in D.forecast_skills(rows, HOR, alphas).collect()}
    sets: dict = {}
    for p in {r["person"] for r in rows.select("person").distinct().collect()}:
        own = {part: [r for r in rows.where(f"person = '{p}' and part = '{part}'").orderBy("idx").collect()] for part in ("trn", "val", "tst")}
        raw = {part: (np.array([r["x"] for r in rs]), np.array([r["y"] for r in rs]), np.array([r["m"] for r in rs])) for part, rs in own.items()}
        # scaled by the training rows, a row once for each horizon that is valid
        trn = np.concatenate([raw["trn"][0][raw["trn"][2][:, h]] for h in range(len(HOR))])
        mean, sd = trn.mean(0), trn.std(0)
        sets[p] = {part: (np.column_stack((np.ones(len(x)), (x - mean) / sd)), y, m) for part, (x, y, m) in raw.items()}
    for p, s in sets.items():
        tried = fits([s["trn"]], alphas)
        alpha = min(alphas, key=lambda a: scores(*s["val"], tried[a])[0])
        assert got[p]["alpha"] == alpha
        for name, part in (("val_skill", "val"), ("skill", "tst")):
            e, c = scores(*s[part], tried[alpha])
            assert math.isclose(got[p][name], 1 - e / c, rel_tol=1e-6, abs_tol=1e-9)
        assert len(got[p]["skill_h"]) == 2
    tried = fits([s["trn"] for s in sets.values()], alphas)
    alpha = min(alphas, key=lambda a: sum(scores(*s["val"], tried[a])[0] for s in sets.values()))
    for p, s in sets.items():
        e, c = scores(*s["tst"], tried[alpha])
        assert got[p]["pooled_alpha"] == alpha and math.isclose(got[p]["pooled_skill"], 1 - e / c, rel_tol=1e-6, abs_tol=1e-9)


def test_people_without_parts(spark):
    row = ([1.0], [[1.0]], [True])
    frame = spark.createDataFrame([("a", "tst", *row), ("b", "trn", *row), ("b", "val", *row), ("c", "trn", [float("nan")], [[1.0]], [True]), ("c", "val", [1.0], [[0.0]], [False])], "person string, part string, x array<double>, y array<array<double>>, m array<boolean>")
    got = {r["person"]: r for r in D.forecast_skills(frame, [1], (1.0,)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["alpha"] is None and got["b"]["skill"] is None and got["c"]["skill"] is None
    assert D.forecast_skills(frame.limit(0), [1]).count() == 0
