"""Pooled readouts, names of files, and first steps against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from epochalis.functions.reservoirs import pooled_readout
from epochalis.operators.intervals import first_after
from epochalis.operators.selection import resolved


def test_pooled_readout(spark):
    rng = np.random.default_rng(8)
    parts = np.array(["trn"] * 60 + ["val"] * 20 + ["tst"] * 20)
    people = {}
    for k in range(3):
        x = rng.normal(k, 1 + k, (100, 3))
        x[:, 2] = 4.0
        people[k] = x, (x[:, 0] - k) / (1 + k) + rng.normal(0, 0.3, 100)
    rows = [(k, str(parts[i]), *map(float, x[i]), float(y[i])) for k, (x, y) in people.items() for i in range(100)]
    got, alpha = pooled_readout(spark.createDataFrame(rows, "p int, part string, a double, b double, c double, y double"), "p", ["a", "b", "c"], "y")
    scaled = {}
    for k, (x, y) in people.items():
        t = x[parts == "trn"]
        s = t.std(0, ddof=1)
        z = np.where(s > 1e-6, (x - t.mean(0)) / np.where(s > 1e-6, s, 1), 0)
        scaled[k] = np.column_stack((z, np.ones(100))), y
    pick = lambda p: (np.concatenate([z[parts == p] for z, _ in scaled.values()]), np.concatenate([y[parts == p] for _, y in scaled.values()]))
    (x, y), (u, v) = pick("trn"), pick("val")
    best = min((float(((u @ w - v) ** 2).sum()), a, w) for a, w in [(a, np.linalg.solve(x.T @ x + a * np.eye(4), x.T @ y)) for a in (0.1, 1.0, 10.0, 100.0, 1000.0)])
    assert alpha == best[1]
    want = {k: 1 - ((z[parts == "tst"] @ best[2] - y[parts == "tst"]) ** 2).sum() / (y[parts == "tst"] ** 2).sum() for k, (z, y) in scaled.items()}
    assert {r["p"]: round(r["skill"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_first_after(spark):
    rng = random.Random(3)
    steps = [(rng.randrange(4), float(rng.randrange(0, 400)), i) for i in range(60)]
    onsets = [(rng.randrange(5), float(rng.randrange(-20, 450)), i) for i in range(40)]
    got = first_after(spark.createDataFrame(onsets, "k int, s double, onset_id int"), spark.createDataFrame(steps, "k int, t double, step int"), "k", 10.0, 30.0)
    for r in got.collect():
        later = [(t, i) for k, t, i in steps if k == r["k"] and t + 10 > r["s"]]
        assert (r["t"], r["step"]) == (min(later) if later else (None, None))
    assert got.count() == 40


def test_resolved(spark):
    files = [("PN01", "PN01-1.edf"), ("PN06", "PN06-1.edf"), ("PN06", "PN06-2.edf"), ("PN11", "PN11-.edf"), ("PN11", "PN12-1.edf"), ("PN11", "PN12-2.edf")]
    names = {("PN01", "PN01.edf"): "PN01-1.edf", ("PN01", "other.edf"): "PN01-1.edf", ("PN06", "PNO6-2.edf"): "PN06-2.edf", ("PN06", "PN06.edf"): None, ("PN11", "PN11.edf"): "PN11-.edf", ("PN11", "PN12-.edf"): None, ("PN99", "PN99.edf"): None}
    got = resolved(spark.createDataFrame(list(names), "c string, name string"), spark.createDataFrame(files, "c string, file string"), "c")
    assert {(r["c"], r["name"]): r["file"] for r in got.collect()} == names
    assert got.where(F.col("file").isNull()).count() == 3
