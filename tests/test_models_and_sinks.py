"""Models by groups, sinks, and feature rows from signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochalis.functions import models as M
from epochalis.functions.pursuit import Engine, atoms_of, chirplets
from epochalis.operators.atoms import feature_rows
from epochalis.sources import sinks


def table(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    rows = [(int(i), f"g{i % 7}", int(v), float(v + rng.normal(0, 0.3)), float(rng.normal()), 4.0) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "id long, g string, y int, a double, b double, c double")


@pytest.mark.parametrize("by", ["selectk", "pca", "none"])
def test_out_of_fold(spark, by):
    out = M.out_of_fold(table(spark), ["a", "b", "c"], "y", "g", 3, reduce_by=by, n=9 if by == "none" else 2)
    assert out.count() == 300 and out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.where("y = predicted").count() > 270
    with pytest.raises(ValueError):
        M.out_of_fold(table(spark).where("g = 'g1'"), ["a"], "y", "g")


def test_sinks(spark, tmp_path):
    t = table(spark)
    path = str(tmp_path / "parts")
    assert sinks.save_missing(t.where("g < 'g3'"), path, "g") == 3
    assert sinks.save_missing(t, path, "g") == 4 and sinks.save_missing(t, path, "g") == 0
    assert spark.read.parquet(path).count() == 300
    tagged = str(tmp_path / "tagged")
    for tag in ("one", "two", "one"):
        sinks.save_tagged(t.limit(10), tagged, tag)
    assert sorted(r["n"] for r in spark.read.parquet(tagged).groupBy("tag").agg(F.count("*").alias("n")).collect()) == [10, 10]
    results = str(tmp_path / "results")
    for _ in range(2):
        sinks.append_results(t.limit(1), results)
    assert spark.read.json(results).count() == 2
    line = spark.range(1).select(sinks.result_line(F.lit("logreg"), F.lit(0.5), F.lit(None).cast("double"), F.lit(0.75)).alias("x")).first()[0]
    assert line.startswith("logreg ") and line.endswith("   0.750") and "-" in line


def test_feature_rows_of_planted_signals(spark):
    n, fs = 256, 128.0
    rows = []
    for epoch, f in enumerate((6.0, 10.0, 20.0)):
        for ch in range(3):
            wave, _ = chirplets(np.array([1.0, f, 0.3, 0.0]), n, fs)
            rows.append((epoch, ch, wave.tolist()))
    signals = spark.createDataFrame(rows, "epoch_id long, ch_idx int, w array<double>")
    out = {(r["epoch_id"], r["ch_idx"]): r for r in feature_rows(atoms_of(signals, n, fs, 4), 2.0).collect()}
    assert len(out) == 9
    for epoch, band in enumerate(("frac_theta", "frac_alpha", "frac_beta")):
        assert out[epoch, 0][band] > 0.8 and out[epoch, 0]["recon_err"] < 0.2


def test_planes_are_orthogonal_projections():
    x = np.random.default_rng(3).standard_normal((5, 64))
    p, waves, kept, rest = Engine(64, 64.0, order=4).decompose(x)
    assert np.allclose(waves.sum(1) + rest, x, atol=1e-5)
    for k in range(4):
        for part in chirplets(p[:, k], 64, 64.0):
            assert np.abs((rest * part).sum(1)).max() < 1e-6
