"""Studies that are stopped and go on: what is written once isn't made again."""

import numpy as np

from epochalis.plans import studies


def test_feature_sets_are_compared_and_a_second_run_adds_nothing(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(360):
        y = int(rng.random() < 0.5)
        rows.append((i, f"s{i % 18:02d}", y, float(y + rng.normal() * 0.3), float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(rows, "i int, s string, y int, good double, poor double, noise double")
    root = str(tmp_path / "study")
    sets = {"cross": (df, ["good", "noise"]), "plain": (df, ["poor", "noise"])}
    run = lambda: studies.compare_sets(spark, sets, "y", "s", "i", [{"alpha": a, "k": k} for a in (0.01, 1.0) for k in (1, 2)], root, ["cross"], ["plain"], outer=3).first()
    first = run()
    assert first["verdict"] == "win" and first["n"] == 18 and first["p"] < 0.01
    files = sorted(str(p) for p in (tmp_path / "study" / "predictions").rglob("*.parquet"))
    assert run() == first and sorted(str(p) for p in (tmp_path / "study" / "predictions").rglob("*.parquet")) == files
    told = spark.read.parquet(f"{root}/predictions")
    assert told.count() == 720 and {r["set"] for r in told.select("set").distinct().collect()} == {"cross", "plain"}
    results = {r["set"]: r for r in spark.read.json(f"{root}/results").collect()}
    assert set(results) == {"cross", "plain"} and results["cross"]["auc"] > 0.95 and len(results["cross"]["folds"]) == 3
    report = [r["value"] for r in spark.read.text(f"{root}/report").collect()]
    assert len(report) == 2 and report[0].startswith("cross ") and "+-" in report[0]


def test_atoms_of_new_recordings_alone_are_made(spark, tmp_path):
    rng = np.random.default_rng(1)
    make = lambda recs: spark.createDataFrame([(r, e, 0, rng.normal(size=32).tolist()) for r in recs for e in range(2)], "rec_id string, epoch_id bigint, ch_idx int, w array<double>")
    path = str(tmp_path / "atoms")
    assert studies.save_atoms(make(["a", "b"]), path, 32, 32.0, 2) == 2
    before = {r["rec_id"]: r["energy"] for r in spark.read.parquet(path).where("epoch_id = 0 and atom_idx = 0").collect()}
    assert studies.save_atoms(make(["a", "b", "c"]), path, 32, 32.0, 2) == 1
    after = {r["rec_id"]: r["energy"] for r in spark.read.parquet(path).where("epoch_id = 0 and atom_idx = 0").collect()}
    assert set(after) == {"a", "b", "c"} and all(after[k] == v for k, v in before.items())
