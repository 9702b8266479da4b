"""Scores of many rules against one overlap-add a rule, sample by sample."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from epochalis.operators import atoms as A
from epochalis.operators import denoise as D

AXES = {"f_high": [20.0, 30.0], "k_high": [1.0, 2.0], "f_low": [1.0, 2.0], "k_low": [1.0, 3.0], "dt_short": [0.05, 0.1], "k_short": [1.0, 2.0]}
WIDTH, HOP = 16, 8


def flagged(f, dur, amp, sigma, r):
    return (min(abs(f - 60), abs(f - 50)) < 3 and dur >= 0.1) or (f - 1 / (2 * math.pi * max(dur, 1e-6)) >= r["f_high"] and amp >= r["k_high"] * sigma) or (f <= r["f_low"] and amp >= r["k_low"] * sigma) or (dur <= r["dt_short"] and amp >= r["k_short"] * sigma)


def test_every_rule_equals_its_own_overlap_add(spark):
    rng = np.random.default_rng(0)
    found, art, sigma = [], [], {"r1": 0.8, "r2": 1.5}
    for rec in sigma:
        for frame in range(9):
            for _ in range(4):
                found.append((rec, frame, float(rng.choice([0.5, 1.5, 10, 25, 35, 50])), float(rng.choice([0.04, 0.08, 0.2, 0.5])), (rng.normal(size=WIDTH) * rng.choice([0.3, 1.0, 2.0])).tolist()))
        art += [(rec, i, float(v)) for i, v in enumerate(rng.normal(size=80))]
    art += [("still", i, 0.0) for i in range(10)]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WIDTH) / WIDTH)
    atoms = spark.createDataFrame(found, "rec_id string, frame bigint, f_hz double, dur_s double, wave array<double>").repartition(5)
    waves = D.set_waves(atoms, spark.createDataFrame(list(sigma.items()), "rec_id string, sigma double"), AXES, WIDTH, HOP)
    scores = D.rule_scores(waves, spark.createDataFrame(art, "rec_id string, sample_idx int, value double"), AXES)
    rows = {(r["rec_id"], *(r[n] for n in AXES)): r for r in scores.collect()}
    assert len(rows) == 3 * 64
    gains: dict = {}
    for values in itertools.product(*AXES.values()):
        rule = dict(zip(AXES, values))
        for rec in sigma:
            a = np.array([v for r, _, v in art if r == rec])
            est = np.zeros(80)
            for r, frame, f, dur, wave in found:
                if r == rec and flagged(f, dur, max(map(abs, wave)), sigma[rec], rule):
                    est[frame * HOP : frame * HOP + WIDTH] += np.array(wave) * hann
            got = rows[rec, *values]
            assert math.isclose(got["before"], (a**2).sum(), rel_tol=1e-9) and math.isclose(got["left"], ((a - est) ** 2).sum(), rel_tol=1e-9)
            assert math.isclose(got["gain_db"], 10 * math.log10((a**2).sum() / ((a - est) ** 2).sum()), abs_tol=1e-9)
            gains.setdefault(values, []).append(got["gain_db"])
        assert rows["still", *values]["gain_db"] is None
    best = [r for r in D.best_rule(scores, AXES).collect() if r["best"]]
    top = max(round(float(np.median(v)), 9) for v in gains.values())
    assert len(best) == 1 and best[0]["gain_db"] == top and tuple(best[0][n] for n in AXES) == min(k for k, v in gains.items() if round(float(np.median(v)), 9) == top)


def test_bits_say_what_rules_say(spark):
    parts, grid = A.rule_grid(AXES)
    assert len(parts) == 12 and len(grid) == 64 and all(bin(mask).count("1") == 3 for mask, _ in grid)
    rng = np.random.default_rng(1)
    rows = [(float(rng.choice([0.5, 1.0, 2.0, 21.0, 49.0, 70.0])), float(rng.choice([0.01, 0.05, 0.1, 1.0])), float(rng.uniform(0, 4))) for _ in range(200)]
    met = spark.createDataFrame(rows, "f double, dur double, amp double").select("f", "dur", "amp", A.parts_met(F.col("f"), F.col("dur"), F.col("amp"), F.lit(1.0), parts).alias("met")).collect()
    for r in met:
        assert all(bool(r["met"] & mask) == flagged(r["f"], r["dur"], r["amp"], 1.0, rule) for mask, rule in grid)


def test_long_recordings_keep_only_energies(spark):
    # more samples than a stretch; what is left comes from written energies, not from pairs of sets at each sample
    n = D.STRETCH + 5000
    art = spark.range(n).selectExpr("'r' as rec_id", "id as sample_idx", "cast(id % 7 as double) as value")
    waves = spark.range(n).selectExpr("'r' as rec_id", "id as sample_idx", "4095 as met", "cast(id % 7 as double) / 2 as value")
    scores = D.rule_scores(waves, art, AXES)
    assert "energies" in scores.inputFiles()[0]
    rows, whole = scores.collect(), sum((i % 7) ** 2 for i in range(n))
    assert len(rows) == 64 and all(math.isclose(r["before"], whole) and math.isclose(r["left"], whole / 4) for r in rows)
