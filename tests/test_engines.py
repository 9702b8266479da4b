"""Planted signals, plain loops and round trips for what SQL can't say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochalis.functions.pursuit import Engine, atoms_of, captured, chirplets, tangents
from epochalis.functions.reservoirs import EchoState, ridge, run_reservoir
from epochalis.operators import epochs as E
from epochalis.sources import recordings as R
from epochalis.streaming.epochs import count_windows


def test_pursuit_finds_planted_atoms():
    """Off the grid, in half a window's noise or none: within 0.1 Hz, with the sign of the sweep."""
    n, fs = 512, 256.0
    rng = np.random.default_rng(4)
    for f, rate, at, width in ((6.0, 0.0, 1.0, 0.25), (10.0, 0.0, 0.7, 0.2), (20.0, 0.0, 1.3, 0.1), (12.0, 12.0, 1.0, 0.25), (15.0, -12.0, 0.9, 0.3), (40.3, 5.0, 1.1, 0.4), (71.7, -30.0, 1.0, 0.15)):
        c, s = chirplets(np.array([[at, f, width, rate]]), n, fs)
        x = 0.6 * c - 0.8 * s
        p, _, kept, rest = Engine(n, fs, order=1).decompose(np.concatenate((x, x + 0.1 * rng.standard_normal((1, n)))))
        heard = p[:, 0, 1] + p[:, 0, 3] * (at - p[:, 0, 0])
        assert kept.all() and np.abs(heard - f).max() < 0.1 and np.abs(p[:, 0, 2] / width - 1).max() < 0.1
        assert np.linalg.norm(rest[0]) < 1e-3 * np.linalg.norm(x)
        assert rate == 0 or (np.sign(p[:, 0, 3]) == np.sign(rate)).all()


def test_an_atom_with_two_widths_needs_both():
    n, fs = 512, 256.0
    x = chirplets(np.array([[0.8, 17.3, 0.08, 4.0, 0.4]]), n, fs)[0]
    both = Engine(n, fs, order=1, asymmetric=True, rounds=40).decompose(x)
    assert np.allclose(both[0][0, 0], [0.8, 17.3, 0.08, 4.0, 0.4], atol=0.02) and np.linalg.norm(both[3]) < 1e-3 * np.linalg.norm(x)
    assert np.linalg.norm(Engine(n, fs, order=1).decompose(x)[3]) > 0.1 * np.linalg.norm(x)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6, 128))
    for size in (4, 5):
        p = np.column_stack((rng.uniform(0.3, 0.7, 6), rng.uniform(8, 40, 6), rng.uniform(0.08, 0.3, 6), rng.uniform(-20, 20, 6), rng.uniform(0.08, 0.3, 6)))[:, :size]
        _, slope, _ = tangents(x, p, 128, 128.0)
        for axis in range(size):
            h = np.zeros(size)
            h[axis] = 1e-6
            up, down = (p * np.exp(sign * h) if axis in (2, 4) else p + sign * h for sign in (1, -1))
            assert np.allclose(slope[:, axis], (captured(x, up, 128.0) - captured(x, down, 128.0)) / 2e-6, rtol=1e-4, atol=1e-4)


def test_pursuit_rows_are_independent_and_residual_falls(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 64))
    errors = [np.linalg.norm(Engine(64, 64.0, order=k).decompose(x)[3], axis=1) for k in (1, 3, 5)]
    assert (errors[0] >= errors[1] - 1e-9).all() and (errors[1] >= errors[2] - 1e-9).all()
    alone = Engine(64, 64.0, order=3).decompose(x[5:6])[0]
    assert np.allclose(alone[0], Engine(64, 64.0, order=3).decompose(x)[0][5])
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)] + [(99, 0, None), (98, 0, [1.0])], "epoch_id long, ch_idx int, w array<double>")
    one, eight = (atoms_of(df.repartition(k), 64, 64.0, 3).orderBy("epoch_id", "atom_idx").collect() for k in (1, 8))
    assert one == eight and {r["epoch_id"] for r in one} == set(range(12))


def test_reservoirs_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(r, i, [float(rng.random())]) for r in (1, 2, 3) for i in range(20)]
    df = spark.createDataFrame(rows, "rec_id long, sample_idx long, u array<double>").repartition(5)
    for make in (lambda: EchoState(1, 8),):
        got = {(r["rec_id"], r["sample_idx"]): r["state"] for r in run_reservoir(df, make).collect()}
        model = make()
        for rec in (1, 2, 3):
            s = model.start()
            for r, i, u in rows:
                if r == rec:
                    s = model.step(s, np.array(u))
                    assert np.allclose(got[r, i], model.read(s))


def test_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3))
    y = x @ [1.0, -2.0, 0.5]
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(6)
    assert np.allclose(ridge(df, "x", "y", 0.1), np.linalg.solve(x.T @ x + 0.1 * np.eye(3), x.T @ y))


def test_gate_order(spark):
    nan = float("nan")
    rows = [(1, [nan] * 4, 1800.0), (2, [800.0] * 4, 100.0), (3, [0.0, 800.0, 810.0, 805.0], 1800.0), (4, [800.0] * 4, 1800.0), (5, [800.0 + k % 3 for k in range(40)] + [1200.0] + [800.0 + k % 3 for k in range(60)], 1800.0), (6, [800.0, 820.0, 790.0, 815.0], 1800.0)]
    df = spark.createDataFrame(rows, "i int, w array<double>, span double").select("i", E.gate_reason("w", F.col("span")).alias("r"))
    assert [r["r"] for r in df.orderBy("i").collect()] == ["nonfinite", "packet_loss", "adc_rail", "near_constant", "artifact", None]


def edf_bytes(signals, annotation=True, records=2, rate=4):
    ns = len(signals) + annotation
    pad = lambda v, n: str(v).ljust(n).encode()
    head = pad("0", 168) + pad("10.20.30", 8) + pad("", 60) + pad(records, 8) + pad(1, 8) + pad(ns, 4)
    names = [f"EEG {i}" for i in range(len(signals))] + ["EDF Annotations"] * annotation
    per = [rate] * len(signals) + [2] * annotation
    for width, values in ((16, names), (80, [""] * ns), (8, ["uV"] * ns), (8, [-100] * ns), (8, [100] * ns), (8, [-1000] * ns), (8, [1000] * ns), (80, [""] * ns), (8, per), (32, [""] * ns)):
        head += b"".join(pad(v, width) for v in values)
    body = b""
    for k in range(records):
        for s in signals:
            body += np.array(s[k * rate : (k + 1) * rate], "<i2").tobytes()
        body += b"\0" * 4 * annotation
    return head + body


def test_edf(spark, tmp_path):
    a, b = list(range(8)), [10 * k for k in range(8)]
    (tmp_path / "one.edf").write_bytes(edf_bytes([a, b]) + b"\1\2\3")
    rows = R.read_edf(spark, str(tmp_path)).orderBy("channel").collect()
    assert [r["channel"] for r in rows] == ["EEG 0", "EEG 1"] and rows[0]["fs"] == 4.0
    assert np.allclose(rows[1]["values"], np.array(b) * 0.1)


def test_csv_and_annotations(spark, tmp_path):
    d = tmp_path / "rest"
    d.mkdir()
    (d / "x.csv").write_text("ms_ELAPSED,TP9_RAW,AF7_RAW,AF8_RAW,TP10_RAW\n0,1,2,3,4\n4,,2,3,4\n8,a,2,3,4\n12,5,6,7,8\n")
    rows = R.read_csv(spark, str(d)).collect()
    assert len(rows) == 8 and {r["label"] for r in rows} == {"rest"}
    (d / "turned.csv").write_text("AF8_RAW,TP10_RAW,ms_ELAPSED,AF7_RAW,TP9_RAW\n3,4,0,2,1\n")
    (d / "bad.csv").write_text("ms_ELAPSED,TP9_RAW\n0,1\n")
    turned = [r for r in R.read_csv(spark, str(d)).collect() if not r["path"].endswith(rows[0]["path"].rsplit("/", 1)[1])]
    assert {(r["channel"], r["value"]) for r in turned} == {("TP9", 1.0), ("AF7", 2.0), ("AF8", 3.0), ("TP10", 4.0)}
    lines = ["File Name: a.edf", "Seizure Start Time: 10 seconds", "Seizure End Time: 20 seconds", "File Name: b.edf", "File Name: c.edf", "Seizure 1 Start Time: 5 seconds", "Seizure 2 Start Time: 50 seconds", "Seizure 1 End Time: 8 seconds", "Seizure 2 End Time: 60 seconds"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string")
    got = sorted(((r["file"], r["start_s"], r["end_s"]) for r in R.seizure_spans(df).collect()), key=str)
    assert got == [("a.edf", 10, 20), ("b.edf", None, None), ("c.edf", 5, 8), ("c.edf", 50, 60)]
    lines = ["File Name: d.edf", "Seizure End Time: 3 seconds", "Seizure Start Time: 12.5 seconds", "Seizure End Time: 20 seconds"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string")
    assert [(r["file"], r["start_s"], r["end_s"]) for r in R.seizure_spans(df).collect()] == [("d.edf", 12.5, 20.0)]
    clocks = spark.createDataFrame([("22.00.00", "23:59:50", "00:00:20"), ("10.00.00", "10.00.05", "11.00.00")], "registration string, start string, end string")
    assert [(r["start_s"], r["end_s"]) for r in R.clock_spans(clocks).collect()] == [(7190.0, 7220.0)]


def test_streaming_windows_equal_batch(spark, data, tmp_path):
    from epochalis.sources.tables import samples

    whole = samples(spark, data).orderBy("sample_idx")
    for k in range(3):
        whole.where(f"sample_idx div 25 = {k}").drop("channel").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec_id long, sample_idx long, ms long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = count_windows(stream, 16).writeStream.format("memory").queryName("epochs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["rec_id"], r["epoch"]): (round(r["mean"], 6), r["span_ms"]) for r in spark.table("epochs").collect()}
    want = {(r["rec_id"], r["epoch"]): (round(sum(r["w"]) / 16, 6), float(r["span_ms"])) for r in E.epoch_table(samples(spark, data).where("sample_idx < 75"), 16).collect()}
    assert got == want


def test_montage_drops_incomplete_pairs(spark):
    s = spark.createDataFrame([(1, 0, "A", 5.0), (1, 0, "B", 2.0), (1, 1, "A", 1.0)], "rec_id long, sample_idx long, channel string, value double")
    p = spark.createDataFrame([("A-B", "A", "B")], "channel string, anode string, cathode string")
    assert [tuple(r) for r in R.montage(s, p).collect()] == [(1, 0, "A-B", 3.0)]


@pytest.mark.parametrize("parts", [1, 8])
def test_frames_reconstruct_the_interior(spark, data, parts):
    from epochalis.sources.tables import samples

    s = samples(spark, data).repartition(parts)
    out = E.overlap_add(E.frames(s, 16, 8), 16).where("cover > 0.999")
    bad = out.join(s.select("rec_id", "sample_idx", s["value"].alias("v")), ["rec_id", "sample_idx"]).where("abs(value - v) > 1e-6").count()
    assert bad == 0


def test_slopes_of_kept_steps_alone():
    from epochalis.functions.pursuit import Tangents

    rng = np.random.default_rng(9)
    x, p = rng.normal(size=(6, 64)), np.column_stack((rng.random(6), 20 * rng.random(6), 0.1 + rng.random(6), rng.normal(size=6), 0.1 + rng.random(6)))
    some = np.array([True, False, True, True, False, False])
    energy, slope, curve = tangents(x, p, 64, 64.0)
    held = Tangents(x, p, 64, 64.0)
    assert (held.energy == energy).all() and all((a == b[some]).all() for a, b in zip(held.slopes(some), (slope, curve)))


def test_features_search_atoms_once(spark, data):
    from epochalis.plans.queries import QUERIES

    files = QUERIES["epoch_features"](spark, data).inputFiles()
    assert files and all("/atoms-" in f for f in files)


def test_denoise_numbers_samples_once(spark, data):
    from epochalis.plans.queries import QUERIES

    assert any("/samples-" in f for f in QUERIES["denoise"](spark, data).inputFiles())
