"""EDF source, annotation grammar and corpus loaders on generated files, against loops over whole arrays."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from test_signals import resample

from epochalis.sources import corpora as C
from epochalis.sources import edf as X
from epochalis.sources.recordings import read_edf


def edf(signals: dict, fs: int, seconds: int = 1, records=None, annotations=True) -> bytes:
    """A file of int16 signals (0.5 a step), ``fs`` samples a second each."""
    labels = [*signals, *(["EDF Annotations"] if annotations else [])]
    pad = lambda v, n: str(v).ljust(n).encode()
    per = fs * seconds
    n = min(len(v) for v in signals.values()) // per
    head = pad("0", 168) + pad("10.20.30", 8) + pad("", 60) + pad(n if records is None else records, 8) + pad(seconds, 8) + pad(len(labels), 4)
    for width, values in ((16, labels), (80, [""] * len(labels)), (8, ["uV"] * len(labels)), (8, [-500] * len(labels)), (8, [500] * len(labels)), (8, [-1000] * len(labels)), (8, [1000] * len(labels)), (80, [""] * len(labels)), (8, [per] * len(signals) + [3] * annotations), (32, [""] * len(labels))):
        head += b"".join(pad(v, width) for v in values)
    body = b""
    for k in range(n):
        body += b"".join(np.asarray(v[k * per : (k + 1) * per], "<i2").tobytes() for v in signals.values()) + b"\7\0" * 3 * annotations
    return head + body


def noise(n, seed):
    return np.random.default_rng(seed).integers(-900, 900, n)


def joined(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        have = out.setdefault((r["path"].rsplit("/", 1)[1], r["channel"]), [])
        assert len(have) == r["start"] - rows_start(rows, r)
        have += r["values"]
    return out


def rows_start(rows, row):
    return min(r["start"] for r in rows if (r["path"], r["channel"]) == (row["path"], row["channel"]))


def test_ranges_of_records_are_the_whole_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "ROW_SAMPLES", 40)
    a, b = noise(500, 1), noise(500, 2)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.edf").write_bytes(edf({"A": a, "B": b}, 10, records=-1) + b"\1")
    (tmp_path / "y.EDF").write_bytes(edf({"A": b, "B": a}, 10)[:-7])
    (tmp_path / "notes.txt").write_text("no")
    for task_bytes in (1 << 20, 400, 1):
        frame = X.load_edf(spark, str(tmp_path), task_bytes=task_bytes)
        got = joined(frame.collect())
        assert frame.where("error is not null").count() == 0
        assert {k: len(v) for k, v in got.items()} == {("x.edf", "A"): 500, ("x.edf", "B"): 500, ("y.EDF", "A"): 490, ("y.EDF", "B"): 490}
        assert np.allclose(got["x.edf", "B"], b * 0.5) and np.allclose(got["y.EDF", "A"], b[:490] * 0.5)
    parts = X.EdfReader({"path": str(tmp_path / "deep" / "x.edf"), "task_bytes": "400"}).partitions()
    assert len(parts) > 3 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]] and parts[-1].last == 50
    some = X.load_edf(spark, "file://" + str(tmp_path / "deep"), channels=["B"], from_s=12.5, until_s=30).collect()
    assert {r["channel"] for r in some} == {"B"}
    lo = min(r["start"] for r in some)
    assert lo <= 120 and np.allclose(joined(some)["x.edf", "B"], b[lo:300] * 0.5)
    with pytest.raises(Exception, match="FileNotFoundError"):
        X.load_edf(spark, str(tmp_path / "nothing")).count()


def test_bad_files_are_told_and_the_rest_is_read(spark, tmp_path):
    good = edf({"A": noise(40, 3)}, 10)
    (tmp_path / "good.edf").write_bytes(good)
    (tmp_path / "empty.edf").write_bytes(b"")
    (tmp_path / "short.edf").write_bytes(good[:300])
    (tmp_path / "word.edf").write_bytes(good[:236] + b"many    " + good[244:])
    (tmp_path / "zero.edf").write_bytes(good[:244] + b"0       " + good[252:])
    (tmp_path / "head.edf").write_bytes(good[:768])
    rows = X.load_edf(spark, str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in rows if r["error"]} == {"empty.edf", "short.edf", "word.edf", "zero.edf", "head.edf"}
    assert [r["path"].rsplit("/", 1)[1] for r in rows if not r["error"]] == ["good.edf"]
    assert read_edf(spark, str(tmp_path)).count() == 1
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in X.file_digests(spark, str(tmp_path), block=7).collect()}
    assert got["good.edf"] == hashlib.sha256(good).hexdigest() and len(got) == 6


LAYOUTS = {
    # header alone; midnight passed inside a span; dots and colons
    "one": "PATIENT\n\nSeizure n 1\nFile name: A-1.edf\nRegistration start time: 23.50.00\nRegistration end time: 00:50:00\nSeizure start time: 23:59:50\nSeizure end time: 00.00.20\nSeizure n 2\nFile name: A-1.edf\nSeizure start time: 00.10.00\nSeizure end time: 00.11.00\n",
    # a colon; a span that is too long
    "two": "Seizure n 1:\nFile name: B-1.edf\nRegistration start time: 10.00.00\nSeizure start time: 10.00.10\nSeizure end time: 10.30.10\nSeizure n 2:\nFile name: B-2.edf\nRegistration start time: 12.00.00\nSeizure start time: 12.00.10\nSeizure end time: 12.00.30\n",
    # a remark
    "three": "Seizure n 1 (in sleep):\nFile name: C-1.edf\nRegistration start time: 01.00.00\nSeizure start time: 01.00.05\nSeizure end time: 01.00.25\n",
    # without the word, indented, in other cases
    "four": "Seizure n 1:\nfile name: D-1.edf\nregistration start time: 05.00.00\n  Start time: 05.01.00\n\tEnd time: 05.01.30\n",
    # once in the preamble; the second block names another file without a registration, the third the first again
    "five": "File name: E-1.edf\nRegistration start time: 20.00.00\n\nSeizure n 1\nSeizure start time: 20.00.01\nSeizure end time: 20.00.02\nSeizure n 2\nFile name: E-2.edf\nSeizure start time: 20.05.00\nSeizure end time: 20.06.00\nSeizure n 3\nFile name: E-1.edf\nSeizure start time: 20.10.00\nSeizure end time: 20.10.30\n",
    "odd": "Registration start time: 20.00.00\nSeizure n 1\nSeizure start time: 20.00.01\nSeizure end time: 20.00.02\nSeizure n 2\nFile name: F.edf\nRegistration start time: 20.00\nSeizure start time: 20.00.01\nSeizure end time: 20.00.02\n",
    "empty": "",
}


def test_five_layouts_of_annotations(spark):
    frame = spark.createDataFrame([*LAYOUTS.items(), ("none", None)], "doc string, text string")
    got: dict = {}
    for r in C.annotated_spans(frame).orderBy("doc", "file", "k").collect():
        got.setdefault(r["doc"], []).append((r["file"], r["k"], r["start_s"], r["end_s"]))
    assert got == {
        "one": [("A-1.edf", 1, 590.0, 620.0), ("A-1.edf", 2, 1200.0, 1260.0)],
        "two": [("B-2.edf", 1, 10.0, 30.0)],
        "three": [("C-1.edf", 1, 5.0, 25.0)],
        "four": [("D-1.edf", 1, 60.0, 90.0)],
        "five": [("E-1.edf", 1, 1.0, 2.0), ("E-1.edf", 2, 600.0, 630.0)],
    }


def unit(w):
    c = w - w.mean()
    return c / np.linalg.norm(c)


def checked(epochs, arrays, width, channels):
    """Every epoch equals its stretch of the whole array; windows by label."""
    rows, seen = epochs.collect(), {}
    for r in rows:
        x = arrays[r["path"].rsplit("/", 1)[1]][r["channel"]][r["at"] : r["at"] + width]
        assert np.allclose(r["w"], unit(x), atol=1e-9)
        assert math.isclose(r["log_rms"], math.log(x.std() + 1e-6), abs_tol=1e-9) and math.isclose(r["log_linelength"], math.log(np.abs(np.diff(x)).mean() + 1e-6), abs_tol=1e-9)
        seen.setdefault((r["label"], r["path"].rsplit("/", 1)[1], r["at"]), set()).add(r["channel"])
    assert all(v == set(channels) for v in seen.values()) and len(rows) == len(seen) * len(channels)
    return sorted(seen)


def test_cases_with_summaries(spark, tmp_path):
    """Windows inside seizures, as many elsewhere; flat windows, wrong digests, missing channels and bad files left out."""
    fs, width, channels = 8, 16, ("A-B", "C-D")
    arrays, sums = {}, []
    for case, n_free in (("chb01", 3), ("chb21", 1)):
        (tmp_path / case).mkdir()
        for k in range(n_free + 1):
            x = {c: noise(400, zlib.crc32(f"{case} {k} {c}".encode())) for c in (*channels, "E-F")}
            x["A-B"][160:176] = 7 if k == 0 else x["A-B"][160:176]
            name = f"{case}_{k + 1:02d}.edf"
            arrays[name] = {c: v * 0.5 for c, v in x.items()}
            (tmp_path / case / name).write_bytes(edf(x, fs))
        (tmp_path / case / f"{case}-summary.txt").write_text(f"Data\nFile Name: {case}_01.edf\nNumber of Seizures in File: 2\nSeizure 1 Start Time: 3 seconds\nSeizure 1 End Time: 8 seconds\nSeizure 2 Start Time: 20 seconds\nSeizure 2 End Time: 26 seconds\n\nFile Name: {case}_02.edf\nNumber of Seizures in File: 0\n")
    (tmp_path / "chb01" / "chb01_08.edf").write_bytes(edf({"A-B": noise(80, 1)}, fs))
    (tmp_path / "chb01" / "chb01_09.edf").write_bytes(b"nothing")
    (tmp_path / "chb01" / "chb01_07.edf").write_bytes(edf({c: noise(80, 1) for c in channels}, fs))
    for f in sorted(tmp_path.glob("*/*.edf")):
        sums.append(f"{hashlib.sha256(f.read_bytes()).hexdigest() if '_07' not in f.name else '0' * 64} *{f.parent.name}/{f.name}")
    (tmp_path / "SHA256SUMS.txt").write_text("\n".join(sums))
    (tmp_path / "RECORDS-WITH-SEIZURES").write_text("chb01/chb01_03.edf\nchb01/chb01_01.edf\n\n")
    epochs, lost = C.load_marked(spark, str(tmp_path), width=width, channels=channels, fs=fs)
    told = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in lost.collect()}
    assert told["chb01_07.edf"] == "its digest is another one" and told["chb01_08.edf"] == "a channel is missing" and "ValueError" in told["chb01_09.edf"] and len(told) == 3
    got = checked(epochs, arrays, width, channels)
    # 3 s to 8 s: two windows of 2 s; 20 s to 26 s: three, of which the first has a flat channel
    assert [g for g in got if g[0] == 1] == [(1, f"{c}_01.edf", a) for c in ("chb01", "chb21") for a in (24, 40, 176, 192)]
    no = [g for g in got if g[0] == 0]
    assert all(a % width == 0 and a + width < 400 for _, _, a in no)
    assert {c: sum(g[1].startswith(c) for g in no) for c in ("chb01", "chb21")} == {"chb01": 4, "chb21": 4}
    assert {g[1] for g in no} == {"chb01_02.edf", "chb01_04.edf", "chb21_02.edf"}
    assert {(r["case"], r["subject"]) for r in epochs.select("case", "subject").distinct().collect()} == {("chb01", "chb01"), ("chb21", "chb01")}


def test_quotas_pass_on_what_a_file_lacks(spark):
    usable = spark.createDataFrame([("a", f"/x/a_{k}.edf", c) for k, c in enumerate((2, 50, 3, 40))] + [("b", "/x/b.edf", 1), ("c", "/x/c.edf", 9)], "case string, path string, c bigint")
    wanted = spark.createDataFrame([("a", 30), ("b", 7), ("d", 3), ("c", 0)], "case string, want bigint")
    rows = C.shared_out(usable, wanted, 3).collect()
    order = sorted(((hashlib.md5(f"a_{k}.edf".encode()).hexdigest(), k, c) for k, c in enumerate((2, 50, 3, 40))))[:3]
    got, want = 0, {}
    for i, (_, k, c) in enumerate(order):
        want[f"/x/a_{k}.edf"] = q = min(max(-(-(30 - got) // (3 - i)), 0), c)
        got += q
    assert {r["path"]: r["quota"] for r in rows} == {**want, "/x/b.edf": 1, "/x/c.edf": 0}


def test_cases_with_clocks_and_single_electrodes(spark, tmp_path):
    fs, out, width, pairs = 16, 8, 16, ("T7-P7", "FZ-CZ")
    (tmp_path / "PN00").mkdir()
    arrays = {}
    # T3 and T5 are T7 and P7 by other names; the annotation spells the first file with a letter for a zero
    for name, labels in (("PN00-1.edf", ("EEG T3", "EEG T5", "EEG Fz", "EEG Cz", "EKG")), ("PN00-2.edf", ("EEG T7", "EEG P7", "Fz", "CZ"))):
        x = {c: noise(16 * 60, len(c) + ord(name[5]) + k) for k, c in enumerate(labels)}
        (tmp_path / "PN00" / name).write_bytes(edf(x, fs))
        v = list(x.values())
        arrays[name] = {p: resample((v[2 * k] - v[2 * k + 1]) * 0.5, 1, 2) for k, p in enumerate(pairs)}
    (tmp_path / "PN00" / "PN00-3.edf").write_bytes(edf({"EEG T3": noise(160, 5)}, fs))
    (tmp_path / "PN00" / "Seizures-list-PN00.txt").write_text("Seizure n 1\nFile name: PNO0-1.edf\nRegistration start time: 19.39.33\nSeizure start time: 19.39.40\nSeizure end time: 19.39.45\nSeizure n 2\nFile name: PN00-9.edf\nRegistration start time: 1.1.1\nSeizure start time: 1.1.2\nSeizure end time: 1.1.9\n")
    epochs, lost = C.load_clocked(spark, str(tmp_path), width=width, pairs=pairs, fs=out, guard_s=10, share=3.0)
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in lost.collect()} == {"PN00-3.edf": "a pair is missing"}
    got = checked(epochs, arrays, width, pairs)
    assert [g for g in got if g[0] == 1] == [(1, "PN00-1.edf", 56), (1, "PN00-1.edf", 72)]
    no = [g for g in got if g[0] == 0]
    assert len(no) == 6
    for _, name, at in no:
        t = at / out
        assert at % width == 0 and at + width < 480 and (name == "PN00-2.edf" or t + 2 < 7 - 10 or t > 12 + 10)


def test_runs_at_rest_and_at_work(spark, tmp_path):
    fs, out, channels = 10, 8, ("Fz", "Cz")
    want = {}
    for subject in ("S01", "S02"):
        for run in (1, 2):
            x = {f"EEG {c}": noise(100, run + 7 * k) for k, c in enumerate(channels)}
            for v in x.values():
                v[90:] = 0
            x["EEG Cz"][91] = 1
            (tmp_path / f"{subject}_{run}.edf").write_bytes(edf(x, fs))
            for c, v in x.items():
                want[f"{subject}_{run}", c[4:]] = resample(v[:92] * 0.5, 4, 5)
    (tmp_path / "S03_1.edf").write_bytes(edf({"EEG Fz": noise(100, 1)}, fs))
    (tmp_path / "S04_1.edf").write_bytes(edf({f"EEG {c}": np.zeros(100) for c in channels}, fs))
    (tmp_path / "subject-info.csv").write_text("Subject,Age,Count quality\nS01,20,1\nS02,21,0\n")
    told, lost = C.load_runs(spark, str(tmp_path), channels=channels, fs=out)
    got: dict = {}
    for r in told.orderBy("sample_idx").collect():
        assert r["label"] == int(r["rec_id"][-1]) - 1 and r["subject"] == r["rec_id"][:3] and r["ms"] == r["sample_idx"] * 125.0
        got.setdefault((r["rec_id"], r["channel"]), []).append(r["value"])
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in lost.collect()} == {"S03_1.edf": "a channel is missing", "S04_1.edf": "nothing but padding"}
    assert {r["subject"] for r in C.load_runs(spark, str(tmp_path), channels=channels, fs=out, good_only=True)[0].collect()} == {"S01"}
