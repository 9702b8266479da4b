"""Event-time windows of a stream against the same windows of a table, with rows in any order and too late."""

import datetime as dt
import math
import random

import pytest

from epochalis.streaming.epochs import channel_rollup, late_rows, timed_windows, timed_windows_of

WIDTH, SPAN, SCHEMA = 2000, (1500.0, 1990.0), "rec_id string, ts timestamp, value double"


def made(seed=0):
    """Rows every 100 ms; pieces are missing, one key has a gap of several windows."""
    rng, rows = random.Random(seed), []
    for rec in ("a", "b", "c"):
        for k in range(600):
            ms = 1_700_000_000_000 + k * 100 + rng.randrange(50)
            lost = rec == "b" and 150 <= k < 280 or rec != "a" and rng.random() < 0.1 or rec == "c" and k % 60 in range(8)
            if not lost:
                rows.append((rec, ms, rng.random()))
    return rows


def told(rows):
    return sorted((r["rec_id"], r["start_ms"], r["windows"], r["n"], r["span_ms"], None if r["mean"] is None else round(r["mean"], 9), None if r["sd"] is None else round(r["sd"], 9), r["reason"]) for r in rows)


def table(spark, rows):
    return spark.createDataFrame([(r, dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc), v) for r, ms, v in rows], SCHEMA)


@pytest.mark.parametrize("keep_bad", [True, False])
def test_a_shuffled_stream_equals_the_table(spark, tmp_path, keep_bad):
    rows = made()
    by_time = sorted(rows, key=lambda r: r[1])
    late = [("a", by_time[0][1] + 10, 5.0), ("b", by_time[0][1] + 4100, 5.0)]
    rng = random.Random(1)
    # batches in order of time, rows in any order inside and 3 s to and fro between them; the last brings rows far too late
    batches: list[list] = [[] for _ in range(12)]
    for r in by_time:
        batches[min(11, max(0, int((r[1] - by_time[0][1] + rng.uniform(-3000, 3000)) // 5000)))].append(r)
    for b in batches:
        rng.shuffle(b)
    source, out = str(tmp_path / "in"), f"windows{int(keep_bad)}"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = timed_windows(stream, WIDTH, SPAN, "8 seconds", keep_bad=keep_bad).writeStream.format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for b in [*batches, late]:
            table(spark, b).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        passed = (by_time[-1][1] // WIDTH + 1) * WIDTH - 8000
        want = told(timed_windows_of(table(spark, rows), WIDTH, SPAN, passed, keep_bad=keep_bad).collect())
        assert told(spark.table(out).collect()) == want
        assert late_rows(query) == 2
    finally:
        query.stop()
    reasons = {w[-1] for w in want}
    assert reasons == ({None, "packet_loss", "missing"} if keep_bad else {None, "missing"})
    assert max(w[2] for w in want) >= 5


def test_windows_of_a_table_equal_a_loop(spark):
    rows = made(4)
    got = told(timed_windows_of(table(spark, rows), WIDTH, SPAN).collect())
    want = []
    for rec in ("a", "b", "c"):
        groups: dict = {}
        for r, ms, v in rows:
            if r == rec:
                groups.setdefault(ms // WIDTH * WIDTH, []).append((ms, v))
        last = None
        for start in sorted(groups):
            if last is not None and start - last > WIDTH:
                want.append((rec, last + WIDTH, (start - last) // WIDTH - 1, 0, None, None, None, "missing"))
            ms, vs = zip(*groups[start])
            mean = math.fsum(vs) / len(vs)
            span = float(max(ms) - min(ms))
            want.append((rec, start, 1, len(vs), span, round(mean, 9), round(math.sqrt(math.fsum((v - mean) ** 2 for v in vs) / len(vs)), 9), None if SPAN[0] <= span <= SPAN[1] else "packet_loss"))
            last = start
    assert got == sorted(want)
    assert timed_windows_of(table(spark, rows).limit(0), WIDTH, SPAN).count() == 0


def test_channel_rollup_drops_what_comes_after_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "channel string, ts timestamp, value double"
    batch = lambda rows: spark.createDataFrame([(c, start + dt.timedelta(minutes=m), float(v)) for c, m, v in rows], schema)
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    query = channel_rollup(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for rows in ([("x", 5, 1), ("x", 50, 3), ("y", 10, 7)], [("x", 70, 5), ("y", 400, 1)], [("x", 20, 100), ("y", 410, 3)], [("y", 800, 0)]):
            batch(rows).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = sorted((r["channel"], r["window"]["start"].hour, r["n"], r["mean"], r["sd"]) for r in spark.table("rolled").collect())
    finally:
        query.stop()
    assert got == [("x", 0, 2, 2.0, 1.0), ("x", 1, 1, 5.0, 0.0), ("y", 0, 1, 7.0, 0.0), ("y", 6, 2, 2.0, 1.0)]
