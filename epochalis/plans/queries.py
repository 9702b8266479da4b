"""Registered queries: each applies operators to whole tables; each SQL text says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BANDS
from ..functions import models as M
from ..functions.pursuit import atoms_of
from ..functions.reservoirs import EchoState, pooled_readout, ridge, run_reservoir
from ..operators import atoms as A
from ..operators import dictionary as D
from ..operators import epochs as E
from ..operators import intervals as I
from ..operators import selection as C
from ..operators import statistics as S
from ..scratch import written
from ..sources.recordings import clock_seconds, montage
from ..sources.tables import atoms, ordered_index, read, samples

WIDTH, HOP = 16, 8
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: a window's span in the events tables is days, its rails are their least and largest values
SPAN_DAYS = (86_400_000.0, 9 * 86_400_000.0)
GATE = {"span": SPAN_DAYS, "rails": (0.5, 480.0), "rail_share": 0.13, "max_abs_z": 3.0}

_SAMPLES = """samples AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
  (epoch_us(ts) // 1000) AS ms, event_type AS channel, value FROM events)"""
_EPOCHS = f"""{_SAMPLES}, ep AS (SELECT rec_id, sample_idx // {WIDTH} AS epoch, min(sample_idx) AS start, max(ms) - min(ms) AS span_ms,
  list(value ORDER BY sample_idx) AS w, avg(value) AS mean, stddev_pop(value) AS sd, max(value) AS hi, min(value) AS lo,
  avg(CASE WHEN value <= 0.5 OR value >= 480.0 THEN 1.0 ELSE 0.0 END) AS railed FROM samples GROUP BY 1, 2 HAVING count(*) = {WIDTH}),
  line AS (SELECT rec_id, epoch, avg(abs(d)) AS ll FROM (SELECT rec_id, sample_idx // {WIDTH} AS epoch, value - lag(value) OVER
  (PARTITION BY rec_id, sample_idx // {WIDTH} ORDER BY sample_idx) AS d FROM samples) GROUP BY 1, 2)"""
_REASON = """CASE WHEN span_ms < 86400000 OR span_ms > 777600000 THEN 'packet_loss' WHEN railed >= 0.13 THEN 'adc_rail'
  WHEN sd < 0.001 * (1 + abs(mean)) THEN 'near_constant' WHEN greatest(hi - mean, mean - lo) > 3.0 * sd THEN 'artifact' END"""


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def near(value: Column | str, digits: int) -> Column:
    """The value to so many digits as SQL's round has it: halves of the scaled double, not of its decimal text, go up."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * 10.0**digits) / 10.0**digits


def rounded(df: DataFrame, *keep: str, digits: int = 4) -> DataFrame:
    """Rounds all columns but ``keep``; adding 0.0 makes -0.0 into 0.0."""
    return df.select(*[F.col(c) if c in keep else (near(c, digits) + 0.0).alias(c) for c in df.columns])


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    return E.epoch_table(samples(spark, d), WIDTH)


@query(f"WITH {_EPOCHS} SELECT rec_id, epoch, start, span_ms, {_REASON} AS reason FROM ep")
def gate_reasons(spark, d):
    return _epochs(spark, d).select("rec_id", "epoch", F.col("start").cast("bigint").alias("start"), F.col("span_ms").cast("bigint").alias("span_ms"), E.gate_reason(F.col("w"), F.col("span_ms"), **GATE).alias("reason"))


@query(f"WITH {_EPOCHS} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM ep GROUP BY 1")
def reject_histogram(spark, d):
    return gate_reasons(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_EPOCHS} SELECT rec_id, epoch, round(log(sd + 1e-6) / log(exp(1)), 4) + 0.0 AS log_rms, round(ln(ll + 1e-6), 4) + 0.0 AS log_linelength
  FROM ep JOIN line USING (rec_id, epoch) WHERE {_REASON} IS NULL""".replace("log(sd + 1e-6) / log(exp(1))", "ln(sd + 1e-6)"))
def amp_features(spark, d):
    kept = _epochs(spark, d).where(E.gate_reason(F.col("w"), F.col("span_ms"), **GATE).isNull())
    return rounded(E.amplitude_features(kept), "rec_id", "epoch")


@query(f"""WITH {_EPOCHS} SELECT rec_id, epoch, i, round((w[i] - mean) / (sd * sqrt({WIDTH}.0)), 5) + 0.0 AS x
  FROM ep, range(1, {WIDTH + 1}) r(i) WHERE sd * sqrt({WIDTH}.0) >= 1e-6""")
def epoch_normalise(spark, d):
    n = _epochs(spark, d).select("rec_id", "epoch", F.posexplode(E.normalised(F.col("w"))).alias("i", "x"))
    return rounded(n.withColumn("i", (F.col("i") + 1).cast("bigint")), "rec_id", "epoch", "i", digits=5)


@query(f"""WITH {_EPOCHS} SELECT rec_id, epoch, round(ln(sd + 1e-6), 4) + 0.0 AS log_rms FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY epoch) AS k
  FROM ep WHERE {_REASON} IS NULL) WHERE k <= 2""")
def epoch_cap(spark, d):
    """At most two kept epochs of a recording, the first ones."""
    kept = _epochs(spark, d).where(E.gate_reason(F.col("w"), F.col("span_ms"), **GATE).isNull())
    first = kept.groupBy("rec_id").agg(F.min("epoch").alias("epoch"))
    second = kept.join(first.withColumnRenamed("epoch", "first"), "rec_id").where("epoch > first").groupBy("rec_id").agg(F.min("epoch").alias("epoch"))
    first = first.unionAll(second)
    return rounded(E.amplitude_features(kept.join(first, ["rec_id", "epoch"])).select("rec_id", "epoch", "log_rms"), "rec_id", "epoch")


_FRAMES = f"""{_SAMPLES}, sizes AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY 1), fr AS (SELECT rec_id, f AS frame, sample_idx - f * {HOP} AS off, sample_idx, value
  FROM samples JOIN sizes USING (rec_id), range(0, 100000) g(f) WHERE n >= {WIDTH} AND f <= (n - {WIDTH}) // {HOP} AND sample_idx >= f * {HOP} AND sample_idx < f * {HOP} + {WIDTH})"""
_FRAMES = _FRAMES.replace("range(0, 100000)", f"(SELECT unnest(range(0, (SELECT max(n) // {HOP} + 1 FROM sizes)))) ")


@query(f"WITH {_FRAMES} SELECT rec_id, frame, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM fr GROUP BY 1, 2")
def frame_hop(spark, d):
    return E.frames(samples(spark, d), WIDTH, HOP).groupBy("rec_id", "frame").agg(F.count("*").alias("n"), (near(F.avg("value"), 6) + 0.0).alias("mean"))


@query(f"""WITH {_FRAMES} SELECT rec_id, sample_idx, round(sum(value * (0.5 - 0.5 * cos(2 * pi() * off / {WIDTH}))), 4) + 0.0 AS value,
  round(sum(0.5 - 0.5 * cos(2 * pi() * off / {WIDTH})), 4) + 0.0 AS cover FROM fr GROUP BY 1, 2""")
def hann_overlap_add(spark, d):
    return rounded(E.overlap_add(E.frames(samples(spark, d), WIDTH, HOP), WIDTH), "rec_id", "sample_idx")


@query("""WITH m AS (SELECT event_type AS channel, median(value) AS c FROM events GROUP BY 1) SELECT channel, round(1.4826 * median(abs(value - c)), 4) AS sigma
  FROM (SELECT event_type AS channel, value FROM events) JOIN m USING (channel) GROUP BY 1""")
def robust_sigma(spark, d):
    return rounded(E.robust_sigma(read(spark, d, "events").select(F.col("event_type").alias("channel"), "value"), "channel", "value"), "channel")


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / CASE WHEN stddev_pop(l_quantity) OVER w <= 1e-12 THEN 1.0 ELSE stddev_pop(l_quantity) OVER w END, 4) + 0.0 AS z
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def group_zscore(spark, d):
    z = E.group_zscore(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), "l_suppkey", "l_quantity")
    return rounded(z.select("l_orderkey", "l_linenumber", "z"), "l_orderkey", "l_linenumber")


@query(f"""WITH {_EPOCHS}, win AS (SELECT rec_id, epoch, mean AS x, {_REASON} IS NULL AS valid, list_contains(list_transform(w, lambda v: v > 300), true) AS flag, start AS t FROM ep)
  SELECT rec_id, epoch // 2 AS step, round(avg(CASE WHEN valid THEN x END), 8) AS x, bool_or(flag) AS flag, min(t) AS t, sum(valid::int)::bigint AS n_valid, sum(valid::int) >= 2 AS valid
  FROM win GROUP BY 1, 2 HAVING count(*) = 2""")
def step_rollup(spark, d):
    w = _epochs(spark, d).select("rec_id", "epoch", E.mean_of(F.col("w")).alias("x"), E.gate_reason(F.col("w"), F.col("span_ms"), **GATE).isNull().alias("valid"), F.exists("w", lambda v: v > 300).alias("flag"), F.col("start").cast("bigint").alias("t"))
    return rounded(E.step_rollup(w, 2), "rec_id", "step", "flag", "t", "n_valid", "valid", digits=8)


# intervals: windows are half-hours after an event, spans start at error events
_IV = """win AS (SELECT event_id AS window_id, user_id AS k, (epoch_us(ts) // 1000) / 1000.0 AS t0, (epoch_us(ts) // 1000) / 1000.0 + 1800 AS t1 FROM events WHERE event_type <> 'error'),
  span AS (SELECT user_id AS k, (epoch_us(ts) // 1000) / 1000.0 AS s, (epoch_us(ts) // 1000) / 1000.0 + 600 + value * 20 AS e FROM events WHERE event_type = 'error')"""


def _windows(spark, d):
    t = F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "event_type", t.alias("t"), "value")
    return e.where("event_type <> 'error'").select(F.col("event_id").alias("window_id"), "k", F.col("t").alias("t0"), (F.col("t") + 1800).alias("t1")), e.where("event_type = 'error'").select("k", F.col("t").alias("s"), (F.col("t") + 600 + F.col("value") * 20).alias("e"))


@query(f"WITH {_IV} SELECT window_id FROM win WHERE EXISTS (SELECT 1 FROM span WHERE span.k = win.k AND t0 < e AND t1 > s)")
def ictal_overlap(spark, d):
    w, s = _windows(spark, d)
    return I.bucketed_overlap(w, s, "k", 86400.0, "semi").select("window_id")


@query(f"WITH {_IV} SELECT window_id FROM win WHERE NOT EXISTS (SELECT 1 FROM span WHERE span.k = win.k AND t0 < e + 86400 AND t1 > s - 86400)")
def guard_anti_join(spark, d):
    w, s = _windows(spark, d)
    return I.bucketed_overlap(w, s, "k", 86400.0, "anti", 86400.0).select("window_id")


@query(f"WITH {_IV} SELECT k AS user_id, round(s + i * 900, 2) AS t0 FROM span, range(0, 20) r(i) WHERE s + (i + 1) * 900 <= e")
def contained_windows(spark, d):
    return I.contained_windows(_windows(spark, d)[1], 900.0).select(F.col("k").alias("user_id"), near("t0", 2).alias("t0"))


@query(f"""WITH {_IV} SELECT window_id AS step_id, CASE WHEN EXISTS (SELECT 1 FROM span WHERE span.k = win.k AND s > t0 AND s <= t0 + 43200) THEN 1 ELSE 0 END AS y,
  NOT EXISTS (SELECT 1 FROM span WHERE span.k = win.k AND t0 >= s AND t0 <= e + 7200) AS eligible FROM win""")
def risk_label(spark, d):
    w, s = _windows(spark, d)
    return I.risk_labels(w.select(F.col("window_id").alias("step_id"), "k", F.col("t0").alias("t")), s, "k", 43200.0, 7200.0).select("step_id", "y", "eligible")


_STEPS = f"""{_SAMPLES}, st AS (SELECT rec_id, sample_idx, value, ms // 432000000 AS file_id FROM samples)"""


def _steps(spark, d):
    return samples(spark, d).withColumn("file_id", F.floor(F.col("ms") / 432000000).cast("bigint"))


@query(f"WITH {_STEPS} SELECT rec_id, sample_idx FROM (SELECT *, lag(file_id, 4) OVER w AS a, lead(file_id, 3) OVER w AS b FROM st WINDOW w AS (PARTITION BY rec_id ORDER BY sample_idx)) WHERE a = b")
def valid_samples(spark, d):
    return I.valid_samples(_steps(spark, d), "rec_id", "sample_idx", "file_id", 5, 3).select("rec_id", "sample_idx")


@query(f"WITH {_STEPS} SELECT rec_id, sample_idx, round(lead(value, 1) OVER w - value, 4) + 0.0 AS d1, round(lead(value, 2) OVER w - value, 4) + 0.0 AS d2, round(lead(value, 3) OVER w - value, 4) + 0.0 AS d3 FROM st WINDOW w AS (PARTITION BY rec_id ORDER BY sample_idx)")
def horizon_targets(spark, d):
    ahead = I.lagged(_steps(spark, d), "rec_id", "sample_idx", "value", [-1, -2, -3])
    return rounded(ahead.select("rec_id", "sample_idx", *[(F.col(f"lag_m{k}") - F.col("value")).alias(f"d{k}") for k in (1, 2, 3)]), "rec_id", "sample_idx")


@query(f"""WITH {_STEPS}, t AS (SELECT rec_id, sample_idx, value AS u0, lag(value, 2) OVER w AS u2, lag(value, 4) OVER w AS u4 FROM st WINDOW w AS (PARTITION BY rec_id, file_id ORDER BY sample_idx))
  SELECT rec_id, sample_idx, round(u0, 4) AS u0, round(u2, 4) AS u2, round(u4, 4) AS u4, round(u0 * u0, 4) AS p00, round(u0 * u2, 4) AS p02, round(u0 * u4, 4) AS p04, round(u2 * u2, 4) AS p22, round(u2 * u4, 4) AS p24, round(u4 * u4, 4) AS p44 FROM t""")
def nvar_taps(spark, d):
    """Taps two steps apart inside a file, and their products."""
    s = _steps(spark, d).withColumn("f", F.struct("rec_id", "file_id"))
    t = I.lagged(s, "f", "sample_idx", "value", [2, 4]).select("rec_id", "sample_idx", F.col("value").alias("u0"), F.col("lag_2").alias("u2"), F.col("lag_4").alias("u4"))
    products = [near(F.col(f"u{a}") * F.col(f"u{b}"), 4).alias(f"p{a}{b}") for a, b in ((0, 0), (0, 2), (0, 4), (2, 2), (2, 4), (4, 4))]
    return t.select("rec_id", "sample_idx", *[near(f"u{k}", 4).alias(f"u{k}") for k in (0, 2, 4)], *products)


@query(f"""WITH {_STEPS}, p AS (SELECT rec_id, value AS v, lead(value) OVER w AS nxt, avg(value) OVER (PARTITION BY rec_id ORDER BY sample_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pred,
  sample_idx >= count(*) OVER (PARTITION BY rec_id) // 2 AS test FROM st WINDOW w AS (PARTITION BY rec_id ORDER BY sample_idx))
  SELECT rec_id, round(1 - sum((pred - nxt) * (pred - nxt)) / sum((v - nxt) * (v - nxt)), 4) + 0.0 AS skill FROM p WHERE test AND nxt IS NOT NULL GROUP BY 1 HAVING sum((v - nxt) * (v - nxt)) > 0""")
def persistence_skill(spark, d):
    """Skill of the mean of the last five values over persistence, in the second half of each recording."""
    s = I.chronological_half(_steps(spark, d), "rec_id", "sample_idx")
    t = I.lagged(s, "rec_id", "sample_idx", "value", [-1, 1, 2, 3, 4])
    past = F.array_compact(F.array("value", "lag_1", "lag_2", "lag_3", "lag_4"))
    t = t.withColumn("pred", E.mean_of(past)).where("half = 1 and lag_m1 is not null")
    return rounded(t.groupBy("rec_id").agg(S.skill(t, "pred", "lag_m1", "value", F.lit(True)).alias("skill")).where("skill is not null"), "rec_id")


@query(f"""WITH {_STEPS}, h AS (SELECT *, sample_idx >= count(*) OVER (PARTITION BY rec_id) // 2 AS test FROM st), m AS (SELECT rec_id, avg(value) AS mu, stddev_pop(value) AS sd FROM h WHERE NOT test GROUP BY 1)
  SELECT rec_id, sample_idx, CASE WHEN test THEN 1 ELSE 0 END AS half, round(greatest(-10, least(10, (value - mu) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END)), 4) + 0.0 AS z FROM h JOIN m USING (rec_id)""")
def chrono_split(spark, d):
    """Standardised by the first half's mean and deviation, cut off at ten."""
    s = I.chronological_half(_steps(spark, d), "rec_id", "sample_idx")
    m = s.where("half = 0").groupBy("rec_id").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = (F.col("value") - F.col("mu")) / F.when(F.col("sd") <= 1e-12, 1.0).otherwise(F.col("sd"))
    return rounded(s.join(m, "rec_id").select("rec_id", "sample_idx", "half", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)).alias("z")), "rec_id", "sample_idx", "half")


# dictionaries
_ATOM_AXES = {"tc": [0.25, 0.5, 0.75], "fc": [2.0, 5.0, 9.0, 14.0], "dt": [0.1, 0.3], "c": [0.0, 8.0]}


def _search_grid(spark):
    g = D.grid(spark, **_ATOM_AXES)
    return g.select((((F.col("tc_i") * 4 + F.col("fc_i")) * 2 + F.col("dt_i")) * 2 + F.col("c_i")).cast("int").alias("atom_id"), "tc", "fc", "dt", "c")


@query("""WITH ax AS (SELECT ((a.i * 4 + b.i) * 2 + e.i) * 2 + h.i AS atom_id, a.v AS tc, b.v AS fc, e.v AS dt, h.v AS c FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 0.75)) a(i, v),
  (VALUES (0, 2.0::DOUBLE), (1, 5.0), (2, 9.0), (3, 14.0)) b(i, v), (VALUES (0, 0.1::DOUBLE), (1, 0.3)) e(i, v), (VALUES (0, 0.0::DOUBLE), (1, 8.0)) h(i, v)),
  q AS (SELECT atom_id, i, exp(-0.5 * pow((i / 64.0 - tc) / dt, 2)) * cos(2 * pi() * (fc * (i / 64.0 - tc) + 0.5 * c * pow(i / 64.0 - tc, 2))) AS gc,
    exp(-0.5 * pow((i / 64.0 - tc) / dt, 2)) * sin(2 * pi() * (fc * (i / 64.0 - tc) + 0.5 * c * pow(i / 64.0 - tc, 2))) AS gs FROM ax, range(0, 64) r(i)),
  x AS (SELECT vec_id AS id, i, embedding[i + 1]::DOUBLE AS w FROM embeddings, range(0, 64) r(i)),
  s AS (SELECT id, atom_id, sum(w * gc) AS bc, sum(w * gs) AS bs, sum(gc * gc) AS cc, sum(gs * gs) AS ss, sum(gc * gs) AS cs FROM x JOIN q USING (i) GROUP BY 1, 2),
  e AS (SELECT id, atom_id, round(CASE WHEN abs(cc * ss - cs * cs) > 1e-6 * greatest(cc * ss, 1e-30) THEN (ss * bc * bc - 2 * cs * bc * bs + cc * bs * bs) / (cc * ss - cs * cs) ELSE bc * bc / greatest(cc, 1e-30) END, 9) AS energy FROM s)
  SELECT id AS vec_id, atom_id::int AS atom_id, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY energy DESC, atom_id) AS k FROM e) WHERE k = 1""")
def atom_search(spark, d):
    """Best atom of each vector, taken as one second of 64 samples."""
    signals = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("w"))
    return D.search(signals, _search_grid(spark), 64, 64.0).select(F.col("id").alias("vec_id"), "atom_id", near("energy", 6).alias("energy"))


_AT = """atm AS (SELECT vec_id // 5 AS epoch_id, (vec_id % 5)::int AS ch_idx, k::int AS atom_idx, abs(embedding[k * 5 + 1]::DOUBLE) * 4 AS t_s, abs(embedding[k * 5 + 2]::DOUBLE) * 120 AS f_hz,
  abs(embedding[k * 5 + 3]::DOUBLE) * 4 + 0.05 AS dur_s, embedding[k * 5 + 4]::DOUBLE * 20 AS rate_hz_s, embedding[k * 5 + 5]::DOUBLE * embedding[k * 5 + 5]::DOUBLE AS energy
  FROM embeddings, range(0, 12) r(k) WHERE vec_id // 5 IN (SELECT vec_id // 5 FROM embeddings GROUP BY 1 HAVING count(*) = 5)),
  ao AS (SELECT *, f_hz * dur_s >= 0.5 AND f_hz >= 0.5 AND f_hz <= 40 AND dur_s <= 2 AND abs(rate_hz_s * dur_s) <= greatest(f_hz, 1e-9) AS osc FROM atm)"""


@query(f"WITH {_AT} SELECT epoch_id, ch_idx, atom_idx, round(f_hz, 4) AS f_hz, round(rate_hz_s * dur_s, 4) + 0.0 AS sweep_hz, osc FROM ao")
def atom_physical(spark, d):
    return atoms(spark, d).select("epoch_id", "ch_idx", "atom_idx", near("f_hz", 4).alias("f_hz"), (near(F.col("rate_hz_s") * F.col("dur_s"), 4) + 0.0).alias("sweep_hz"), A.oscillatory(2.0).alias("osc"))


_BAND_SUMS = ", ".join(f"round(coalesce(sum(energy) FILTER (WHERE osc AND f_hz >= {lo} AND f_hz < {hi}), 0) / sum(energy), 4) AS frac_{b}" for b, (lo, hi) in BANDS.items())


@query(f"""WITH {_AT}, m AS (SELECT epoch_id, ch_idx, sum(CASE WHEN osc THEN energy ELSE 0 END) AS we, coalesce(sum(energy * f_hz) FILTER (WHERE osc), 0) AS wf FROM ao GROUP BY 1, 2), j AS (SELECT ao.*, we, CASE WHEN we > 1e-12 THEN wf / we ELSE 0 END AS mf FROM ao JOIN m USING (epoch_id, ch_idx))
  SELECT epoch_id, ch_idx, {_BAND_SUMS}, round(coalesce(sum(energy) FILTER (WHERE osc), 0) / sum(energy), 4) AS osc_frac, round(1 - coalesce(sum(energy) FILTER (WHERE osc), 0) / sum(energy), 4) + 0.0 AS transient_frac,
  round(any_value(mf), 4) AS mean_fc_hz, CASE WHEN any_value(we) > 1e-12 THEN round(sqrt(sum(energy * (f_hz - mf) * (f_hz - mf)) FILTER (WHERE osc) / any_value(we)), 4) ELSE 0 END AS std_fc_hz,
  CASE WHEN any_value(we) > 1e-12 THEN round(sum(energy * abs(rate_hz_s * dur_s)) FILTER (WHERE osc) / any_value(we), 4) ELSE 0 END AS mean_abs_sweep_hz,
  CASE WHEN any_value(we) > 1e-12 THEN round(sum(energy * rate_hz_s * dur_s) FILTER (WHERE osc) / any_value(we), 4) + 0.0 ELSE 0 END AS mean_signed_sweep_hz,
  CASE WHEN any_value(we) > 1e-12 THEN round(sum(energy * dur_s) FILTER (WHERE osc) / any_value(we), 4) ELSE 0 END AS mean_dur_s FROM j GROUP BY 1, 2 HAVING sum(energy) > 1e-12""")
def channel_features(spark, d):
    return rounded(A.channel_features(atoms(spark, d), 2.0), "epoch_id", "ch_idx")


_PROF = ", ".join(f"coalesce(sum(energy) FILTER (WHERE f_hz >= {lo} AND f_hz < {hi}), 0) AS p_{b}, sum(energy * t_s) FILTER (WHERE f_hz >= {lo} AND f_hz < {hi}) / sum(energy) FILTER (WHERE f_hz >= {lo} AND f_hz < {hi}) AS t_{b}" for b, (lo, hi) in BANDS.items())
_NORM = "greatest(sqrt(" + " + ".join(f"p_{b} * p_{b}" for b in BANDS) + "), 1e-12)"
_BANDCASE = lambda x: "CASE " + " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN {i}" for i, (lo, hi) in enumerate(BANDS.values())) + " ELSE -1 END"
_PAIRCOLS = ", ".join(f"avg(CASE WHEN abs(a.t_{b} - c.t_{b}) <= 0.25 THEN 1.0 ELSE 0.0 END) AS cooccur_{b}, coalesce(avg(abs(a.t_{b} - c.t_{b})) FILTER (WHERE abs(a.t_{b} - c.t_{b}) <= 0.25), 0) AS lag_{b}" for b in BANDS)
_DOT = "(" + " + ".join(f"a.p_{b} * c.p_{b}" for b in BANDS) + ") / (a.nrm * c.nrm)"


@query(f"""WITH {_AT}, ch AS (SELECT epoch_id, ch_idx, sum(energy) AS e, sum(energy * f_hz) / sum(energy) AS fb, sum(energy * rate_hz_s) / sum(energy) AS rb, arg_max(f_hz, energy) AS ft, {_PROF} FROM atm GROUP BY 1, 2),
  cn AS (SELECT *, {_NORM} AS nrm FROM ch), tot AS (SELECT epoch_id, sum(e) AS te FROM ch GROUP BY 1), top AS (SELECT epoch_id, arg_max(t_s, energy) AS tt, arg_max(f_hz, energy) AS tf FROM atm GROUP BY 1),
  one AS (SELECT epoch_id, sum(e) * sum(e) / (count(*) * sum(e * e)) AS energy_participation, -sum(e / te * ln(e / te)) / ln(count(*)) AS energy_entropy, stddev_pop(fb) AS freq_spread,
    avg(CASE WHEN {_BANDCASE('ft')} = {_BANDCASE('tf')} THEN 1.0 ELSE 0.0 END) AS top_band_agreement FROM ch JOIN tot USING (epoch_id) JOIN top USING (epoch_id) GROUP BY epoch_id),
  rec AS (SELECT epoch_id, count(DISTINCT ch_idx) / 5.0 AS recruitment FROM atm JOIN top USING (epoch_id) WHERE abs(f_hz - tf) <= 2 AND abs(t_s - tt) <= 0.25 AND energy > 0 GROUP BY 1),
  two AS (SELECT a.epoch_id, avg({_DOT}) AS profile_coherence, {_PAIRCOLS}, avg(abs(a.fb - c.fb)) AS freq_disagreement, avg(abs(a.rb - c.rb)) AS sweep_disagreement FROM cn a JOIN cn c ON a.epoch_id = c.epoch_id AND a.ch_idx < c.ch_idx GROUP BY 1)
  SELECT epoch_id, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ["energy_participation", "energy_entropy", "profile_coherence", *[f"{k}_{b}" for b in BANDS for k in ("cooccur", "lag")], "recruitment", "freq_disagreement", "freq_spread", "sweep_disagreement", "top_band_agreement"])}
  FROM one JOIN two USING (epoch_id) JOIN rec USING (epoch_id)""")
def cross_features(spark, d):
    return rounded(A.cross_features(atoms(spark, d)), "epoch_id")


@query(f"""WITH {_AT}, rules AS (SELECT * FROM (VALUES (30.0), (40.0)) a(f_high), (VALUES (1.0), (2.0), (3.0)) b(k_high), (VALUES (1.0), (2.0)) c(f_low), (VALUES (1.0), (2.0), (3.0)) e(k_low), (VALUES (0.08), (0.12)) g(dt_short), (VALUES (1.0), (2.0)) h(k_short))
  SELECT f_high::DOUBLE AS f_high, k_high::DOUBLE AS k_high, f_low::DOUBLE AS f_low, k_low::DOUBLE AS k_low, dt_short::DOUBLE AS dt_short, k_short::DOUBLE AS k_short, count(*) FILTER (WHERE ((abs(f_hz - 60) < 3 OR abs(f_hz - 50) < 3) AND dur_s >= 0.1)
    OR (f_hz - 1 / (2 * pi() * greatest(dur_s, 1e-6)) >= f_high AND sqrt(energy) >= k_high * 0.1) OR (f_hz <= f_low AND sqrt(energy) >= k_low * 0.1) OR (dur_s <= dt_short AND sqrt(energy) >= k_short * 0.1)) AS n_flagged
  FROM atm, rules GROUP BY ALL""")
def artifact_rules(spark, d):
    """How many atoms each of the 144 rules flags: atoms are counted by which of the rules' parts they meet, and the few such sets are held against the rules."""
    axes = {"f_high": [30, 40], "k_high": [1, 2, 3], "f_low": [1, 2], "k_low": [1, 2, 3], "dt_short": [0.08, 0.12], "k_short": [1, 2]}
    parts, grid = A.rule_grid(axes)
    met = A.parts_met(F.col("f_hz"), F.col("dur_s"), F.sqrt("energy"), F.lit(0.1), parts)
    sets = atoms(spark, d).groupBy(met.alias("met")).agg(F.count("*").alias("n"))  # 65,536 at most
    names = list(axes)
    rules = spark.createDataFrame([(mask, *(float(rule[n]) for n in names)) for mask, rule in grid], "mask int, " + ", ".join(f"{n} double" for n in names))  # 144 rows
    return sets.crossJoin(F.broadcast(rules)).groupBy(*names).agg(F.sum(F.when(F.col("met").bitwiseAND(F.col("mask")) != 0, F.col("n")).otherwise(0)).alias("n_flagged"))


# statistics
_FEAT = "SELECT d.doc_id, toxic, quality, source, n_chars, n_chars % 17 AS residue, n_chars % 2 AS pred FROM documents d JOIN labels USING (doc_id)"


def _labelled(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "toxic", "quality", "source", "n_chars", (F.col("n_chars") % 17).alias("residue"), (F.col("n_chars") % 2).cast("int").alias("pred"))


@query(f"""WITH f AS ({_FEAT}), l AS (SELECT quality, 'n_chars' AS feature, n_chars::DOUBLE AS x FROM f UNION ALL SELECT quality, 'residue', residue::DOUBLE FROM f),
  b AS (SELECT feature, quality, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2), t AS (SELECT feature, avg(x) AS mm, count(*) AS nn FROM l GROUP BY 1)
  SELECT feature, round((sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(n * v) / (any_value(nn) - count(*))), 4) AS f FROM b JOIN t USING (feature) GROUP BY 1""")
def anova_f(spark, d):
    return rounded(S.anova_f(_labelled(spark, d), ["n_chars", "residue"], "quality"), "feature")


@query(f"""WITH f AS ({_FEAT}), s AS (SELECT count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, avg(n_chars) FILTER (WHERE quality = 1) AS m1, avg(n_chars) FILTER (WHERE quality = 0) AS m0,
  var_samp(n_chars) FILTER (WHERE quality = 1) AS v1, var_samp(n_chars) FILTER (WHERE quality = 0) AS v0 FROM f) SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 4) AS d FROM s""")
def cohens_d(spark, d):
    return rounded(S.cohens_d(_labelled(spark, d), "n_chars", "quality"))


@query(f"WITH f AS ({_FEAT}) SELECT source, count(*) AS n, round(avg(CASE WHEN quality = pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM f GROUP BY 1")
def per_subject_accuracy(spark, d):
    return rounded(S.accuracy(_labelled(spark, d), ["source"], "quality", "pred"), "source", "n")


@query(f"WITH f AS ({_FEAT}) SELECT round(max(n)::DOUBLE / sum(n), 4) AS majority FROM (SELECT quality, count(*) AS n FROM f GROUP BY 1)")
def majority_baseline(spark, d):
    return rounded(_labelled(spark, d).groupBy("quality").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority")))


@query(f"""WITH f AS ({_FEAT}), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM f)
  SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM r""")
def roc_auc_rank(spark, d):
    return rounded(S.roc_auc(_labelled(spark, d).withColumn("score", F.col("n_chars") / 100000.0), "quality", "score"), digits=6)


@query("""WITH x AS (SELECT ps_a - ps_b AS d FROM (SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 0), 3) AS ps_a, round(avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 1), 3) AS ps_b FROM lineitem GROUP BY 1)),
  r AS (SELECT round(d, 3) AS d, rank() OVER (ORDER BY abs(round(d, 3))) + (count(*) OVER (PARTITION BY abs(round(d, 3))) - 1) / 2.0 AS r FROM x WHERE round(d, 3) <> 0)
  SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus FROM r""")
def wilcoxon_w(spark, d):
    """Signed ranks of the suppliers' mean quantities, even against odd lines."""
    side = lambda k: near(F.avg(F.when(F.col("l_linenumber") % 2 == k, F.col("l_quantity"))), 3)
    pairs = read(spark, d, "lineitem").groupBy("l_suppkey").agg(side(0).alias("a"), side(1).alias("b"))
    return S.wilcoxon_w(pairs, near(F.col("a") - F.col("b"), 3)).select("n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"))


_COUNTS = "cts AS (SELECT s_nationkey AS circuit_id, lpad(bin(s_suppkey % 8), 4, '0') AS bits, count(*) AS n FROM supplier GROUP BY 1, 2)"


@query(f"""WITH c AS (SELECT user_id AS circuit_id, event_id % 16 AS v, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT circuit_id, sum(n) FILTER (WHERE v < 8) AS kn, sum(n) AS an FROM c GROUP BY 1)
  SELECT circuit_id, v AS state, round(n / kn, 5) AS p, round(kn / an, 5) AS kept FROM c JOIN k USING (circuit_id) WHERE v < 8""")
def counts_to_dist(spark, d):
    """Distributions from measured bit strings, those with the ancilla at 0 kept."""
    bits = F.lpad(F.bin(F.col("event_id") % 16), 4, "0")
    c = read(spark, d, "events").groupBy(F.col("user_id").alias("circuit_id"), F.concat(F.substring(bits, 1, 1), F.lit(" "), F.substring(bits, 2, 3)).alias("bits")).agg(F.count("*").alias("n"))
    return rounded(S.counts_to_distribution(c), "circuit_id", "state", digits=5)


@query("""WITH c AS (SELECT event_type AS k, event_id % 8 AS s, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type) AS p FROM events GROUP BY 1, 2), q AS (SELECT event_id % 8 AS s, count(*)::DOUBLE / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1)
  SELECT k, round(sum(abs(coalesce(p, 0) - q)) / 2, 5) AS tvd FROM (SELECT DISTINCT k FROM c) kk CROSS JOIN q LEFT JOIN c USING (k, s) GROUP BY 1""")
def tvd(spark, d):
    """Distance of each event type's distribution from the one of all events."""
    e = read(spark, d, "events").select(F.col("event_type").alias("k"), (F.col("event_id") % 8).alias("s"))
    by = e.groupBy("k", "s").agg(F.count("*").alias("n"))
    p = by.join(by.groupBy("k").agg(F.sum("n").alias("t")), "k").select("k", "s", (F.col("n") / F.col("t")).alias("p"))
    q = by.groupBy("s").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(by.agg(F.sum("n").alias("t")))).select("s", (F.col("n") / F.col("t")).alias("p"))
    return rounded(S.total_variation(p, q.crossJoin(F.broadcast(by.select("k").distinct())), ["k"], "s"), "k", digits=5)


@query("""WITH g AS (SELECT source, count(*) AS n, sum(quality) AS pos FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, pos DESC, source) - 1 AS k FROM g)
  SELECT source, n, pos::bigint AS pos, (CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END)::int AS fold FROM r""")
def group_folds(spark, d):
    return S.group_folds(_labelled(spark, d), "source", "quality", 5)


# engines and ordered state: no SQL says these; tests hold them against planted signals and plain loops
@query(None)
def pursuit(spark, d):
    """Six atoms of each vector, taken as one second of 64 samples."""
    signals = read(spark, d, "embeddings").select(F.col("vec_id").alias("epoch_id"), F.lit(0).alias("ch_idx"), F.col("embedding").cast("array<double>").alias("w"))
    return rounded(atoms_of(signals, 64, 64.0), "epoch_id", "ch_idx", "atom_idx", digits=6)


@query(None)
def denoise(spark, d):
    """Frames of each recording lose the atoms that the artifact rule flags; overlap-add gives the cleaned samples."""
    s = written(samples(spark, d).select("rec_id", "sample_idx", "value"), "samples")
    framed = E.frames(s, WIDTH, HOP)
    signals = framed.groupBy("rec_id", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]).alias("w"))
    sigma = E.robust_sigma(s, "rec_id", "value")
    found = atoms_of(signals, WIDTH, 16.0, 3, True, ("rec_id", "frame")).join(sigma, "rec_id")
    rule = F.struct(F.lit(6.0).alias("f_high"), F.lit(2.0).alias("k_high"), F.lit(1.0).alias("f_low"), F.lit(2.0).alias("k_low"), F.lit(0.08).alias("dt_short"), F.lit(2.0).alias("k_short"))
    amp = F.aggregate("wave", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    flagged = found.where(A.artifact_flag(F.col("f_hz"), F.col("dur_s"), amp, F.col("sigma"), rule))
    waves = flagged.select("rec_id", "frame", F.posexplode("wave").alias("offset", "value")).withColumn("sample_idx", F.col("frame") * HOP + F.col("offset"))
    estimate = E.overlap_add(waves, WIDTH).select("rec_id", "sample_idx", F.col("value").alias("artifact"))
    clean = s.join(estimate, ["rec_id", "sample_idx"], "left").withColumn("artifact", F.coalesce("artifact", F.lit(0.0)))
    return rounded(clean.select("rec_id", "sample_idx", "value", (F.col("value") - F.col("artifact")).alias("cleaned")), "rec_id", "sample_idx")


def _inputs(spark, d):
    return samples(spark, d).select("rec_id", "sample_idx", F.array(F.col("value") / 500).alias("u"), "value")


@query(None)
def esn_states(spark, d):
    return run_reservoir(_inputs(spark, d), lambda: EchoState(1))


@query(None)
def ridge_readout(spark, d):
    """Weights of the echo state's one-step forecast."""
    s = _inputs(spark, d)
    ahead = I.lagged(s, "rec_id", "sample_idx", "value", [-1]).where("lag_m1 is not null").select("rec_id", "sample_idx", (F.col("lag_m1") / 500).alias("y"))
    rows = run_reservoir(s, lambda: EchoState(1)).join(ahead, ["rec_id", "sample_idx"])
    w = ridge(rows.select(F.concat("state", F.array(F.lit(1.0))).alias("x"), "y"), "x", "y", 1e-3)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "feature int, weight double"), "feature", digits=6)


@query("""WITH x AS (SELECT page_id, regexp_extract(html, '(\\d{1,2})[.:](\\d{2})[.:](\\d{2})', 1) AS h, regexp_extract(html, '(\\d{1,2})[.:](\\d{2})[.:](\\d{2})', 2) AS m, regexp_extract(html, '(\\d{1,2})[.:](\\d{2})[.:](\\d{2})', 3) AS s FROM pages)
  SELECT page_id, (try_cast(h AS int) * 3600 + try_cast(m AS int) * 60 + try_cast(s AS int))::int AS seconds FROM x""")
def siena_times(spark, d):
    """First clock time in each page, as seconds since midnight."""
    return read(spark, d, "pages").select("page_id", clock_seconds(F.col("html")).alias("seconds"))


@query(f"""WITH {_SAMPLES}, e AS (SELECT rec_id, sample_idx // 8 AS epoch, channel, avg(value) AS v FROM samples GROUP BY 1, 2, 3)
  SELECT a.rec_id, a.epoch AS sample_idx, round(a.v - b.v, 4) + 0.0 AS value FROM e a JOIN e b USING (rec_id, epoch) WHERE a.channel = 'click' AND b.channel = 'view'""")
def montage_diff(spark, d):
    """Mean of one channel less another's, by recording and stretch of eight samples."""
    means = samples(spark, d).groupBy("rec_id", F.floor(F.col("sample_idx") / 8).cast("bigint").alias("sample_idx"), "channel").agg(F.avg("value").alias("value"))
    pairs = spark.createDataFrame([("click-view", "click", "view")], "channel string, anode string, cathode string")
    return rounded(montage(means, pairs).select("rec_id", "sample_idx", "value"), "rec_id", "sample_idx")


# choice of files, subjects and configurations
_CONFIGS = {"layers": [1, 2, 3], "reupload": [0, 1], "rate": [1, 3, 10]}


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def quality_semi(spark, d):
    return C.of_quality(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", "quality").select("doc_id", "source")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def unmarked_files(spark, d):
    """Orders in neither of two sets of marked ones."""
    orders = read(spark, d, "orders")
    returned, urgent = read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"), orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return C.unmarked(orders.select("o_orderkey"), "o_orderkey", returned, urgent)


_NAMES = "n AS (SELECT s_suppkey, concat('chb', lpad((s_suppkey % 24 + 1)::VARCHAR, 2, '0'), '_', s_suppkey % 40, CASE WHEN s_suppkey % 5 = 0 THEN '+' ELSE '' END, CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE '' END, '.edf') AS name FROM supplier)"


@query(f"""WITH {_NAMES} SELECT s_suppkey, CASE WHEN s_suppkey % 24 + 1 = 21 THEN 'chb01' ELSE concat('chb', lpad((s_suppkey % 24 + 1)::VARCHAR, 2, '0')) END AS subject,
  CASE WHEN s_suppkey % 7 = 0 THEN 1000000 ELSE (s_suppkey % 40)::INT END AS place, s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0 AS goes_on FROM n""")
def recording_names(spark, d):
    """Subject and sort key of file names."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("chb"), F.lpad((k % 24 + 1).cast("string"), 2, "0"), F.lit("_"), (k % 40).cast("string"), F.when(k % 5 == 0, "+").otherwise(""), F.when(k % 7 == 0, "x").otherwise(""), F.lit(".edf"))
    place, on = C.file_place(F.col("name"))
    named = read(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    return named.select("s_suppkey", C.subject_of(F.col("name"), {"chb21": "chb01"}).alias("subject"), place.alias("place"), on.alias("goes_on"))


@query(f"""WITH {_SAMPLES}, n AS (SELECT rec_id, count(DISTINCT channel) AS n FROM samples GROUP BY 1), t AS (SELECT rec_id, max(sample_idx) AS last FROM samples WHERE abs(value) > 100 GROUP BY 1)
  SELECT s.rec_id, count(*) AS n_samples, max(sample_idx) AS last FROM samples s JOIN n ON n.rec_id = s.rec_id AND n.n = (SELECT count(DISTINCT event_type) FROM events) JOIN t ON t.rec_id = s.rec_id AND sample_idx <= last GROUP BY 1""")
def whole_trimmed(spark, d):
    """Recordings that have every channel, without what follows their last large sample."""
    return C.trimmed(C.whole_montage(samples(spark, d), "rec_id"), "rec_id", 100.0).groupBy("rec_id").agg(F.count("*").alias("n_samples"), F.max("sample_idx").alias("last"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= ceil(n * 0.2)""")
def quota_sample(spark, d):
    """A fifth of each source's documents: a sampling operator."""
    return C.quota_sample(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 0.2).select("source", "doc_id")


@query("""WITH s AS (SELECT l_linenumber AS config, l_suppkey AS subject, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), m AS (SELECT config, count(*) AS n, round(median(s), 6) AS score FROM s GROUP BY 1)
  SELECT config, n, score, config = (SELECT arg_min(config, (score, config)) FROM m) AS best FROM m""")
def best_config(spark, d):
    """Median over suppliers of each line number's mean price, and the smallest."""
    rows = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("config"), F.col("l_suppkey").alias("subject"), "l_extendedprice")
    return C.best_config(rows, "config", "subject", "l_extendedprice")


@query("""WITH r AS (SELECT l_suppkey AS subject, l_linenumber % 2 AS run, avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT a.subject, round(a.s, 8) AS a, round(b.s, 8) AS b, round(a.s - b.s, 8) + 0.0 AS d FROM r a JOIN r b USING (subject) WHERE a.run = 0 AND b.run = 1""")
def paired_runs(spark, d):
    runs = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_linenumber") % 2).alias("run")).agg(F.avg("l_quantity").alias("s"))
    return rounded(C.paired_runs(runs.where("run = 0"), runs.where("run = 1"), "subject", "s"), "subject", digits=8)


@query("""SELECT count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS n, count(*) FILTER (WHERE b.doc_id IS NULL) AS only_a, count(*) FILTER (WHERE a.doc_id IS NULL) AS only_b,
  count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.y IS DISTINCT FROM b.y) AS differ FROM (SELECT doc_id, n_chars % 2 AS y FROM documents) a FULL JOIN (SELECT doc_id, quality AS y FROM labels) b ON a.doc_id = b.doc_id""")
def aligned_sets(spark, d):
    return C.aligned(read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("y")), read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id", "y")


@query(f"""WITH {_AT} SELECT epoch_id, ch_idx, atom_idx, rank::INT AS rank, round(percent, 4) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id, ch_idx ORDER BY energy DESC, atom_idx) AS rank, 100 * energy / sum(energy) OVER (PARTITION BY epoch_id, ch_idx) AS percent FROM atm) WHERE rank <= 3""")
def explain_atoms(spark, d):
    """The three strongest atoms of each channel-epoch."""
    return C.explained(atoms(spark, d)).select("epoch_id", "ch_idx", "atom_idx", "rank", (near("percent", 4) + 0.0).alias("percent"))


@query("""WITH x AS (SELECT doc_id, n_chars::DOUBLE AS a, (n_chars % 17)::DOUBLE AS b FROM documents), s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM x)
  SELECT doc_id, round((a - ma) / sa, 5) + 0.0 AS a, round((b - mb) / sb, 5) + 0.0 AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS bias FROM x, s""")
def standardize(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), (F.col("n_chars") % 17).cast("double").alias("b"), F.lit(3.0).alias("c"))
    return rounded(S.standardized(x, ["a", "b", "c"]), "doc_id", digits=5)


@query("SELECT event_type AS channel, round(quantile_cont(value, 0.01), 4) AS low, round(quantile_cont(value, 0.99), 4) AS high FROM events GROUP BY 1")
def percentile_bounds(spark, d):
    return rounded(S.percentile_bounds(read(spark, d, "events").select(F.col("event_type").alias("channel"), "value"), "channel", "value"), "channel")


@query("""WITH m AS (SELECT l_returnflag AS k, l_quantity - 25 AS p, l_extendedprice / 1500.0 - 25 AS y FROM lineitem), g AS (SELECT k, 1 - sum((p - y) * (p - y)) / sum(y * y) AS skill, corr(p, y) AS corr, stddev_samp(y) / stddev_samp(p) AS gain FROM m GROUP BY 1)
  SELECT k, round(any_value(skill), 5) AS skill, round(any_value(corr), 5) AS corr, round(any_value(gain), 5) AS gain, round(1 - sum((gain * p - y) * (gain * p - y)) / sum(y * y), 5) AS bold FROM m JOIN g USING (k) GROUP BY 1""")
def forecast_metrics(spark, d):
    """Quantities as forecasts of scaled prices, against a constant last value."""
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("double").alias("p"), (F.col("l_extendedprice") / 1500.0).cast("double").alias("y"), F.lit(25.0).alias("last"))
    return rounded(S.forecast_metrics(x, "k", "p", "y", "last"), "k", digits=5)


@query("SELECT l_suppkey AS subject, round(avg(nullif(l_discount, 0)), 9) AS score, count(nullif(l_discount, 0)) AS n FROM lineitem GROUP BY 1")
def seed_means(spark, d):
    """Mean score of each subject over the seeds that gave one."""
    x = F.nullif(F.col("l_discount"), F.lit(0))
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(near(F.avg(x), 9).alias("score"), F.count(x).alias("n"))


@query("SELECT vec_id, len(x) AS k, round(list_sum(x), 5) + 0.0 AS total FROM (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE) AS x FROM embeddings)")
def leading_components(spark, d):
    """The first eight components of each vector."""
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 8)
    return read(spark, d, "embeddings").select("vec_id", F.size(x).cast("bigint").alias("k"), (near(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION SELECT item_id::VARCHAR, 'benchmark' FROM benchmark".replace("doc_id AS id", "doc_id::VARCHAR AS id"))
def union_cases(spark, d):
    parts = [read(spark, d, t).select(F.col(c).cast("string").alias("id"), F.lit(k).alias("kind")) for t, c, k in (("documents", "doc_id", "document"), ("benchmark", "item_id", "benchmark"))]
    return parts[0].unionByName(parts[1]).distinct()


@query(None)
def epoch_features(spark, d):
    """From signals to feature rows: atoms of every vector, the 13 statistics of its channel, the 18 of its epoch; five vectors are an epoch."""
    signals = read(spark, d, "embeddings").select((F.col("vec_id") / 5).cast("bigint").alias("epoch_id"), (F.col("vec_id") % 5).cast("int").alias("ch_idx"), F.col("embedding").cast("array<double>").alias("w"))
    found = written(atoms_of(signals, 64, 64.0), "atoms")
    return rounded(A.feature_rows(found, 1.0), "epoch_id", "ch_idx", digits=5)


@query(None)
def logreg_out_of_fold(spark, d):
    """Quality of documents by a logistic regression that saw no document of the same source."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    text = F.coalesce("text", F.lit(""))
    x = rows.select("doc_id", "source", "quality", F.log1p(F.length(text)).alias("size"), (F.regexp_count(text, F.lit(r"\s+")) / (F.length(text) + 1)).alias("blanks"), (F.regexp_count(text, F.lit(r"[0-9]")) / (F.length(text) + 1)).alias("digits"), (F.regexp_count(text, F.lit(r"[.!?]")) / (F.length(text) + 1)).alias("stops"))
    out = M.out_of_fold(written(x, "features"), ["size", "blanks", "digits", "stops"], "quality", "source", 4, n=3)
    return out.select("doc_id", "source", "fold", "predicted", near("probability", 6).alias("probability"))


@query(f"""WITH {_IV}, near AS (SELECT o.event_id AS onset_id, w.window_id AS step, w.t0, row_number() OVER (PARTITION BY o.event_id ORDER BY w.t0, w.window_id) AS r
  FROM events o JOIN win w ON o.user_id = w.k AND w.t0 + 600 > (epoch_us(o.ts) // 1000) / 1000.0 WHERE o.event_type = 'error')
  SELECT event_id AS onset_id, step, round(t0, 3) AS t FROM events LEFT JOIN near ON onset_id = event_id AND r = 1 WHERE event_type = 'error'""")
def first_step_after(spark, d):
    """The first ten-minute step of a user that ends after each of the user's errors."""
    t = F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "event_type", t.alias("t"))
    onsets = e.where("event_type = 'error'").select(F.col("event_id").alias("onset_id"), "k", F.col("t").alias("s"))
    steps = e.where("event_type <> 'error'").select("k", "t", F.col("event_id").alias("step"))
    return I.first_after(onsets, steps, "k", 600.0, 86400.0).select("onset_id", "step", near("t", 3).alias("t"))


@query(f"""WITH {_STEPS}, h AS (SELECT rec_id, sample_idx, list(value) OVER (PARTITION BY rec_id ORDER BY sample_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS v FROM st)
  SELECT rec_id, sample_idx, round(v[1] + 2 * v[2] + 3 * v[3] + 4 * v[4] + 5 * v[5] + 6 * v[6], 4) + 0.0 AS weighted FROM h WHERE len(v) = 6""")
def history_arrays(spark, d):
    """Six values before and at each sample, summed with rising weights so that their order shows."""
    held = I.histories(samples(spark, d), "rec_id", "sample_idx", "value", 6).where("history is not null")
    weighted = F.aggregate(F.zip_with("history", F.array(*[F.lit(float(k)) for k in range(1, 7)]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return held.select("rec_id", "sample_idx", (near(weighted, 4) + 0.0).alias("weighted"))


@query(f"""WITH s AS (SELECT user_id AS rec_id, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) // 1000 AS ms, value FROM events),
  ep AS (SELECT rec_id, channel, i // 4 AS epoch, max(ms) - min(ms) AS span_ms, avg(value) AS mean, stddev_pop(value) AS sd, max(value) AS hi, min(value) AS lo,
  avg(CASE WHEN value <= 0.5 OR value >= 480.0 THEN 1.0 ELSE 0.0 END) AS railed FROM s GROUP BY 1, 2, 3 HAVING count(*) = 4),
  g AS (SELECT rec_id, epoch, count(*) AS n_channels, count(reason) AS n_bad, min_by(reason, channel) FILTER (reason IS NOT NULL) AS reason FROM (SELECT *, {_REASON} AS reason FROM ep) GROUP BY 1, 2)
  SELECT rec_id, epoch, n_channels, n_bad, reason, CASE WHEN n_bad = n_channels THEN reason END AS reason_if_all FROM g""")
def montage_gate(spark, d):
    """Event types are a user's channels, four values an epoch: why an epoch goes if all channels must pass, and if one is enough."""
    e = read(spark, d, "events").select(F.struct("user_id", "event_type").alias("rec_id"), "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")
    ep = E.epoch_table(ordered_index(e, "rec_id", F.to_date("ts"), "ts", "event_id"), 4)
    reasons = ep.select(F.col("rec_id.user_id").alias("rec_id"), "epoch", F.col("rec_id.event_type").alias("channel"), E.gate_reason(F.col("w"), F.col("span_ms"), **GATE).alias("reason"))
    some = E.montage_gate(reasons, False).select("rec_id", "epoch", F.col("reason").alias("reason_if_all"))
    return E.montage_gate(reasons).join(some, ["rec_id", "epoch"])


_STEM = lambda c: f"rtrim(replace(lower(regexp_replace({c}, '\\.[^.]*$', '')), 'o', '0'), '-.')"


@query(f"""WITH f AS (SELECT s_nationkey AS c, 'PN0' || s_nationkey || '-' || s_suppkey || '.edf' AS file, s_suppkey AS i FROM supplier),
  n AS (SELECT DISTINCT c, CASE i % 4 WHEN 0 THEN file WHEN 1 THEN replace(file, '0', 'O') WHEN 2 THEN replace(file, '.', '-.') ELSE left(file, length(file) - 5) || '.edf' END AS name FROM f),
  p AS (SELECT c, name, {_STEM('name')} AS stem FROM n), q AS (SELECT c, file, {_STEM('file')} AS stem FROM f), j AS (SELECT p.c, p.name, q.file, q.file = p.name AS same, q.stem = p.stem AS equal, starts_with(q.stem, p.stem) AS begins
  FROM p JOIN q ON p.c = q.c) SELECT c AS case_id, name, coalesce(min(file) FILTER (same), min(file) FILTER (equal), CASE WHEN count(*) FILTER (begins) = 1 THEN min(file) FILTER (begins) END, CASE WHEN count(*) = 1 THEN min(file) END) AS file FROM j GROUP BY 1, 2""")
def resolve_names(spark, d):
    """Suppliers as files of their nations, and as annotations that spell them as they are, with letters for zeros, with a dash, or cut."""
    s = read(spark, d, "supplier")
    f = s.select(F.col("s_nationkey").alias("case_id"), F.concat(F.lit("PN0"), F.col("s_nationkey").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string"), F.lit(".edf")).alias("file"), (F.col("s_suppkey") % 4).alias("i"))
    name = F.when(F.col("i") == 0, F.col("file")).when(F.col("i") == 1, F.replace("file", F.lit("0"), F.lit("O"))).when(F.col("i") == 2, F.replace("file", F.lit("."), F.lit("-.")))
    names = f.select("case_id", name.otherwise(F.expr("left(file, length(file) - 5) || '.edf'")).alias("name"))
    return C.resolved(names, f, "case_id")


@query(None)
def pooled_skill(spark, d):
    """Skill of one readout of all recordings on the last quarter of each, from the three last values."""
    t = I.lagged(samples(spark, d), "rec_id", "sample_idx", "value", [-1, 1, 2])
    n = t.groupBy("rec_id").agg(F.count("*").alias("n"))
    place = F.col("sample_idx") / F.col("n")
    rows = t.join(n, "rec_id").dropna().withColumns({"part": F.when(place < 0.5, "trn").when(place < 0.75, "val").otherwise("tst"), "y": F.col("lag_m1") - F.col("value")})
    skill, _ = pooled_readout(rows, "rec_id", ["value", "lag_1", "lag_2"], "y")
    return rounded(skill, "rec_id")
