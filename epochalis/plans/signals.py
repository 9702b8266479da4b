"""Registered queries over whole recordings: filters, rate changes, projections. SQL texts say the same sample by sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters as K
from ..functions.pursuit import atoms_of
from ..operators import atoms as A
from ..operators import denoise as Z
from ..operators import designs as N
from ..operators import epochs as E
from ..operators import signals as G
from ..scratch import written
from ..sources import corpora as U
from ..sources.tables import ordered_index, read, samples
from ..streaming import epochs as T
from .queries import _SAMPLES, query, rounded

FS = 16.0
#: chunks of the events' short recordings, so that most have several
SIZE = 20
BAND, NOTCH = K.band_pass(1.0, 4.0, FS), K.notch(5.0, FS)
UP, DOWN = 3, 4


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def _pass(source: str, b, a) -> str:
    """DuckDB expression of one pass of a filter over the list ``source``, sample by sample."""
    model = K.Recursive(b, a)
    y = f"({float(model.direct)!r} * e.y[1] + s.z[1])"
    z = ", ".join((f"s.z[{i + 2}] + " if i + 1 < model.n else "") + f"{float(b[i + 1])!r} * e.y[1] - {float(a[i + 1])!r} * {y}" for i in range(model.n))
    rest = ", ".join(f"{float(r)!r} * {source}[1]" for r in model.rest)
    return f"list_reduce(list_transform({source}, lambda v: {{'z': {_list([0] * model.n)}, 'y': [v]}}), lambda s, e: {{'z': [{z}], 'y': list_append(s.y, {y})}}, {{'z': [{rest}], 'y': []::DOUBLE[]}}).y"


def _zero_phase(name: str, source: str, b, a) -> str:
    """CTEs from ``source(rec_id, x)`` to ``name(rec_id, x)``."""
    pad = K.Recursive(b, a).pad
    return f"""{name}_e AS (SELECT rec_id, list_concat(list_transform(list_reverse(x[2:{pad + 1}]), lambda v: 2 * x[1] - v), list_concat(x, list_transform(list_reverse(x[len(x) - {pad}:len(x) - 1]), lambda v: 2 * x[len(x)] - v))) AS x FROM {source} WHERE len(x) > {pad}),
  {name}_f AS (SELECT rec_id, list_reverse({_pass("x", b, a)}) AS x FROM {name}_e), {name} AS (SELECT rec_id, list_reverse({_pass("x", b, a)})[{pad + 1}:len(x) - {pad}] AS x FROM {name}_f)"""


@query(f"""WITH {_SAMPLES}, l AS (SELECT rec_id, list(value ORDER BY sample_idx) AS x FROM samples GROUP BY 1), {_zero_phase("band", "l", *BAND)}, {_zero_phase("clean", "band", *NOTCH)}
  SELECT s.rec_id, s.sample_idx, round(c.x[s.sample_idx + 1], 4) + 0.0 AS filtered FROM samples s LEFT JOIN clean c USING (rec_id)""")
def zero_phase_filtered(spark, d):
    """Each recording without what lies outside 1 to 4 Hz, and then without 5 Hz, at 16 samples a second."""
    band = G.zero_phase(samples(spark, d), *BAND, size=SIZE)
    return rounded(G.zero_phase(band, *NOTCH, value="filtered", size=SIZE), "rec_id", "sample_idx")


def _kernel() -> str:
    """The resampling kernel as one list, tap by tap, from its bank of phases."""
    bank, reach = K.sinc_bank(UP, DOWN)
    half = 10 * max(UP, DOWN)
    taps = {p - (t - reach) * UP: bank[p, t] for p in range(UP) for t in range(2 * reach + 1)}
    return _list(taps[k] for k in range(-half, half + 1))


@query(f"""WITH {_SAMPLES}, h AS (SELECT {_kernel()} AS h), n AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY 1), m AS (SELECT rec_id, unnest(range((n * {UP} + {DOWN - 1}) // {DOWN})) AS m FROM n)
  SELECT m.rec_id, m AS sample_idx, round(sum(value * h[m * {DOWN} - sample_idx * {UP} + {10 * max(UP, DOWN) + 1}]), 4) + 0.0 AS value FROM m JOIN samples s ON m.rec_id = s.rec_id AND abs(m * {DOWN} - sample_idx * {UP}) <= {10 * max(UP, DOWN)}, h GROUP BY 1, 2""")
def resampled_samples(spark, d):
    """Each recording at three quarters of its rate."""
    return rounded(G.resampled(samples(spark, d), UP, DOWN, size=SIZE), "rec_id", "sample_idx")


def _annotations(spark, d):
    """``doc, text``: a user's errors as annotations of seizures, laid out in one of five ways; every third error begins another file."""
    errors = samples(spark, d).where("channel = 'error'").select("rec_id", "sample_idx", F.floor(F.col("ms") / 1000).cast("bigint").alias("t"), F.floor("value").cast("bigint").alias("n"))
    placed = ordered_index(errors.withColumnRenamed("sample_idx", "at"), "rec_id", F.lit(0), "at").withColumnRenamed("sample_idx", "i")
    clock = lambda s, dot: F.concat_ws(dot, *[F.lpad(x.cast("bigint").cast("string"), 2, "0") for x in (F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)])
    way, new = F.col("rec_id") % 5, F.col("i") % 3 == 0
    file, reg = F.concat(F.lit("File name: R"), F.floor(F.col("i") / 3).cast("string"), F.lit(".edf\n")), F.concat(F.lit("Registration start time: "), clock(F.col("t") - F.col("t") % 100, "."), F.lit("\n"))
    head = F.concat(F.lit("Seizure n "), F.col("i").cast("string"), F.when(way == 1, ":").when(way == 2, " (in sleep):").otherwise(""), F.lit("\n"))
    word = F.when(way == 3, "  ").otherwise("Seizure ")
    block = F.concat(F.when(new & (way == 4) & (F.col("i") == 0), F.concat(file, reg, head)).when(new, F.concat(head, file, reg)).otherwise(head), word, F.lit("start time: "), clock(F.col("t"), ":"), F.lit("\n"), word, F.lit("end time: "), clock(F.col("t") + F.col("n") * 4, "."), F.lit("\n"))
    return placed.groupBy(F.col("rec_id").alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "").alias("text"))


@query(f"""WITH {_SAMPLES}, e AS (SELECT rec_id, ms // 1000 AS t, floor(value)::BIGINT AS n, row_number() OVER (PARTITION BY rec_id ORDER BY sample_idx) - 1 AS i FROM samples WHERE channel = 'error'),
  f AS (SELECT *, first_value(t) OVER (PARTITION BY rec_id, i // 3 ORDER BY i) // 100 * 100 AS r FROM e), g AS (SELECT rec_id, i, i // 3 AS f, (t - r) % 86400 AS s, 4 * n AS n FROM f)
  SELECT rec_id AS doc, concat('R', f, '.edf') AS file, row_number() OVER (PARTITION BY rec_id, f ORDER BY i)::INT AS k, s::DOUBLE AS start_s, (s + n)::DOUBLE AS end_s FROM g WHERE n <= 1200""")
def annotation_spans(spark, d):
    """Spans read from annotation texts of five layouts, which the events' errors are written as; their SQL takes them from the events."""
    return U.annotated_spans(_annotations(spark, d))


def _blocks(spark, d):
    """The recordings as rows of an EDF source: ``path, channel, start, values``, twelve samples a row."""
    s = samples(spark, d).select(F.col("rec_id").cast("string").alias("path"), "sample_idx", "value", (F.floor(F.col("sample_idx") / 12) * 12).alias("start"))
    return s.groupBy("path", "start").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s")).select("path", F.lit("all").alias("channel"), "start", F.transform("s", lambda x: x["value"]).alias("values"))


@query(f"""WITH {_SAMPLES}, w AS (SELECT rec_id, sample_idx AS p FROM samples WHERE channel = 'error'), c AS (SELECT w.rec_id, p, list(value ORDER BY sample_idx) AS w FROM w JOIN samples s ON s.rec_id = w.rec_id AND sample_idx BETWEEN p AND p + 9 GROUP BY 1, 2 HAVING count(*) = 10),
  m AS (SELECT *, list_avg(w) AS m, list_stddev_pop(w) AS sd, list_avg(list_transform(range(1, 10), lambda i: abs(w[i + 1] - w[i]))) AS steps FROM c)
  SELECT rec_id::VARCHAR AS path, p AS start, round(sqrt(list_sum(list_transform(w, lambda x: ((x - m) / (sd * sqrt(10))) ** 2 * x * x)) / 10), 4) + 0.0 AS shape, round(ln(sd + 1e-6), 4) + 0.0 AS log_rms, round(ln(steps + 1e-6), 4) + 0.0 AS log_linelength FROM m WHERE sd >= 0.001 AND sd * sqrt(10) >= 1e-6""")
def epochs_at_marks(spark, d):
    """Ten samples from each error of a user on, cut out of rows of twelve: size, line length, and a sum that shows each normalised sample's place."""
    windows = samples(spark, d).where("channel = 'error'").select(F.col("rec_id").cast("string").alias("path"), F.col("sample_idx").alias("at"))
    blocks = _blocks(spark, d)
    cut = U.epochs_of(blocks, windows, 10, 1).join(U.cut_windows(blocks, windows, 10).withColumnRenamed("w", "raw"), ["path", "at", "channel"])
    shape = F.sqrt(F.aggregate(F.zip_with("w", "raw", lambda u, x: u * u * x * x), F.lit(0.0), lambda a, x: a + x) / 10)
    return rounded(cut.select("path", F.col("at").alias("start"), shape.alias("shape"), "log_rms", "log_linelength"), "path", "start")


@query("""WITH RECURSIVE u AS (SELECT source AS "case", lang AS path, count(*) AS c, md5(lang) AS h FROM documents GROUP BY 1, 2), want AS (SELECT source AS "case", count(*) // 2 AS want FROM documents GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY h, path) AS k FROM u), f AS (SELECT *, count(*) OVER (PARTITION BY "case") AS n FROM r WHERE k <= 3),
  s("case", path, k, quota, got) AS (SELECT "case", '', 0::BIGINT, 0::BIGINT, 0::BIGINT FROM want UNION ALL
    SELECT f."case", f.path, f.k, least(greatest(ceil((want - got) / (n - s.k)), 0), c)::BIGINT, (got + least(greatest(ceil((want - got) / (n - s.k)), 0), c))::BIGINT FROM s JOIN f ON f."case" = s."case" AND f.k = s.k + 1 JOIN want ON want."case" = f."case")
  SELECT "case", path, quota FROM s WHERE k > 0""")
def spread_quotas(spark, d):
    """Half of each source's documents, shared out over three of its languages; what one lacks the next give."""
    docs = read(spark, d, "documents")
    usable = docs.groupBy(F.col("source").alias("case"), F.col("lang").alias("path")).agg(F.count("*").alias("c"))
    return U.shared_out(usable, docs.groupBy(F.col("source").alias("case")).agg(F.floor(F.count("*") / 2).alias("want")), 3)


HORIZONS, HISTORY = [1, 3], 3


def _steps(spark, d):
    """Users as persons, twelve events as a file, an error as a step that isn't valid."""
    return samples(spark, d).select(F.col("rec_id").alias("person"), F.col("sample_idx").alias("idx"), F.floor(F.col("sample_idx") / 12).cast("bigint").alias("file"), F.array(F.col("value") / 500).alias("z"), (F.col("channel") != "error").alias("valid"))


@query(f"""WITH {_SAMPLES}, s AS (SELECT rec_id AS person, sample_idx AS idx, sample_idx // 12 AS file, value / 500 AS z, channel <> 'error' AS valid FROM samples),
  r AS (SELECT s.person, s.z AS x, a.z - s.z AS y1, b.z - s.z AS y3, a.valid AS m1, b.valid AS m3, CASE WHEN s.idx < 30 THEN 'early' ELSE 'late' END AS part FROM s JOIN s a ON a.person = s.person AND a.idx = s.idx + 1 AND a.file = s.file JOIN s b ON b.person = s.person AND b.idx = s.idx + 3 AND b.file = s.file
  JOIN s c ON c.person = s.person AND c.idx = s.idx - 2 AND c.file = s.file WHERE s.valid), t AS (SELECT person, part, 0 AS h, x, y1 AS y FROM r WHERE m1 UNION ALL SELECT person, part, 1, x, y3 FROM r WHERE m3),
  p AS (SELECT person, part, h, unnest([{{'i': 0, 'j': 0, 'v': 1.0}}, {{'i': 0, 'j': 1, 'v': x}}, {{'i': 1, 'j': 0, 'v': x}}, {{'i': 1, 'j': 1, 'v': x * x}}, {{'i': 0, 'j': 2, 'v': y}}, {{'i': 1, 'j': 2, 'v': x * y}}, {{'i': 2, 'j': 2, 'v': y * y}}]) AS e FROM t)
  SELECT person, part, h, e.i AS i, e.j AS j, round(sum(e.v), 6) + 0.0 AS v FROM p GROUP BY ALL""")
def horizon_sums(spark, d):
    """Sums of products of inputs and of what changes one and three steps on, by person and part."""
    rows = N.horizon_rows(_steps(spark, d), HORIZONS, HISTORY).withColumn("part", F.when(F.col("idx") < 30, "early").otherwise("late"))
    return rounded(N.masked_sums(rows, empty=False), "person", "part", "h", "i", "j", digits=6)


@query(None)
def horizon_skill(spark, d):
    """Skill one and three steps on, of each person's own readout and of everyone's, with penalties chosen on held-out files."""
    rows = N.halves(written(N.horizon_rows(_steps(spark, d), HORIZONS, HISTORY), "horizon-rows"), HORIZONS, HISTORY, val_share=0.3)
    out = N.forecast_skills(rows, HORIZONS)
    return out.select("person", "alpha", F.round("val_skill", 6).alias("val_skill"), F.round("skill", 6).alias("skill"), "pooled_alpha", F.round("pooled_skill", 6).alias("pooled_skill"))


AXES = {"f_high": [4, 6], "k_high": [1, 2, 3], "f_low": [1, 2], "k_low": [1, 2, 3], "dt_short": [0.08, 0.12], "k_short": [1, 2]}


@query(None)
def denoise_rules(spark, d):
    """Median gain of 144 rules on recordings with a burst of 6 Hz over every third stretch of eight samples."""
    s = samples(spark, d)
    burst = F.when(F.floor(F.col("sample_idx") / 8) % 3 == 0, 400 * F.cos(2 * F.pi() * 6 * F.col("sample_idx") / 16)).otherwise(0.0)
    held = written(s.select("rec_id", "sample_idx", "value", burst.alias("artifact")).withColumn("value", F.col("value") + F.col("artifact")), "held")
    framed = E.frames(held, 16, 8).groupBy("rec_id", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]).alias("w"))
    found = written(atoms_of(framed, 16, 16.0, 3, True, ("rec_id", "frame")), "atoms")
    waves = Z.set_waves(found, E.robust_sigma(held, "rec_id", "value"), AXES, 16, 8)
    scores = Z.rule_scores(waves, held.select("rec_id", "sample_idx", F.col("artifact").alias("value")), AXES)
    return Z.best_rule(scores, AXES).withColumn("gain_db", F.round("gain_db", 4))


@query(None)
def projected_windows(spark, d):
    """Windows of sixteen samples as eight random projections each, from blocks of six samples."""
    out = G.projected(samples(spark, d), 16, 8, seed=1, block=6)
    return out.select("rec_id", "window", F.transform("x", lambda v: F.round(v, 6) + 0.0).alias("x"))


DAYS = 2 * 86_400_000


@query(f"""WITH e AS (SELECT user_id AS rec_id, epoch_us(ts) // 1000 AS ms, value FROM events), w AS (SELECT rec_id, ms // {DAYS} * {DAYS} AS start_ms, count(*) AS n, (max(ms) - min(ms))::DOUBLE AS span_ms, avg(value) AS mean, stddev_pop(value) AS sd FROM e GROUP BY 1, 2),
  g AS (SELECT *, (start_ms - lag(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms)) // {DAYS} - 1 AS gap FROM w)
  SELECT rec_id, start_ms, 1::BIGINT AS windows, n, span_ms, round(mean, 7) + 0.0 AS mean, round(sd, 7) + 0.0 AS sd, CASE WHEN span_ms < 21600000 OR span_ms > 172800000 THEN 'packet_loss' END AS reason FROM g
  UNION ALL SELECT rec_id, start_ms - gap * {DAYS}, gap::BIGINT, 0, NULL, NULL, NULL, 'missing' FROM g WHERE gap > 0""")
def event_time_windows(spark, d):
    """Windows of two days of each user: those whose events span less than six hours are marked, runs of windows without events are one row."""
    rows = read(spark, d, "events").select(F.col("user_id").alias("rec_id"), "ts", "value")
    return rounded(T.timed_windows_of(rows, DAYS, (21_600_000.0, 172_800_000.0)), "rec_id", "start_ms", "windows", "n", "span_ms", "reason", digits=7)


@query("""SELECT vec_id, round(abs(embedding[1]::DOUBLE) * 64 / 64.0, 5) + 0.0 AS t_s, round(abs(embedding[2]::DOUBLE * 128) * 64 / 64.0, 5) + 0.0 AS f_hz, round(exp(embedding[3]::DOUBLE) / 64.0, 5) + 0.0 AS dur_s, round(2 * embedding[4]::DOUBLE * 64.0 * 64.0 / 64, 5) + 0.0 AS rate_hz_s FROM embeddings""")
def raw_atoms(spark, d):
    """The first four numbers of each vector as an atom in samples, in seconds and Hz."""
    at = lambda k: F.element_at("embedding", k).cast("double")
    raw = read(spark, d, "embeddings").select("vec_id", (F.abs(at(1)) * 64).alias("tc"), (at(2) * 128).alias("fc"), at(3).alias("log_dt"), at(4).alias("c"))
    return rounded(A.to_physical(raw, 64.0, 64).select("vec_id", "t_s", "f_hz", "dur_s", "rate_hz_s"), "vec_id", digits=5)


@query(None)
def pursuit_512(spark, d):
    """Six atoms, each with its own width right of the centre, of every window of 512 quantities of a supplier, taken as two seconds."""
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec_id"), "l_orderkey", "l_linenumber", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"), F.col("l_quantity").alias("value"))
    windows = E.epoch_table(ordered_index(lines, "rec_id", F.floor(F.col("l_orderkey") / 4096), "l_orderkey", "l_linenumber"), 512)
    signals = windows.select("rec_id", "epoch", E.normalised(F.col("w")).alias("w"))
    return rounded(atoms_of(signals, 512, 256.0, keys=("rec_id", "epoch"), asymmetric=True), "rec_id", "epoch", "atom_idx", digits=5)
