"""Corpora of EDF files with their annotations: clock annotations in blocks, and loaders that end in samples or labelled epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import ratio
from ..operators.epochs import mean_of, normalised, squares_of
from ..operators.selection import of_quality, resolved, subject_of, unmarked
from ..operators.signals import resampled
from ..scratch import written
from .edf import file_digests, load_edf
from .recordings import seizure_spans, verified

#: fixed values: the channels of the two montages, and what a channel is also called
REST_CHANNELS = ("Fp1", "Fp2", "F3", "F4", "F7", "F8", "T3", "T4", "C3", "C4", "T5", "T6", "P3", "P4", "O1", "O2", "Fz", "Cz", "Pz")
BIPOLAR = ("FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4", "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8", "P8-O2", "FZ-CZ", "CZ-PZ")
ALSO = {"T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6", "T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
#: fixed value: a case that is another case's person
SAME_PERSON = {"chb21": "chb01"}
#: fixed values: spans longer than this are taken for slips; a channel that varies less is flat; what follows the last larger sample is padding
LONGEST_S, FLAT, PADDING = 1200.0, 1e-3, 0.05

_BLOCK = r"(?im)^[ \t]*Seizure\s+n\s*\d+\b.*$"
_FILE = r"(?i)File name:\s*(\S+?\.edf)"
_REGISTRATION = r"(?i)Registration start time:\s*([\d.:]+)"
_CLOCK = r"(?im)^[ \t]*(?:Seizure\s+)?{} time:\s*([\d.:]+)"


def _clock(text: Column) -> Column:
    """Seconds of ``h.m.s`` or ``h:m:s``; null with fewer than three numbers."""
    part = F.filter(F.split(text, "[.:]"), lambda p: p != "")
    number = lambda k: F.get(part, F.lit(k)).try_cast("bigint")
    return number(0) * 3600 + number(1) * 60 + number(2)


def annotated_spans(texts: DataFrame) -> DataFrame:
    """Annotation texts (``doc, text``) to ``doc, file, k, start_s, end_s``, in seconds from the start of the file's registration.

    A text is a preamble and blocks, each under a line ``Seizure n 1`` with or without
    a colon or remark. File and registration stand in every block, in some, or in the
    preamble alone: a file holds until the next one is named, and its registration
    until it has another. Times may lack the word Seizure, have dots or colons, and
    lie past midnight. A block without a file, a registration or two times has no
    span, and spans of more than ``LONGEST_S`` are slips. ``k`` counts a file's spans.
    """
    found = lambda pattern: F.nullif(F.regexp_extract("block", pattern, 1), F.lit(""))
    blocks = texts.select("doc", F.posexplode(F.split("text", _BLOCK)).alias("at", "block"))
    told = blocks.select("doc", "at", found(_FILE).alias("file"), _clock(found(_REGISTRATION)).alias("reg"), _clock(found(_CLOCK.format("start"))).alias("s"), _clock(found(_CLOCK.format("end"))).alias("e"))
    held = told.withColumn("file", F.last("file", True).over(Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    known = held.withColumn("reg", F.last("reg", True).over(Window.partitionBy("doc", "file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    spans = known.where("at > 0 and file is not null and reg is not null and s is not null and e is not null")
    start = F.col("s") - F.col("reg") + F.when(F.col("s") < F.col("reg"), 86400).otherwise(0)
    end = F.col("e") - F.col("reg") + F.when(F.col("s") < F.col("reg"), 86400).otherwise(0)
    spans = spans.select("doc", "file", "at", start.alias("s"), F.when(end < start, end + 86400).otherwise(end).alias("e")).where(F.col("e") - F.col("s") <= LONGEST_S)
    k = F.row_number().over(Window.partitionBy("doc", "file").orderBy("at"))
    return spans.select("doc", "file", k.alias("k"), F.col("s").cast("double").alias("start_s"), F.col("e").cast("double").alias("end_s"))


def _named(path: Column) -> dict[str, Column]:
    """Folder and name of a file."""
    return {"case": F.element_at(F.split(path, "/"), -2), "file": F.element_at(F.split(path, "/"), -1)}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc, text`` of whole texts; the folder is the doc."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("doc"), F.col("value").alias("text"))


def whole_files(rows: DataFrame, channels) -> DataFrame:
    """Rows of the channels, of files that have all of them."""
    wanted = rows.where(F.col("channel").isin(*channels))
    full = wanted.groupBy("path").agg(F.countDistinct("channel").alias("n")).where(F.col("n") == len(channels)).select("path")
    return wanted.join(full, "path", "left_semi")


def bipolar(rows: DataFrame, pairs=BIPOLAR) -> DataFrame:
    """Rows of single electrodes to rows of pairs (``anode-cathode``), of files that have all of them.

    An electrode's name is its label without ``EEG``, in capitals, or what it is also
    called. Stretches of a file's electrodes stand alike, so a pair is their difference
    stretch by stretch; the shorter one counts.
    """
    names = sorted({n for p in pairs for n in p.split("-")})
    spoken = F.upper(F.trim(F.regexp_replace("channel", "EEG", "")))
    known = sorted({*names, *(ALSO[n] for n in names if n in ALSO)})
    wide = rows.where(spoken.isin(*known)).groupBy("path", "fs", "start").agg(*[F.max_by("values", F.when(spoken == n, F.col("channel"))).alias(f"v_{n}") for n in known])
    leg = lambda n: F.coalesce(F.col(f"v_{n}"), F.col(f"v_{ALSO[n]}")) if n in ALSO else F.col(f"v_{n}")

    def difference(pair: str) -> Column:
        a, b = (leg(n) for n in pair.split("-"))
        n = F.least(F.size(a), F.size(b))
        return F.struct(F.lit(pair).alias("channel"), F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x - y).alias("values"))

    long = wide.select("path", "fs", "start", F.explode(F.array(*[difference(p) for p in pairs])).alias("d"))
    return whole_files(long.where("d.values is not null").select("path", "d.channel", "fs", "start", "d.values"), pairs)


def as_samples(rows: DataFrame) -> DataFrame:
    """``path, channel, sample_idx, value`` of rows with arrays."""
    return rows.select("path", "channel", "start", F.posexplode("values").alias("i", "value")).select("path", "channel", (F.col("start") + F.col("i")).alias("sample_idx"), "value")


def at_rate(rows: DataFrame, fs: float, size: int = 4096) -> DataFrame:
    """``path, channel, fs, start, values`` at the rate ``fs``; rates of the files are few, and each is changed by its own ratio."""
    rates = [r["fs"] for r in rows.select("fs").distinct().collect()]
    parts = rows.where(F.abs(F.col("fs") - fs) <= 1e-9).select("path", "channel", "start", "values")
    for rate in (r for r in rates if abs(r - fs) > 1e-9):
        held = as_samples(rows.where(F.col("fs") == rate)).select(F.struct("path", "channel").alias("series"), "sample_idx", "value")
        done = resampled(held, *ratio(fs, rate), key="series", size=size)
        k = F.floor(F.col("sample_idx") / size)
        blocks = done.groupBy("series", k.alias("k")).agg(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s"))
        parts = parts.unionByName(blocks.select("series.path", "series.channel", (F.col("k") * size).alias("start"), F.transform("s", lambda r: r["value"]).alias("values")))
    return parts.withColumn("fs", F.lit(float(fs)))


def load_runs(spark: SparkSession, root: str, channels=REST_CHANNELS, fs: float = 256.0, good_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs ``<subject>_1.edf`` (label 0) and ``_2`` (1): ``rec_id, subject, label, channel, sample_idx, ms, value``, and what was left out (``path, reason``).

    What follows the last sample that is large in any channel is padding and goes;
    then the rate is changed. ``good_only`` keeps subjects whose last cell in
    ``subject-info.csv`` is 1.
    """
    labels = [f"EEG {c}" for c in channels]
    rows = load_edf(spark, root, channels=labels)
    files = rows.select("path", "error").distinct()
    full = written(whole_files(rows.where("error is null"), labels), "runs")
    alive = full.select("path", "start", F.posexplode("values").alias("i", "v")).where(F.abs("v") > PADDING).groupBy("path").agg(F.max(F.col("start") + F.col("i")).alias("last"))
    cut = full.join(alive, "path").where("start <= last").withColumn("values", F.expr("slice(values, 1, cast(least(last - start + 1, size(values)) as int))"))
    left = full.select("path").distinct().join(alive, "path", "left_anti").withColumn("reason", F.lit("nothing but padding"))
    lost = files.join(full.select("path").distinct(), "path", "left_anti").select("path", F.coalesce("error", F.lit("a channel is missing")).alias("reason")).unionByName(left)
    held = as_samples(at_rate(cut, fs))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    told = held.select(name.alias("rec_id"), subject_of(name).alias("subject"), F.regexp_extract(name, r"_(\d+)$", 1).alias("run"), F.regexp_replace("channel", "^EEG ", "").alias("channel"), "sample_idx", (F.col("sample_idx") * (1000.0 / fs)).alias("ms"), "value")
    told = told.where("run in ('1', '2')").withColumn("label", F.col("run").cast("int") - 1).drop("run")
    if good_only:
        cells = F.split("value", ",")
        marks = spark.read.text(f"{root}/subject-info.csv").select(F.get(cells, F.lit(0)).alias("subject"), F.trim(F.element_at(cells, -1)).try_cast("int").alias("quality"))
        told = of_quality(told, marks, "subject", "quality")
    return told, lost


def cut_windows(rows: DataFrame, windows: DataFrame, width: int, bucket: int = 1 << 14) -> DataFrame:
    """``windows`` (``path, at`` and others; ``width`` samples from ``at``) with ``channel`` and ``w``, for each channel of the file that has all of them.

    Windows and rows meet in stretches of ``bucket`` samples, a pair in the first one
    that both touch: a file with very many windows is spread over its stretches.
    """
    b = lambda c: F.floor(c / bucket).cast("bigint")
    w = windows.withColumn("_b", F.explode(F.sequence(b(F.col("at")), b(F.col("at") + width - 1))))
    r = rows.select("path", "channel", "start", "values").where(F.size("values") > 0)
    r = r.withColumn("_b", F.explode(F.sequence(b(F.col("start")), b(F.col("start") + F.size("values") - 1))))
    low, high = F.greatest("at", "start"), F.least(F.col("at") + width, F.col("start") + F.size("values"))
    met = w.join(r, ["path", "_b"]).where((low < high) & (b(low) == F.col("_b")))
    piece = F.slice("values", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    keys = [*windows.columns, "channel"]
    out = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(low.alias("low"), piece.alias("piece")))).alias("s"))
    return out.select(*keys, F.flatten(F.transform("s", lambda x: x["piece"])).alias("w")).where(F.size("w") == width)


def epochs_of(rows: DataFrame, windows: DataFrame, width: int, n_channels: int) -> DataFrame:
    """Windows that pass in all channels, a row a channel: the others with ``w`` (mean removed, unit length), ``log_rms, log_linelength``.

    A window passes if all channels are there, finite, and not flat. Windows aren't
    gated by size: the events sought are large themselves.
    """
    raw = cut_windows(rows, windows, width)
    w = F.col("w")
    sd = F.sqrt(squares_of(w) / F.size(w))
    steps = mean_of(F.zip_with(F.slice(w, 2, width - 1), F.slice(w, 1, width - 1), lambda b, a: F.abs(b - a)))
    bad = F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    told = raw.withColumns({"sd": sd, "steps": steps, "unit": normalised(w)})
    ok = ~bad & (F.col("sd") >= FLAT) & F.col("unit").isNotNull()
    shown = F.struct("channel", F.col("unit").alias("w"), F.log(F.col("sd") + 1e-6).alias("log_rms"), F.log(F.col("steps") + 1e-6).alias("log_linelength"))
    whole = told.groupBy(*windows.columns).agg(F.count(F.when(ok, 1)).alias("_n"), F.collect_list(shown).alias("c")).where(F.col("_n") == n_channels)
    return whole.select(*windows.columns, F.inline("c"))


def shared_out(usable: DataFrame, wanted: DataFrame, most_files: int) -> DataFrame:
    """``case, path, quota``: how many of its usable windows (``case, path, c``) each file gives so that a case gives ``want``.

    Files come in the order of a hash of their names, ``most_files`` of a case at
    most; each is asked for an equal share of what is still missing, and what one
    lacks the next ones give.
    """
    order = F.struct(F.md5(F.element_at(F.split("path", "/"), -1)).alias("h"), "path", "c")
    lists = usable.groupBy("case").agg(F.slice(F.sort_array(F.collect_list(order)), 1, most_files).alias("f")).join(wanted, "case")
    n = F.size("f")
    begin = F.struct(F.lit(0).cast("bigint").alias("got"), F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("q"))

    def step(acc: Column, f: Column) -> Column:
        quota = F.least(F.greatest(F.ceil((F.col("want") - acc["got"]) / (n - acc["k"])), F.lit(0)), f["c"]).cast("bigint")
        return F.struct((acc["got"] + quota).alias("got"), (acc["k"] + 1).alias("k"), F.concat(acc["q"], F.array(quota)).alias("q"))

    given = lists.withColumn("q", F.aggregate("f", begin, step)["q"])
    return given.select("case", F.explode(F.arrays_zip("f", "q")).alias("z")).select("case", "z.f.path", F.col("z.q").alias("quota"))


def _inside(spans: DataFrame, fs: float, width: int) -> DataFrame:
    """Windows that lie wholly inside spans (``case, path, start_s, end_s``): ``case, path, at, label`` 1."""
    a, b = F.round(F.col("start_s") * fs).cast("bigint"), F.round(F.col("end_s") * fs).cast("bigint")
    n = F.floor((b - a) / width)
    return spans.where((n >= 1) & (a >= 0)).select("case", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))).alias("k"), a.alias("a")).select("case", "path", (F.col("a") + F.col("k") * width).alias("at"), F.lit(1).alias("label")).distinct()


def _grid(rows: DataFrame, width: int) -> DataFrame:
    """``case, path, at, label`` 0: windows side by side from a file's start, without the one that may end with it."""
    ends = rows.groupBy("path").agg(F.max(F.col("start") + F.size("values")).alias("n")).where(F.col("n") > width)
    return ends.select(_named(F.col("path"))["case"].alias("case"), "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - width - 1, F.lit(width).cast("bigint"))).alias("at"), F.lit(0).alias("label"))


def _balanced(rows: DataFrame, inside: DataFrame, outside: DataFrame, width: int, n_channels: int, share: float, most_files: int) -> DataFrame:
    """Epochs of all windows ``inside``, and of ``share`` times as many of each case's ``outside``, spread over its files."""
    yes = written(epochs_of(rows, inside, width, n_channels), "inside")
    no = written(epochs_of(rows, outside, width, n_channels), "outside")
    one = lambda df: df.select("case", "path", "at").distinct()
    want = one(yes).groupBy("case").agg(F.round(F.count("*") * share).cast("bigint").alias("want"))
    quota = shared_out(one(no).groupBy("case", "path").agg(F.count("*").alias("c")), want, most_files)
    drawn = Window.partitionBy("path").orderBy(F.md5(F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.col("at").cast("string"))), "at")  # a file's windows
    kept = one(no).join(quota, ["case", "path"]).withColumn("_r", F.row_number().over(drawn)).where("_r <= quota").select("path", "at")
    return yes.unionByName(no.join(kept, ["path", "at"], "left_semi"))


def load_marked(spark: SparkSession, root: str, width: int = 512, share: float = 1.0, most_files: int = 12, channels=BIPOLAR, fs: float = 256.0, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cases of files with summaries in seconds: labelled epochs (``case, subject, path, at, label, channel, w, log_rms, log_linelength``), and files left out (``path, reason``).

    Label 1: windows wholly inside a seizure. Label 0: as many, times ``share``, of
    each case's files without one (also none in ``RECORDS-WITH-SEIZURES``). With
    ``verify`` a file counts only if ``SHA256SUMS.txt`` has its digest.
    """
    named = _named(F.col("path"))
    rows = load_edf(spark, root, channels=channels)
    files = rows.select("path", "error").distinct()
    good = whole_files(rows.where(F.col("error").isNull() & (F.abs(F.col("fs") - fs) < 1e-9)), channels)
    lost = files.join(good.select("path").distinct(), "path", "left_anti").select("path", F.coalesce("error", F.lit("a channel is missing")).alias("reason"))
    if verify:
        sums = spark.read.text(f"{root}/SHA256SUMS.txt").select(F.split(F.trim("value"), r"\s+\*?", 2).alias("p")).select(F.col("p")[1].alias("name"), F.col("p")[0].alias("sha256"))
        right = verified(file_digests(spark, root).withColumn("name", F.concat_ws("/", named["case"], named["file"])), sums).select("path")
        lost = lost.unionByName(good.select("path").distinct().join(right, "path", "left_anti").withColumn("reason", F.lit("its digest is another one")))
        good = good.join(right, "path", "left_semi")
    rows = written(good, "marked")
    lines = read_texts(spark, f"{root}/*/*-summary.txt").select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    spans = seizure_spans(lines).where("start_s is not null").select(F.col("doc").alias("case"), "file", "start_s", "end_s")
    there = rows.select("path", named["case"].alias("case"), named["file"].alias("file")).distinct()
    try:
        listed = spark.read.text(f"{root}/RECORDS-WITH-SEIZURES").select(F.element_at(F.split(F.trim("value"), "/"), -1).alias("file")).where("file <> ''")
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        listed = spans.select("file")
    free = unmarked(there, "file", spans.select("file"), listed).select("path")
    epochs = _balanced(rows, _inside(spans.join(there, ["case", "file"]), fs, width), _grid(rows.join(free, "path", "left_semi"), width), width, len(channels), share, most_files)
    return epochs.withColumn("subject", subject_of(F.concat("case", F.lit("_")), SAME_PERSON)), lost


def load_clocked(spark: SparkSession, root: str, width: int = 512, share: float = 1.0, most_files: int = 12, pairs=BIPOLAR, fs: float = 256.0, guard_s: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """Cases of files with clock annotations and single electrodes: as ``load_marked``.

    Pairs are made and the rate is changed first. Label 0 comes from the same files,
    at least ``guard_s`` from any seizure of the file that a name means.
    """
    named = _named(F.col("path"))
    rows = load_edf(spark, root)
    pairs_of = bipolar(rows.where("error is null"), pairs)
    lost = rows.select("path", "error").distinct().join(pairs_of.select("path").distinct(), "path", "left_anti").select("path", F.coalesce("error", F.lit("a pair is missing")).alias("reason"))
    rows = written(at_rate(pairs_of, fs), "clocked")
    on_disk = load_edf(spark, root).select(named["case"].alias("case"), named["file"].alias("file")).distinct()
    told = annotated_spans(read_texts(spark, f"{root}/*/Seizures-list-*.txt")).select(F.col("doc").alias("case"), F.col("file").alias("name"), "start_s", "end_s")
    spans = written(told.join(resolved(told, on_disk, "case").where("file is not null"), ["case", "name"]), "spans")
    there = rows.select("path", named["case"].alias("case"), named["file"].alias("file")).distinct()
    marked = spans.join(there, ["case", "file"]).select("case", "path", "start_s", "end_s")
    t = F.col("at") / fs
    near = _grid(rows, width).join(marked.select("path", "start_s", "end_s"), "path").where(~((t + width / fs < F.col("start_s") - guard_s) | (t > F.col("end_s") + guard_s))).select("path", "at").distinct()
    outside = _grid(rows, width).join(near, ["path", "at"], "left_anti")
    epochs = _balanced(rows, _inside(marked, fs, width), outside, width, len(pairs), share, most_files)
    return epochs.withColumn("subject", F.col("case")), lost
