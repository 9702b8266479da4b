"""Atoms to features: physical units, 13 channel statistics, 18 cross-channel ones, artifact rules."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BANDS, COINCIDENCE_S, ENERGY_FLOOR, FREQ_TOL_HZ, MIN_CYCLES, OSC_HIGH, OSC_LOW

CHANNEL = ["epoch_id", "ch_idx"]


def oscillatory(epoch_s: float) -> Column:
    """Half a cycle or more, 0.5 to 40 Hz (both closed), not longer than the epoch, sweep not above the frequency."""
    f, dur = F.col("f_hz"), F.col("dur_s")
    return (f * dur >= MIN_CYCLES) & (f >= OSC_LOW) & (f <= OSC_HIGH) & (dur <= epoch_s) & (F.abs(F.col("rate_hz_s") * dur) <= F.greatest(f, F.lit(1e-9)))


def band_of(f: Column) -> Column:
    """Index of the half-open band, -1 outside all."""
    out = F.lit(-1)
    for i, (low, high) in reversed(list(enumerate(BANDS.values()))):
        out = F.when((f >= low) & (f < high), i).otherwise(out)
    return out


def to_physical(raw: DataFrame, fs: float, n: int) -> DataFrame:
    """Sample-domain atoms (``tc, fc, log_dt, c``) in seconds and Hz; the chirp rate is 2 c fs^2 / n."""
    return raw.withColumns({"t_s": F.col("tc") / fs, "f_hz": F.abs("fc") * fs / n, "dur_s": F.exp("log_dt") / fs, "rate_hz_s": 2 * F.col("c") * fs * fs / n})


def channel_features(atoms: DataFrame, epoch_s: float, residual: DataFrame | None = None) -> DataFrame:
    """The statistics of each channel-epoch, energy weighted; all zero where there is no energy.

    The deviation takes a second pass around the mean: one more aggregation over
    the same key, without a shuffle of its own.
    """
    held = atoms.withColumns({"osc": oscillatory(epoch_s), "w": F.when(oscillatory(epoch_s), F.col("energy")).otherwise(0.0), "sweep": F.col("rate_hz_s") * F.col("dur_s")})
    weighted = lambda x: F.when(F.sum("w") > ENERGY_FLOOR, F.sum(F.col("w") * x) / F.sum("w")).otherwise(0.0)
    live = F.sum("energy") > ENERGY_FLOOR
    share = lambda where: F.when(live, F.sum(F.when(where, F.col("energy")).otherwise(0.0)) / F.sum("energy")).otherwise(0.0)
    bands = {f"frac_{b}": share(F.col("osc") & (F.col("f_hz") >= lo) & (F.col("f_hz") < hi)) for b, (lo, hi) in BANDS.items()}
    first = held.groupBy(CHANNEL).agg(
        *[c.alias(n) for n, c in bands.items()], share(F.col("osc")).alias("osc_frac"), F.when(live, 1 - share(F.col("osc"))).otherwise(0.0).alias("transient_frac"),
        weighted(F.col("f_hz")).alias("mean_fc_hz"), weighted(F.abs("sweep")).alias("mean_abs_sweep_hz"), weighted(F.col("sweep")).alias("mean_signed_sweep_hz"), weighted(F.col("dur_s")).alias("mean_dur_s"),
    )
    second = held.join(first.select(*CHANNEL, "mean_fc_hz"), CHANNEL).groupBy(CHANNEL).agg(F.sqrt(weighted((F.col("f_hz") - F.col("mean_fc_hz")) * (F.col("f_hz") - F.col("mean_fc_hz")))).alias("std_fc_hz"))
    out = first.join(second, CHANNEL)
    return out if residual is None else out.join(residual, CHANNEL, "left")


def feature_rows(atoms: DataFrame, epoch_s: float) -> DataFrame:
    """One row a channel-epoch: the 13 statistics (with how many atoms and the residual's share) and its epoch's 18.

    Atoms that another step wrote (``sources.sinks.save_missing``) can be read and given again.
    """
    rest = atoms.groupBy(CHANNEL).agg(F.count("*").alias("n_atoms"), F.max("recon_err").alias("recon_err"))
    return channel_features(atoms, epoch_s, rest).join(cross_features(atoms), "epoch_id")


def channel_energy(atoms: DataFrame) -> DataFrame:
    e = F.col("energy")
    in_band = lambda lo, hi: (F.col("f_hz") >= lo) & (F.col("f_hz") < hi)
    return atoms.groupBy(CHANNEL).agg(
        F.sum(e).alias("e"), F.sum(e * F.col("f_hz")).alias("ef"), F.sum(e * F.col("rate_hz_s")).alias("er"), F.max_by("f_hz", F.struct(e, -F.col("atom_idx"))).alias("f_top"),
        *[F.sum(F.when(in_band(lo, hi), e).otherwise(0.0)).alias(f"p_{b}") for b, (lo, hi) in BANDS.items()],
        *[F.sum(F.when(in_band(lo, hi), e * F.col("t_s")).otherwise(0.0)).alias(f"pt_{b}") for b, (lo, hi) in BANDS.items()],
    )


def cross_features(atoms: DataFrame) -> DataFrame:
    """The 18 cross-channel statistics of each epoch; all zero where there is no energy.

    An epoch's channels are few, so pairs are formed inside an array of its
    channel summaries: atoms are aggregated once by channel and once by epoch.
    """
    by_channel = channel_energy(atoms)
    tops = atoms.groupBy("epoch_id").agg(F.max_by(F.struct("t_s", "f_hz"), F.struct("energy", -F.col("ch_idx"), -F.col("atom_idx"))).alias("top"))
    near = atoms.join(tops, "epoch_id").where((F.abs(F.col("f_hz") - F.col("top.f_hz")) <= FREQ_TOL_HZ) & (F.abs(F.col("t_s") - F.col("top.t_s")) <= COINCIDENCE_S) & (F.col("energy") > 0))
    recruited = near.groupBy("epoch_id").agg(F.countDistinct("ch_idx").alias("recruited"))
    norm = F.greatest(F.sqrt(sum((F.col(f"p_{b}") * F.col(f"p_{b}") for b in BANDS), F.lit(0.0))), F.lit(1e-12))
    rows = by_channel.select("epoch_id", F.struct("ch_idx", "e", (F.col("ef") / F.greatest("e", F.lit(1e-30))).alias("f"), (F.col("er") / F.greatest("e", F.lit(1e-30))).alias("r"), "f_top", F.array(*[F.col(f"p_{b}") / norm for b in BANDS]).alias("p"), F.array(*[F.when(F.col(f"p_{b}") > ENERGY_FLOOR, F.col(f"pt_{b}") / F.col(f"p_{b}")) for b in BANDS]).alias("t")).alias("c"))
    e = rows.groupBy("epoch_id").agg(F.sort_array(F.collect_list("c")).alias("cs")).join(tops, "epoch_id").join(recruited, "epoch_id", "left")
    total = lambda a, fn: F.aggregate(a, F.lit(0.0), lambda s, x: s + fn(x))
    pairs = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b["ch_idx"] > a["ch_idx"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    e = e.withColumn("pairs", pairs).withColumns({"n": F.size("cs"), "n_pairs": F.greatest(F.size("pairs"), F.lit(1)), "tot": total(F.col("cs"), lambda c: c["e"])})
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    gap = lambda p, i: F.abs(F.get(p["a"]["t"], F.lit(i)) - F.get(p["b"]["t"], F.lit(i)))
    out = {"energy_participation": F.col("tot") * F.col("tot") / (F.col("n") * F.greatest(total(F.col("cs"), lambda c: c["e"] * c["e"]), F.lit(1e-30)))}
    entropy = total(F.col("cs"), lambda c: F.when(c["e"] > 0, -(c["e"] / F.col("tot")) * F.log(c["e"] / F.col("tot"))).otherwise(0.0))
    out["energy_entropy"] = F.when(F.col("n") > 1, entropy / F.log(F.col("n"))).otherwise(0.0)
    out["profile_coherence"] = total(F.col("pairs"), lambda p: dot(p["a"]["p"], p["b"]["p"])) / F.col("n_pairs")

    def together(i: int) -> tuple[Column, Column]:
        some = F.filter("pairs", lambda p: F.coalesce(gap(p, i) <= COINCIDENCE_S, F.lit(False)))
        return F.size(some) / F.col("n_pairs"), total(some, lambda p: gap(p, i)) / F.greatest(F.size(some), F.lit(1))

    for i, b in enumerate(BANDS):
        out[f"cooccur_{b}"], out[f"lag_{b}"] = together(i)
    out["recruitment"] = F.coalesce("recruited", F.lit(0)) / F.col("n")
    mean_f = total(F.col("cs"), lambda c: c["f"]) / F.col("n")
    out["freq_disagreement"] = total(F.col("pairs"), lambda p: F.abs(p["a"]["f"] - p["b"]["f"])) / F.col("n_pairs")
    out["freq_spread"] = F.sqrt(total(F.col("cs"), lambda c: (c["f"] - mean_f) * (c["f"] - mean_f)) / F.col("n"))
    out["sweep_disagreement"] = total(F.col("pairs"), lambda p: F.abs(p["a"]["r"] - p["b"]["r"])) / F.col("n_pairs")
    out["top_band_agreement"] = F.size(F.filter("cs", lambda c: band_of(c["f_top"]) == band_of(F.col("top.f_hz")))) / F.col("n")
    return e.select("epoch_id", *[F.when(F.col("tot") > ENERGY_FLOOR, c).otherwise(0.0).alias(n) for n, c in out.items()])


def artifact_flag(f: Column, dur: Column, amp: Column, sigma: Column, rule: Column) -> Column:
    """Line hum, high, slow or short atoms under a rule's thresholds."""
    line = ((F.abs(f - 60) < 3) | (F.abs(f - 50) < 3)) & (dur >= 0.1)
    high = (f - 1 / (2 * F.pi() * F.greatest(dur, F.lit(1e-6))) >= rule["f_high"]) & (amp >= rule["k_high"] * sigma)
    low = (f <= rule["f_low"]) & (amp >= rule["k_low"] * sigma)
    short = (dur <= rule["dt_short"]) & (amp >= rule["k_short"] * sigma)
    return line | high | low | short


#: pairs of thresholds that make up a rule, and values under which such a part meets nothing
_PARTS = (("f_high", "k_high"), ("f_low", "k_low"), ("dt_short", "k_short"))
_NEVER = {"f_high": float("inf"), "k_high": 1.0, "f_low": float("-inf"), "k_low": 1.0, "dt_short": float("-inf"), "k_short": 1.0}


def rule_grid(axes: dict[str, list]) -> tuple[list[dict], list[tuple[int, dict]]]:
    """The parts of all rules over ``axes``, and each rule with the bits of its three parts."""
    parts = [{a: x, b: y} for a, b in _PARTS for x in axes[a] for y in axes[b]]
    rules = [dict(zip(axes, values)) for values in itertools.product(*axes.values())]
    return parts, [(sum(1 << i for i, p in enumerate(parts) if p.items() <= rule.items()), rule) for rule in rules]


def parts_met(f: Column, dur: Column, amp: Column, sigma: Column, parts: list[dict]) -> Column:
    """Bits of the parts under which an atom is an artifact; line hum is one under all."""
    flag = lambda p: artifact_flag(f, dur, amp, sigma, F.struct(*[F.lit(float(v)).alias(n) for n, v in (_NEVER | p).items()]))
    return sum((F.when(flag(p), 1 << i).otherwise(0) for i, p in enumerate(parts)), F.lit(0))
