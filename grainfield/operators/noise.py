"""Noise statistics: patches, brightness bins, a variance model and dynamic range.

Patches are rows (at most `noise_max_patches` per frame and plane by the sampling grid, unless every patch is asked for),
measured in Arrow batches; for an estimate one frame's patches then meet in one group, whose size that grid bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Parameters
from .histogram import KEYS

#: The 75 % point of the normal distribution, and the variance of rounding.
NORMAL_MAD, QUANTIZATION = 0.6744897501960817, 1 / 12
#: Central rational approximation of the inverse normal distribution (numerator, denominator).
_INVERSE_NORMAL = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
)

MODEL = "struct<shot:double,read:double,source:string>"
ESTIMATE = (
    "dark_sigma double, light_sigma double, tail_samples int, patches_examined int, censored_patches int, weak_texture_patches int, shadow_signal double, highlight_signal double, "
    f"correlation_ratio double, model {MODEL}, resolved boolean, read_sigma_low double, read_sigma_high double, fit_error double, confidence string, "
    "bins array<struct<signal:double,sigma:double,patches:int>>, notes array<string>"
)


def normal_quantile(fraction: float) -> float:
    q = fraction - 0.5
    return float(np.polyval(_INVERSE_NORMAL[0], q * q) * q / np.polyval(_INVERSE_NORMAL[1], q * q))


def patches(samples: DataFrame, meta: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS, every: bool = False) -> DataFrame:
    """A row per patch of the sampling grid: `py, px, codes` in row order. `meta` has `width` and `height`. With `every`, patches
    lie side by side over the whole frame, however many there are."""
    side = p.noise_patch_side
    step = F.lit(side) if every else F.greatest(F.lit(side), F.ceil(F.sqrt(F.col("width") * F.col("height") / F.lit(float(p.noise_max_patches)))).cast("int"))
    at = samples.join(meta.select(*keys, "width", "height"), list(keys)).withColumn("step", step)
    y, x = F.col("y"), F.col("x")
    fits = (y % F.col("step") < side) & (x % F.col("step") < side) & (y - y % F.col("step") + side <= F.col("height")) & (x - x % F.col("step") + side <= F.col("width"))
    spot = at.where(fits).select(*keys, (y - y % F.col("step")).alias("py"), (x - x % F.col("step")).alias("px"), F.struct((y % F.col("step")).alias("r"), (x % F.col("step")).alias("c"), "code").alias("s"))
    got = spot.groupBy(*keys, "py", "px").agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") == side * side)
    return got.select(*keys, "py", "px", F.transform("s", lambda v: v["code"]).alias("codes"))


def measured(them: DataFrame, meta: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Patch rows with `signal`, `variance`, `correlation`, `texture`, `growth`; nulls where a sample is 0 or white."""
    side = p.noise_patch_side
    lags = (p.noise_haar_lag_small, p.noise_haar_lag_medium, p.noise_haar_lag_large)
    rows = them.join(meta.select(*keys, "black", "white"), list(keys))
    names = [*keys, "py", "px"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", signal double, variance double, correlation double, texture double, growth double"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(side) - (side - 1) / 2
        energy = side * side * (side * side - 1) / 12
        least = np.sqrt(QUANTIZATION)
        for f in frames:
            out = f[names].copy()
            v = np.array(f["codes"].tolist(), float).reshape(len(f), side, side)
            fine = ((v > 0) & (v < f["white"].to_numpy(float)[:, None, None])).all(axis=(1, 2))
            mean = v.mean(axis=(1, 2))
            bx, by = (v * place).sum(axis=(1, 2)) / energy, (v * place[:, None]).sum(axis=(1, 2)) / energy
            plane = mean[:, None, None] + bx[:, None, None] * place + by[:, None, None] * place[:, None]
            sigma = np.median(np.abs(v - plane).reshape(len(f), -1), axis=1) / NORMAL_MAD * np.sqrt(side * side / (side * side - 3)) if len(f) else mean
            haar = [np.median((np.abs(v[:, :-k, :-k] - v[:, :-k, k:] - v[:, k:, :-k] + v[:, k:, k:]) * 0.5).reshape(len(f), -1), axis=1) / NORMAL_MAD for k in lags] if len(f) else [mean] * 3
            cols = {
                "signal": np.maximum(0, mean - f["black"].to_numpy(float)), "variance": sigma**2, "correlation": sigma / np.maximum(haar[0], least),
                "texture": sigma / np.maximum(np.maximum(haar[1], haar[2]), least), "growth": haar[2] / np.maximum(haar[1], least),
            }
            for k, c in cols.items():
                out[k] = np.where(fine, c, np.nan)
            yield out

    got = rows.mapInPandas(batches, schema)
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("signal", "variance", "correlation", "texture", "growth")})


def _pct(x: np.ndarray, f: float) -> float:
    return float(np.quantile(x, f))


def _summary(signal: np.ndarray, variance: np.ndarray, model, p: Parameters) -> tuple[float, float, int]:
    """Median signal, noise from a low quantile of variances (which texture only raises), number of patches."""
    s = _pct(signal, 0.5)
    scale = lambda at: np.maximum(model[0] * np.maximum(at, 0) + model[1], QUANTIZATION) if model else np.ones_like(at)
    spread = np.sqrt(1.3605 / (p.noise_patch_side**2 - 3))
    point = -NORMAL_MAD if p.noise_variance_quantile == 0.25 else normal_quantile(p.noise_variance_quantile)
    v = _pct(variance / scale(signal), p.noise_variance_quantile) / (1 + point * spread) ** 2 * float(scale(np.array([s]))[0])
    return s, float(np.sqrt(v)), len(signal)


def fit_model(bins: list[tuple[float, float, int]], p: Parameters) -> tuple[tuple[float, float], float] | None:
    """Shot coefficient and read variance from bins, robustly, with the median relative error; None if unsupported."""
    s, y = np.array([b[0] for b in bins]), np.array([b[1] for b in bins]) ** 2
    if len(bins) < p.noise_fit_min_bins or (np.sqrt(y) < p.noise_min_sigma).any() or s[-1] - s[0] < p.noise_fit_min_span:
        return None
    span = s[-1] - s[0]
    i, j = np.triu_indices(len(s), 1)
    apart = s[j] - s[i] > p.noise_fit_pair_separation * span
    if not apart.any():
        return None
    a = _pct((y[j] - y[i])[apart] / (s[j] - s[i])[apart], 0.5)
    b = _pct(y - a * s, 0.5)
    floored = np.maximum(y, QUANTIZATION)
    for _ in range(p.noise_fit_iterations):
        off = np.abs((floored - (a * s + b)) / floored)
        w = (floored.min() / floored) ** 2 * p.noise_fit_residual_scale / np.maximum(off, p.noise_fit_residual_scale)
        x = s / span
        det = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
        if det <= np.finfo(float).eps:
            return None
        a = (w.sum() * (w * x * floored).sum() - (w * x).sum() * (w * floored).sum()) / det / span
        b = ((w * floored).sum() - a * span * (w * x).sum()) / w.sum()
    if a < 0:
        centre = _pct(y, 0.5)
        if -a * span > p.noise_fit_negative_slope * centre:
            return None
        a, b = 0.0, centre
    if not np.isfinite([a, b]).all() or b < QUANTIZATION:
        return None
    error = _pct(np.abs(y - (a * np.maximum(s, 0) + b)) / floored, 0.5)
    return ((float(a), float(b)), error) if error <= p.noise_fit_max_error else None


def estimate(signal, variance, correlation, texture, growth, profile: tuple[float, float] | None, constant: bool, p: Parameters = Parameters()) -> dict:
    """The noise estimate of one frame and plane from its patches (NaN: censored). `profile` is a recorded model in codes."""
    fine = ~np.isnan(signal)
    out: dict = {
        "dark_sigma": None, "light_sigma": None, "tail_samples": 0, "patches_examined": len(signal), "censored_patches": int((~fine).sum()), "weak_texture_patches": 0,
        "shadow_signal": None, "highlight_signal": None, "correlation_ratio": None, "model": (*profile, "recorded_profile") if profile else None, "resolved": profile is not None,
        "read_sigma_low": None, "read_sigma_high": None, "fit_error": None, "confidence": "moderate" if profile else "unavailable", "bins": [], "notes": [],
    }
    order = np.nonzero(fine)[0][np.argsort(signal[fine], kind="stable")]
    weak = order[(texture[order] <= p.noise_texture_max) & (growth[order] <= p.noise_lag_growth_max)]
    out["weak_texture_patches"] = len(weak)
    enough = len(weak) >= p.noise_min_patches
    use = weak if enough else order
    if len(use) < p.noise_min_patches:
        out["notes"].append("Too few uncensored patches for a noise estimate.")
        return out
    s, v = signal[use], variance[use]
    count = min(max(len(use) // p.noise_patches_per_bin, 1), p.noise_max_bins)
    size = -(-len(use) // count)
    parts = [slice(k, k + size) for k in range(0, len(use), size)]
    binned = lambda m: [_summary(s[k], v[k], m, p) for k in parts]
    bins, model = binned(None), profile
    if not profile and enough:
        for _ in range(p.noise_refinement_passes):
            got = fit_model(bins, p)
            model = got[0] if got else None
            bins = binned(model) if got else bins
        got = fit_model(bins, p)
        model = got[0] if got else None
        if got:
            out["fit_error"], out["model"] = got[1], (*model, "weak_texture_patches")
            left_out = [fit_model(bins[:k] + bins[k + 1 :], p) for k in range(len(bins))]
            reads = np.sqrt([m[0][1] for m in left_out if m])
            if len(reads) >= len(bins) * p.noise_fit_success_fraction:
                low, high = _pct(reads, p.noise_sensitivity_tail), _pct(reads, 1 - p.noise_sensitivity_tail)
                first, last = bins[0][0], bins[-1][0]
                near = first <= p.noise_extrapolation_fraction * (last - first) or first <= p.noise_shadow_read_sigmas * np.sqrt(model[1])
                out |= {"read_sigma_low": low, "read_sigma_high": high, "resolved": bool(high <= p.noise_read_ratio_max * low and near)}
    out["bins"] = bins
    tail = min(max(len(use) // p.noise_tail_divisor, p.noise_min_patches), len(use))
    dark, light = _summary(s[:tail], v[:tail], model, p), _summary(s[-tail:], v[-tail:], model, p)
    known = lambda x: x if x >= p.noise_min_sigma else None
    out |= {"dark_sigma": known(dark[1]), "light_sigma": known(light[1]), "tail_samples": tail, "shadow_signal": dark[0], "highlight_signal": light[0]}
    c = correlation[use][v >= p.noise_correlation_min_variance]
    out["correlation_ratio"] = _pct(c, 0.5) if len(c) else None
    out["confidence"] = "moderate" if out["resolved"] else "low" if out["dark_sigma"] is not None else "unavailable"
    if not out["resolved"]:
        out["notes"].append("Read noise is not resolved; dynamic range uses noise measured in shadows.")
    if not enough:
        out["notes"].append("Too few patches with weak texture; noise includes image structure.")
    if out["correlation_ratio"] is not None and out["correlation_ratio"] > p.noise_correlation_warning:
        out["notes"].append("Noise is correlated between neighbours.")
    if profile:
        ratio = _pct(np.array([b[1] / np.sqrt(max(profile[0] * max(b[0], 0) + profile[1], QUANTIZATION)) for b in bins]), 0.5)
        if not 1 / p.noise_profile_tolerance <= ratio <= p.noise_profile_tolerance:
            out["confidence"], out["resolved"] = "low", False
            out["notes"].append("The recorded profile disagrees with the measured noise.")
    if constant:
        out["confidence"] = "unavailable"
    return out


def estimates(samples: DataFrame, meta: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A noise estimate per key. `meta` has `width, height, black, white` and may have `profile array<double>` (shot and
    read coefficients for values 0..1)."""
    profiled = meta if "profile" in meta.columns else meta.withColumn("profile", F.lit(None).cast("array<double>"))
    ends = samples.groupBy(*keys).agg((F.min("code") == F.max("code")).alias("constant"))
    rows = measured(patches(samples, meta, p, keys), meta, p, keys).join(profiled.select(*keys, "profile", "black", "white").join(ends, list(keys)), list(keys), "right")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    names = list(keys)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["py", "px"])
        row = f.iloc[0]
        span = float(row["white"]) - float(row["black"])
        pr = row["profile"]
        profile = (float(pr[0]) * span, float(pr[1]) * span * span) if pr is not None else None
        real = f[f["py"].notna()]
        cols = [real[c].to_numpy(float) for c in ("signal", "variance", "correlation", "texture", "growth")]
        got = estimate(*cols, profile, bool(row["constant"]), p)
        got["model"] = None if got["model"] is None else dict(zip(("shot", "read", "source"), got["model"], strict=True))
        got["bins"] = [dict(zip(("signal", "sigma", "patches"), b, strict=True)) for b in got["bins"]]
        return pd.DataFrame([{n: row[n] for n in names} | got])

    return rows.groupBy(*keys).applyInPandas(one, f"{head}, {ESTIMATE}")


def as_struct() -> Column:
    """The columns of `estimates` as one struct, for `sigma_at` and the others below."""
    return F.struct("dark_sigma", "model", "resolved", "read_sigma_low", "read_sigma_high", "confidence", "bins")


NO_ESTIMATE = f"struct<dark_sigma:double,model:{MODEL},resolved:boolean,read_sigma_low:double,read_sigma_high:double,confidence:string,bins:array<struct<signal:double,sigma:double,patches:int>>>"


def no_noise() -> Column:
    return F.lit(None).cast(NO_ESTIMATE)


def variance_of(model: Column, signal: Column) -> Column:
    return model["shot"] * F.greatest(signal, F.lit(0.0)) + model["read"]


def sigma_at(noise: Column, signal: Column) -> Column:
    """Noise at a signal above black: the model's, else interpolated between bins (flat beyond them); null unknown."""
    model, bins = noise["model"], noise["bins"]
    usable = model.isNotNull() & ((model["source"] != "recorded_profile") | noise["resolved"])
    n = F.size(bins)
    above = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.get(bins, i)["signal"] >= signal))
    i = F.get(above, F.lit(0))
    a, b = F.get(bins, i - 1), F.get(bins, i)
    span = b["signal"] - a["signal"]
    t = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (signal - a["signal"]) / F.when(span > 0, span).otherwise(1.0)))).otherwise(0.0)
    between = F.sqrt(a["sigma"] * a["sigma"] * (1 - t) + b["sigma"] * b["sigma"] * t)
    by_bins = F.when(n > 0, F.when(i.isNull(), F.get(bins, n - 1)["sigma"]).otherwise(between))
    return F.when(usable, F.sqrt(F.greatest(variance_of(model, signal), F.lit(QUANTIZATION)))).otherwise(by_bins)


def model_signal_for_snr(model: Column, snr: float) -> Column:
    a = snr * snr * model["shot"]
    return 0.5 * a + 0.5 * F.hypot(a, 2.0 * snr * F.sqrt(model["read"]))


def signal_for_snr(noise: Column, snr: float, p: Parameters = Parameters()) -> Column:
    """The least signal with this ratio to noise, one code or more; null unknown."""
    modelled = F.greatest(model_signal_for_snr(noise["model"], snr), F.lit(1.0))
    shadow = F.when(noise["dark_sigma"] >= p.noise_min_sigma, F.greatest(F.lit(snr) * noise["dark_sigma"], F.lit(1.0)))
    return F.when(noise["resolved"] & noise["model"].isNotNull(), modelled).otherwise(shadow)


def dynamic_range(noise: Column, black: Column, lower: Column, upper: Column, constant: Column, p: Parameters = Parameters()) -> Column:
    """A struct of stops between the floors at SNR 1 and 3 and the upper end."""
    ceiling = F.greatest(upper - black, F.lit(0.0))
    stops = lambda floor: F.log2(F.greatest(ceiling / floor, F.lit(1.0)))
    f1, f3 = (F.when(~constant, signal_for_snr(noise, k, p)) for k in (1.0, 3.0))

    def with_read(sigma: Column) -> Column:
        a = noise["model"]["shot"]
        return stops(F.greatest(0.5 * a + 0.5 * F.hypot(a, 2.0 * sigma), F.lit(1.0)))

    resolved = F.coalesce(noise["resolved"], F.lit(False))
    return F.struct(
        F.when(resolved, "poisson_gaussian_model").when(f1.isNotNull(), "measured_shadow_noise_proxy").otherwise("unavailable").alias("method"),
        F.when(f1.isNotNull(), noise["confidence"]).otherwise("unavailable").alias("confidence"),
        stops(f1).alias("snr1_stops"), stops(f3).alias("snr3_stops"), f1.alias("snr1_floor"), f3.alias("snr3_floor"), ceiling.alias("highlight_signal"),
        F.when(f3.isNotNull(), F.log2(F.greatest(ceiling / F.greatest(lower - black, f3), F.lit(1.0)))).alias("scene_contrast_stops"),
        F.when(resolved & ~constant, with_read(noise["read_sigma_high"])).alias("sensitivity_low"), F.when(resolved & ~constant, with_read(noise["read_sigma_low"])).alias("sensitivity_high"),
    )


def equal_count_bins(rows: DataFrame, value: str, keys: tuple[str, ...] = KEYS, per_bin: int = 48, most: int = 16) -> DataFrame:
    """Rows in order of `value` (ties by all their columns) with `bin`: chunks of equal size, the last one smaller."""
    by = Window.partitionBy(*keys)
    n = F.count("*").over(by)
    count = F.least(F.greatest(F.floor(n / per_bin), F.lit(1)), F.lit(most))
    size = F.ceil(n / count)
    place = F.row_number().over(by.orderBy(value, *[c for c in rows.columns if c not in (value, *keys)]))
    return rows.select("*", F.floor((place - 1) / size).cast("int").alias("bin"))
